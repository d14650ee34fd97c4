import hashlib
import json
import random

import public_tokenizers
import pytest
from fixtures import SCHEMA, clashing, edge_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from contrastkit.llm import pairs, queries
from contrastkit.llm.pairs import Vocabulary, decoded, encoded, vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


def ours(text):
    known = pairs._Known(vocabulary(PATH))
    numbers = known.numbers(text)
    known.settle()
    return known.lists([numbers])[0].as_py()


def digests(text):
    ids = ids_of(text)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(WHOLE.decode(ids, skip_special_tokens=False))


def test_all_documents(spark, sf_dir):
    wanted = {r["doc_id"]: digests(r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op13_bpe_round_trip(spark, sf_dir).collect()
    assert len(got) == len(wanted)
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == wanted


@pytest.mark.parametrize("indexed", [1, 700, 1 << 25])
def test_edges(spark, monkeypatch, indexed):
    monkeypatch.setattr(pairs, "INDEXED", indexed)
    monkeypatch.setattr(pairs, "REMEMBERED", 50)
    docs = clashing(spark).coalesce(2)
    got = decoded(encoded(docs, PATH, into="piece"), PATH, ids="piece", into="kept")
    assert sorted(got.columns) == sorted(docs.columns)
    rows = sorted(((r["doc_id"], r["text"], r["piece"], r["kept"]) for r in got.collect()), key=str)
    assert rows == sorted(((d, t, ids_of(t), WHOLE.decode(ids_of(t), skip_special_tokens=False)) for d, t, *_ in edge_rows()), key=str)
    assert all(k == (t or "") for _, t, _, k in rows)
    assert encoded(spark.createDataFrame([], SCHEMA), PATH).count() == 0


@pytest.mark.parametrize("frequent", [0, 6000, 1 << 20])
def test_awkward_texts(monkeypatch, frequent):
    """One by one, as dealt, or all in numpy."""
    monkeypatch.setattr(pairs, "_FREQUENT", frequent)
    monkeypatch.setattr(pairs, "_FEW", 50 if frequent == 6000 else 1e-9)
    draw = random.Random(3)
    samples = ["a" * 5000, "ab" * 3000 + "a", " " * 3000 + "b", "I've  got\n\n 'x' \x1c\x1d \x85 \xa0  12½ \t", "<|endoftext|>", "x<|endoftext|> <|endoftext|>\n<|endofte", "  <|endoftext|>  ", "́a\U0001f9d1‍\U0001f4bb 漢字かな Привет ١٢٣ 𝟘Ⅷ ͸ \U0001e030"]
    samples += ["", " ", "a ", " a", "a  b", "a \n b", "a\n b c", "a \u2003b c \u3000 d", "x <|endoftext|> y", " a<|endoftext|> b  "]
    samples += ["".join(draw.choice("ab \n'") for _ in range(400)) for _ in range(30)]
    samples += ["".join(chr(draw.choice([draw.randrange(0x250), draw.randrange(0xD800), draw.randrange(0xE000, 0x32000)])) for _ in range(200)) for _ in range(60)]
    for text in [*samples, "\n".join(samples)]:
        assert ours(text) == ids_of(text), text[:80]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    assert ours(text) == ids_of(text)


def test_decoding_any_ids(spark):
    draw = random.Random(8)
    lists = [[draw.randrange(50257) for _ in range(draw.randint(0, 12))] for _ in range(300)] + [[50256, 50256], [198]]
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(lists)] + [(-1, None), (-2, [None, 198, -4, 50257, 1 << 30])], "k long, token_ids array<int>")
    got = {r["k"]: r["decoded"] for r in decoded(frame, PATH).collect()}
    assert got == {k: WHOLE.decode(x, skip_special_tokens=False) for k, x in enumerate(lists)} | {-1: None, -2: "\n"}


def test_other_vocabularies_are_refused(tmp_path):
    with pytest.raises(ValueError, match="not a plain"):
        Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    spec = json.load(open(PATH, encoding="utf-8"))
    spec["model"]["merges"].reverse()
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="comes before"):
        Vocabulary(str(tmp_path / "t.json"))
