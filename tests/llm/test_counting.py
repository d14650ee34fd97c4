import random

import public_tokenizers
from fixtures import SCHEMA, clashing, edge_rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from contrastkit.llm import queries
from contrastkit.llm.counting import EDITS, TokenTree, edited, token_trees, with_edits

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)


def count(text):
    return len(WHOLE.encode(text or "", add_special_tokens=False).ids)


def test_edits_count_as_a_new_encoding_does():
    draw = random.Random(2)
    inserts = ["", " ", "\n", "\n\n ", "word", " two words", "'s", "12", "  x  ", "é", "<|endoftext|>", " a\n" * 30]
    for _, text, *_ in edge_rows():
        text = (text or "")[:4000]
        tree = TokenTree.build(PATH, text, 24)
        assert tree.tokens[1] == count(text)
        for _ in range(40):
            at, removed, new = draw.randint(-2, len(text) + 2), draw.choice([0, 0, 1, 2, 5, 40, 300]), draw.choice(inserts)
            low = min(max(at, 0), len(text))
            wanted = text[:low] + new + text[low + removed :]
            text, _ = tree.edit(PATH, text, at, removed, new)
            assert text == wanted
            assert (tree.tokens[1], tree.chars[1]) == (count(text), len(text))


def test_small_edits_encode_little():
    text = " ".join(str(k) for k in range(20000))
    tree = TokenTree.build(PATH, text, 256)
    _, encoded = tree.edit(PATH, text, 50000, 3, "xyz")
    assert encoded < 1000


def test_tables(spark):
    docs = clashing(spark)
    trees = token_trees(docs, PATH)
    assert sorted((r["n_tokens"] for r in trees.select("n_tokens").collect())) == sorted(count(t) for _, t, *_ in edge_rows())
    edits = spark.createDataFrame([(3, 1, 0, 5, "Hello"), (3, 2, 10**9, 1, " end"), (99999, 1, 0, 0, "x"), (4, 1, None, None, None), (None, 1, 0, 0, "x")], "doc_id long, seq int, at long, removed long, inserted string")
    out = {r["doc_id"]: r for r in edited(with_edits(trees, edits), PATH).collect()}
    text = edge_rows()[3][1]
    assert out[3]["text"] == "Hello" + text[5:] + " end" and out[3]["n_tokens"] == count(out[3]["text"])
    assert out[4]["text"] == edge_rows()[4][1] and out[5]["encoded_chars"] == 0 and out[19]["text"] is None
    none = spark.createDataFrame([], SCHEMA).withColumn("edits", F.lit(None).cast(EDITS))
    assert edited(token_trees(none, PATH), PATH).count() == 0


def test_grown_leaves_are_parted():
    """Inserts at one place stay cheap, and texts without spaces are parted where letters, digits and signs meet."""
    tree, text = TokenTree.build(PATH, "start end", 64), "start end"
    for k in range(300):
        text, encoded = tree.edit(PATH, text, 5, 0, f" w{k}", 64)
        assert encoded < 400
    assert tree.tokens[1] == count(text) and tree.chars[1] == len(text)
    solid = ",".join(f"漢字{k}。é{k}x" for k in range(400))
    assert TokenTree.build(PATH, solid, 64).width > 32
    draw, tree = random.Random(8), TokenTree.build(PATH, solid, 64)
    for _ in range(300):
        text, _ = tree.edit(PATH, solid, draw.randrange(len(solid) + 1), draw.choice([0, 1, 2, 9]), draw.choice(["", "'", "s", "'s", "7", "|>", "<|endoftext|>", " ", "x", "。"]), 64)
        solid = text
        assert (tree.tokens[1], tree.chars[1]) == (count(solid), len(solid))


def test_query_counts_as_new_encodings_do(spark, sf_dir):
    got = {r["doc_id"]: r for r in queries.op5_token_counts(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()
    assert len(got) == len(rows)
    for r in rows:
        text = f"From {r['source'] or 'nowhere'}:\n" + (r["text"] or "")
        at = len(r["text"] or "") // 2
        text = text[:at] + " [...] " + text[at + 40 :] + "\nEnd."
        own = got[r["doc_id"]]
        assert (own["tokens_before"], own["tokens_after"], own["chars_after"]) == (count(r["text"]), count(text), len(text))
