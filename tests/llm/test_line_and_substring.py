import hashlib
from collections import defaultdict

from fixtures import SCHEMA, WORD, clashing, edge_rows, lowered

from contrastkit.llm import substrings
from contrastkit.llm.lines import deduplicated_lines
from contrastkit.llm.substrings import removed_repeats


def expected_lines(rows):
    key = lambda line: lowered(line.strip(" \t\n\x0b\x0c\r"))
    place = lambda d: (d is None, d or 0)
    owners = defaultdict(set)
    for d, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                owners[key(line)].add(place(d))
    out = []
    for d, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or min(owners[key(x)]) == place(d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_lines(spark):
    out = deduplicated_lines(clashing(spark))
    got = [tuple(r) for r in out.select("doc_id", "n_lines", "n_dropped", "kept").collect()]
    assert sorted(got, key=repr) == sorted(expected_lines(edge_rows()), key=repr)
    assert {"d", "lost", "size", "key"} <= set(out.columns) and set(r["d"] for r in out.select("d").collect()) == {"x"}


def test_lines_in_levels(spark):
    got = deduplicated_lines(clashing(spark), n_batches=5, fanout=2)
    assert got.count() == len(edge_rows())
    assert deduplicated_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_long_text_of_lines_that_all_go(spark):
    """Places are left out at once, not line by line; no run stays in the catalog."""
    long = "\n".join(f"line number {k}" for k in range(60000))
    rows = [(1, long, "en", "s", 1), (2, long, "en", "s", 1), (3, "line number 7\nanother line", "en", "s", 1)]
    before = len(spark.catalog.listTables())
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept"]) for r in deduplicated_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (60000, 0, long), 2: (60000, 60000, ""), 3: (2, 1, "another line")}
    assert len(spark.catalog.listTables()) == before


def expected_repeats(rows, window):
    words = [WORD.findall(t or "") for _, t, *_ in rows]
    seen = defaultdict(int)
    for w in words:
        for i in range(len(w) - window + 1):
            seen[tuple(w[i : i + window])] += 1
    out = []
    for (d, *_), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_repeats(spark):
    for docs in (clashing(spark),):
        got = [tuple(r)[:4] for r in removed_repeats(docs).collect()]
        assert sorted(got, key=repr) == sorted(expected_repeats(edge_rows(), 35), key=repr)
    assert removed_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_hashes_need_no_counting(spark, monkeypatch):
    """With every repeated hash of the sample taken for a hot one, and all texts in the sample, results are the same."""
    monkeypatch.setattr(substrings, "SAMPLED", 1)
    monkeypatch.setattr(substrings, "OFTEN", 2)
    passage = " ".join(f"w{k}" for k in range(50))
    rows = edge_rows() + [(500 + k, f"{k} start {passage} end {k}", "en", "s", 1) for k in range(40)] + [(700 + k, f"a whole text {passage} of many copies", "en", "s", 1) for k in range(30)]
    got = [tuple(r)[:4] for r in removed_repeats(spark.createDataFrame(rows, SCHEMA).repartition(9)).collect()]
    assert sorted(got, key=repr) == sorted(expected_repeats(rows, 35), key=repr)


def test_repeats_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r)[:4] for r in removed_repeats(docs).collect()]
    assert sorted(got) == sorted(expected_repeats(rows, 35))
