from collections import Counter
from math import comb

import pytest
from fixtures import SCHEMA, WORD, clashing, edge_docs, edge_rows
from pyspark.sql import functions as F

from contrastkit.llm.quality import LADDERS, base_features, binomial_tail, certified_cutoffs, quality_rules

LABELS = "doc_id long, quality int, toxic int"


def base(text):
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(zip(words, words[1:], words[2:]))
    marked = set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if seen[w] > 1:
            marked |= {i, i + 1, i + 2}
    lines, met, repeated = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            repeated += line in met
            met.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(marked), n < 50 or 100 * len(marked) > 50 * n


def test_base(spark):
    extra = [(500, "a b c a b c", "en", "s", 1), (501, "a a a a a", "en", "s", 1), (502, "x y z q x y z", "en", "s", 1), (503, "same line\nsame line\n\n\n same line", "en", "s", 1), (504, "a b", "en", "s", 1), (505, "a b c", "en", "s", 1)]
    rows = edge_rows() + extra
    got = [tuple(r) for r in base_features(spark.createDataFrame(rows, SCHEMA)).drop("n_lines").collect()]
    assert sorted(got, key=repr) == sorted([(d, *base(t)) for d, t, *_ in rows], key=repr)


def test_base_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(tuple(r) for r in base_features(docs).drop("n_lines").collect())
    assert got == sorted((r["doc_id"], *base(r["text"])) for r in docs.select("doc_id", "text").collect())


def test_tail_is_exact(spark):
    cases = [(n, k, p) for n in (0, 1, 5, 60, 400, 3000) for k in range(0, min(n, 60) + 1, 3) for p in (0.005, 0.02, 0.1)]
    for p in (0.005, 0.02, 0.1):
        own = [(n, k) for n, k, q in cases if q == p]
        got = spark.createDataFrame(own, "n long, k long").select("n", "k", binomial_tail(F.col("n"), F.col("k"), p).alias("t")).collect()
        for r in got:
            n, k = r["n"], r["k"]
            exact = sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)) if n < 500 else None
            if n == 0 or k >= n * p:
                assert r["t"] == 1.0
            elif exact is not None:
                assert r["t"] >= exact * (1 - 1e-12) and r["t"] == pytest.approx(exact, rel=1e-6)
    assert spark.range(1).select(binomial_tail(F.lit(10**9), F.lit(19_000_000), 0.02)).first()[0] < 1e-9


def junk_table(spark, n=3000):
    clean = "word " * 20 + " ".join(f"w{k}" for k in range(60))
    rows, labels = [], []
    for k in range(n):
        bad = k % 5 == 0
        text = " ".join(f"{chr(97 + k % 26)}{j}x{k}" + ("$$$" if bad else "") for j in range(80))
        rows.append((k, text, "en" if k % 2 else "de", "s", 1))
        labels.append((k, 0 if bad else 1, 0))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS), clean


def test_junk_goes_and_clean_stays(spark):
    docs, labels, _ = junk_table(spark)
    got = {r["doc_id"]: r["kept"] for r in quality_rules(docs, labels).collect()}
    assert all(kept == bool(d % 5) for d, kept in got.items())


def test_few_labels_reject_nothing(spark):
    docs, labels, _ = junk_table(spark, 100)
    assert all(r["kept"] for r in quality_rules(docs, labels).collect())


def test_false_rejections_are_bounded(spark):
    """Signals without any bearing on quality: whatever is certified rejects few good documents."""
    rows = [(k, f"l{k % 3}", 100, 500, (k * 7919) % 300, 0, 0, 10, False) for k in range(6000)]
    features = spark.createDataFrame(rows, "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, base_failed boolean")
    labels = spark.createDataFrame([(k, int(k % 7 > 0), 0) for k in range(6000)], LABELS)
    found = certified_cutoffs(features, labels, "stratum", 0.04, 0.05, 0.0).collect()
    for r in found:
        if r["rule"] == "symbol_share":
            good = [x for x in rows if x[1] == r["stratum"] and x[0] % 7]
            assert sum(x[4] / x[3] > r["cutoff"] for x in good) <= 0.04 * len(good)
    assert {r["rule"] for r in found} <= set(LADDERS)


def test_edges(spark):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (None, 1, 0), (1, None, 1), (99999, 0, 1)], LABELS)
    for docs in (clashing(spark), edge_docs(spark).drop("lang")):
        got = quality_rules(docs, labels).collect()
        assert len(got) == len(edge_rows()) and all(r["kept"] == (not r["base_failed"]) for r in got)
    assert quality_rules(spark.createDataFrame([], SCHEMA), labels).count() == 0
    assert quality_rules(edge_docs(spark), spark.createDataFrame([], LABELS)).count() == len(edge_rows())
