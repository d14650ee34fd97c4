from collections import Counter, defaultdict

import pytest
from fixtures import SCHEMA, WORD, clashing, edge_docs, edge_rows

from contrastkit.llm import mixing
from contrastkit.llm.mixing import mixed_documents, mixed_sources


def targets(sizes, weights=(5, 2, 1), most=3):
    """By resharing what is over the caps until nothing is."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, capped = {}, set()
    total = sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        out = {s: most * sizes[s] if s in capped else left * weight[s] / free for s in names}
        over = {s for s in names if s not in capped and out[s] > most * sizes[s]}
        if not over:
            return out
        capped |= over


def check(rows, got, near):
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((d, s, size(t)) for d, t, _, s, _ in rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for d, t, _, s, _ in rows:
        sizes[s] += size(t)
    wanted = targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(wanted[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in wanted.items():
        assert abs(taken[s] - t) <= near(t), (s, taken[s], t)


def test_edges(spark):
    for docs in (clashing(spark),):
        check(edge_rows(), mixed_sources(docs).collect(), lambda t: 4500)  # a source may have one long document and little else
    assert mixed_sources(spark.createDataFrame([], SCHEMA)).count() == 0
    empty = spark.createDataFrame([(1, None, "en", "a", 1), (2, " ", "en", None, 1)], SCHEMA)
    assert [r["taken"] for r in mixed_sources(empty).collect()] == [0, 0]


def test_documents_and_reruns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = mixed_sources(docs).collect()
    check([tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()], first, lambda t: 0.005 * t + 2)
    again = mixed_sources(docs.repartition(7)).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


def test_capped_and_single_sources(spark):
    rows = [(k, "a b c", "en", "tiny", 1) for k in range(3)] + [(10 + k, "x " * (k + 1), "en", "z", 1) for k in range(50)]
    check(rows, mixed_sources(spark.createDataFrame(rows, SCHEMA)).collect(), lambda t: 2)
    check(rows[3:], mixed_sources(spark.createDataFrame(rows[3:], SCHEMA)).collect(), lambda t: 2)


def test_rows_come_as_often_as_taken(spark):
    docs = edge_docs(spark)
    wanted = Counter()
    for r in mixed_sources(docs).collect():
        wanted[(r["doc_id"], r["source"], r["size"])] += r["copies"]
    got = Counter((r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in mixed_documents(docs).collect())
    assert got == Counter({k: v for k, v in wanted.items() if v})


@pytest.mark.parametrize("words", [300, 100000])
def test_one_book_beside_single_words(spark, monkeypatch, words):
    """What rounding a large document leaves is made up by many small ones, in rounds as the logarithm of it."""
    histogram = spark.createDataFrame([("=A", words, 1), ("=A", 1, words), ("=B", 1, int(2.9 * words))], "key string, size long, n long")
    sources = spark.createDataFrame([("=A", "A", 2 * words), ("=B", "B", int(2.9 * words))], "key string, source string, source_size long")
    targets = mixing.source_targets(sources, (5.0, 2.0), 3.0)
    rounds, plain = [], mixing._corrected
    monkeypatch.setattr(mixing, "_corrected", lambda *a: rounds.append(1) or plain(*a))
    plan = mixing.rounded_copies(histogram, mixing.dual_lambdas(histogram, targets, 3.0), targets, 3).collect()
    wanted = {r["key"]: r["target"] for r in targets.collect()}
    taken = defaultdict(int)
    for r in plan:
        assert 0 <= r["copies"] <= 3 * r["n"]
        taken[r["key"]] += r["copies"] * r["size"]
    assert all(abs(taken[k] - t) <= 0.0005 * t + 1 for k, t in wanted.items())
    assert len(rounds) < 10
