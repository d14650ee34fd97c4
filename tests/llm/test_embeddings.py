import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from contrastkit.llm import embeddings
from contrastkit.llm.embeddings import embedding_near_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows, least):
    good = []
    for k, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.append(k)
    x = {k: np.array(rows[k][1], dtype=np.float32).astype(np.float64) for k in good}
    parent, links = {k: k for k in range(len(rows))}, [0] * len(rows)

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(x[a]) == len(x[b]) and x[a] @ x[b] / math.sqrt((x[a] @ x[a]) * (x[b] @ x[b])) >= least:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    low = {}
    for k in good:
        low[root(k)] = min(rows[k][0], low.get(root(k), rows[k][0]))
    return [(i, links[k], low.get(root(k), i), low.get(root(k), i) == i if i is not None else True) for k, (i, _, _) in enumerate(rows)]


def sample(n=400):
    draw = np.random.default_rng(9)
    rows = []
    for k in range(n):
        base = draw.normal(size=8)
        if k % 3 and rows:
            base = np.array(rows[draw.integers(len(rows))][1]) * draw.choice([1.0, 3.0]) + draw.normal(size=8) * draw.choice([0.0, 0.02, 0.1, 0.3])
        rows.append((k * 7 % 1009, [float(np.float32(x)) for x in base], int(draw.integers(3))))
    odd = [[0.0] * 8, None, [], [1.0] * 7, [1.0] * 7 + [None], [float("nan")] * 8, [float("inf")] + [1.0] * 7, [1e-30] * 8, [3e37] * 8, [-0.0] * 7 + [1.0], [0.0] * 7 + [1.0]]
    rows += [(2000 + k, v, 1) for k, v in enumerate(odd)]
    return rows + [(3000, [1.0] * 8, None), (3001, [1.0] * 8, None), (None, [1.0] * 8, 1), rows[5], (3002, rows[5][1], rows[5][2])]


def test_pairs(spark):
    rows = sample()
    for least in (0.98, 0.9):
        got = [tuple(r) for r in embedding_near_duplicates(spark.createDataFrame(rows, SCHEMA), least).collect()]
        assert sorted(got, key=repr) == sorted(expected(rows, least), key=repr)


def test_empty_and_other_columns(spark):
    assert embedding_near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None, 1), (2, [], 1)]
    assert sorted(map(tuple, embedding_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
    names = ["key", "key2", "node", "n", "part", "cx", "pair", "side"]
    many = spark.createDataFrame(sample(60), SCHEMA).select("*", *[F.lit(1).alias(n) for n in names])
    assert sorted(map(tuple, embedding_near_duplicates(many).collect()), key=repr) == sorted(expected(sample(60), 0.98), key=repr)


def test_labels_and_lengths_as_they_are(spark):
    base = [1.0, 2.0, 3.0]
    rows = [(1, base, 1.2), (2, base, 1.7), (3, base, 1.2), (4, [1.0, 2.0], 1.2), (5, [2.0, 4.0], 1.2), (6, [1.0], 1.2), (7, [-1.0], 1.2)]
    for kind, label in (("double", lambda x: x), ("string", lambda x: f"l{x}")):
        own = [(i, v, label(x)) for i, v, x in rows]
        got = [tuple(r) for r in embedding_near_duplicates(spark.createDataFrame(own, f"vec_id long, embedding array<float>, label {kind}")).collect()]
        assert sorted(got) == sorted(expected(own, 0.98)) and {r[0]: r[1] for r in got} == {1: 1, 2: 0, 3: 1, 4: 1, 5: 1, 6: 0, 7: 0}


def test_blocks_do_not_change_the_links(spark, monkeypatch):
    rows = sample(300)
    monkeypatch.setattr(embeddings, "LEAST_BLOCK", 20)
    monkeypatch.setattr(embeddings, "TILE", 8)
    got = [tuple(r) for r in embedding_near_duplicates(spark.createDataFrame(rows, SCHEMA), 0.9).collect()]
    assert sorted(got, key=repr) == sorted(expected(rows, 0.9), key=repr)


def test_shipping_is_flat(spark):
    """A vector is shipped about as often in a table ten times as large, though no two of them are near."""
    shipped = []
    for n in (4000, 40000):
        draw = np.random.default_rng(n).normal(size=(n, 16)).astype(np.float32)
        vectors = pa.FixedSizeListArray.from_arrays(pa.array(draw.ravel()), 16).cast(pa.list_(pa.float32()))
        ones = pa.array(np.ones(n, np.int64))
        rows = spark.createDataFrame(pa.table({"node": pa.array(np.arange(n)), "label": ones, "n": ones, "d": pa.array(np.full(n, 16)), "embedding": vectors}))
        shipped.append(embeddings._pairs(embeddings._blocked(embeddings._located(rows, {}, 0.2)), 0.2).count() / n)
    assert shipped[1] <= 2.5 * shipped[0] + 4 and shipped[1] < 16
