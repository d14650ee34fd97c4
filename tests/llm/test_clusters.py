import hashlib
import math

import numpy as np
import pytest

from contrastkit.llm import clusters
from contrastkit.llm.clusters import BallTree, centroid_clusters, squared_distances

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, ids int"


def brute(rows, k=8, rounds=10, dims=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(1024 * float(np.float32(x))) for x in v]))
    name = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=name)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [[] for _ in centroids]
        for _, v in kept:
            own[near(v)[1]].append(v)
        centroids = [[sum(x) // len(o) for x in zip(*o)] if o else c for o, c in zip(own, centroids)]
    found = [(i, *near(v)) for i, v in kept]
    by = {j: sum(d for _, d, x in found if x == j) for _, _, j in found}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, by[j], sum(by.values()), sha[j]) for i, d, j in found), key=str)


def rows_of(n=300, seed=1):
    draw = np.random.default_rng(seed)
    centre = draw.normal(size=(6, 64))
    rows = [(k, (centre[k % 6] + draw.normal(size=64) * [0.02, 0.4][k % 2]).astype(np.float32).tolist()) for k in range(n)]
    rows += [(1000 + k, rows[3][1]) for k in range(200)]  # copies
    bad = [None, [], [1.0] * 63, [None] + [1.0] * 63, [float("nan")] * 64, [float("inf")] + [0.0] * 63]
    rows += [(2000 + k, v) for k, v in enumerate(bad)] + [(None, rows[0][1]), (None, rows[1][1]), (5, rows[7][1]), (5, rows[5][1]), (9, [0.0] * 64), (10, [-0.0] * 64)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 0) for i, v in rows], SCHEMA)


@pytest.mark.parametrize(("tree", "leaf"), [(4096, 32), (50, 4)])
def test_edges(spark, monkeypatch, tree, leaf):
    monkeypatch.setattr(clusters, "TREE", tree)
    monkeypatch.setattr(clusters, "LEAF", leaf)
    rows = rows_of()
    got = centroid_clusters(frame(spark, rows).repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_few_or_no_vectors(spark):
    rows = rows_of()[-6:-2]
    assert sorted(map(tuple, centroid_clusters(frame(spark, rows)).collect()), key=str) == brute(rows)
    for none in ([], [(1, None), (2, [0.5])]):
        assert centroid_clusters(frame(spark, none)).collect() == []


def test_components_that_do_not_fit(spark):
    ok = [(1, [130000.0] * 64), (2, [-130000.0] * 64), (3, [1.0] * 64)]
    assert sorted(map(tuple, centroid_clusters(frame(spark, ok)).collect()), key=str) == brute(ok)
    with pytest.raises(Exception, match="does not fit"):
        centroid_clusters(frame(spark, [(1, [1e6] * 64)])).collect()


def test_balls_are_taken_whole():
    """Tight groups are settled by balls: hardly a point is compared, and the result is that of all comparisons."""
    draw = np.random.default_rng(4)
    centre = draw.integers(-1000, 1000, (8, 16))
    x = np.repeat(centre, 500, axis=0) + draw.integers(-3, 4, (4000, 16))
    tree, owner = BallTree.build(x)
    assert np.array_equal(tree.points[owner], x)
    start = centre + draw.integers(-50, 50, (8, 16))
    counts, sums, nearest, compared = tree.assign(start)
    wanted = np.argmin(squared_distances(x, start), axis=1)
    assert np.array_equal(nearest[owner], wanted) and compared < 0.05 * len(x)
    assert np.array_equal(counts, np.bincount(wanted, minlength=8))
    assert np.array_equal(sums, np.stack([x[wanted == j].sum(axis=0) for j in range(8)]))


def test_ties_go_to_the_smaller_number():
    tree, owner = BallTree.build(np.array([[0, 0], [4, 0], [2, 0], [2, 7]]))
    assert tree.assign(np.array([[4, 0], [0, 0], [4, 0]]))[2][owner].tolist() == [1, 0, 0, 0]
    far = np.array([[1 << 27, 0], [-(1 << 27), 0]])
    assert squared_distances(far, far).tolist() == [[0, 1 << 56], [1 << 56, 0]]
