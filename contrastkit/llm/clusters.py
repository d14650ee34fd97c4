"""Centroid clustering (operator 12): k-means in whole numbers, by ball trees that each hold a few thousand vectors.

Tasks build trees over their own vectors once and write them: a node is the ball of its vectors, with radius, count and
sum; equal vectors of a tree are one with a weight. A round goes down each tree from its root. By the triangle
inequality a centroid that is further from a ball's centre than another by more than twice the radius is nearest to
none of its vectors; a ball that is left with one centroid goes to it as a whole, by its count and sum. What no ball
decides is compared in the leaves, in whole numbers. A task gives one row for each centroid, so a round shuffles no
vectors, and the driver holds k of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrastkit.llm.common import cut

#: Most vectors of a tree, and different vectors of a leaf as expected.
TREE, LEAF = 4096, 32
#: Components beyond this are an error: squared distances would not fit 64 bits.
LARGEST = 1 << 27
#: Components up to this have squared distances that doubles hold exactly.
_EXACT = 1 << 21
_TREES = "ids array<long>, owner array<int>, points array<int>, weights array<long>, sums array<long>, counts array<long>, radius array<double>"


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-number vectors, one row for each of x."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= _EXACT and x.shape[1] <= 1 << 8:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    out = np.empty((len(x), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        out[:, k] = ((x - c) ** 2).sum(axis=1)
    return out


def _bounds(n: int, level: int) -> np.ndarray:
    """First places of the 2 ** level nodes of a level, and the end."""
    return np.arange((1 << level) + 1, dtype=np.int64) * n >> level


def _levels(n: int) -> int:
    return max(0, -(-n // LEAF) - 1).bit_length()


class BallTree:
    """Different points in the order of the leaves, and sums, counts and radius of the balls level by level from the root."""

    def __init__(self, points: np.ndarray, weights: np.ndarray, sums: np.ndarray, counts: np.ndarray, radius: np.ndarray) -> None:
        self.points, self.weights, self.sums, self.counts, self.radius = points, weights, sums, counts, radius

    @classmethod
    def build(cls, x: np.ndarray) -> tuple[BallTree, np.ndarray]:
        """The tree over the rows of x, and the point of each row."""
        points, owner, weights = np.unique(x, axis=0, return_inverse=True, return_counts=True)
        order, n = np.arange(len(points)), len(points)
        for level in range(_levels(n)):
            at = _bounds(n, level)
            for k in range(1 << level):
                own = order[at[k] : at[k + 1]]
                held = points[own]
                axis = int(np.argmax(held.max(axis=0) - held.min(axis=0)))
                order[at[k] : at[k + 1]] = own[np.argsort(held[:, axis], kind="stable")]
        points, weights = points[order], weights[order]
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        sums, counts, radius = [], [], []
        for level in range(_levels(n) + 1):
            at = _bounds(n, level)
            sums.append(np.add.reduceat(points * weights[:, None], at[:-1]))
            counts.append(np.add.reduceat(weights, at[:-1]))
            centre = np.repeat(sums[-1] / counts[-1][:, None], np.diff(at), axis=0)
            radius.append(np.sqrt(np.maximum.reduceat(((points - centre) ** 2).sum(axis=1), at[:-1])))
        return cls(points, weights, np.concatenate(sums), np.concatenate(counts), np.concatenate(radius)), place[owner.ravel()]

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Counts and sums by centroid, the nearest centroid of each point (the smaller number of equally near ones), and
        how many points were compared one by one."""
        k, n = len(centroids), len(self.points)
        counts, sums, nearest = np.zeros(k, np.int64), np.zeros(centroids.shape, np.int64), np.zeros(n, np.int64)
        node, able = np.zeros(1, np.int64), np.ones((1, k), bool)
        last = _levels(n)
        for level in range(last + 1):
            own = node + (1 << level) - 1
            centre, radius = self.sums[own] / self.counts[own][:, None], self.radius[own]
            far = np.stack([np.sqrt(((centre - c) ** 2).sum(axis=1)) for c in centroids.astype(np.float64)], axis=1)
            far[~able] = np.inf
            least = far.min(axis=1)
            able &= far <= ((least + 2 * radius) * (1 + 1e-9) + 1e-6)[:, None]  # rounding never rules one out
            whole = able.sum(axis=1) == 1
            at, to = _bounds(n, level), np.argmax(able[whole], axis=1)
            np.add.at(counts, to, self.counts[own[whole]])
            np.add.at(sums, to, self.sums[own[whole]])
            for b, j in zip(node[whole].tolist(), to.tolist()):
                nearest[at[b] : at[b + 1]] = j
            node, able = node[~whole], able[~whole]
            if level < last:
                node, able = np.stack([2 * node, 2 * node + 1], axis=1).ravel(), np.repeat(able, 2, axis=0)
        at = _bounds(n, last)
        left = np.concatenate([np.arange(at[b], at[b + 1]) for b in node.tolist()]) if len(node) else np.zeros(0, np.int64)
        if len(left):
            nearest[left] = np.argmin(squared_distances(self.points[left], centroids), axis=1)
            np.add.at(counts, nearest[left], self.weights[left])
            np.add.at(sums, nearest[left], self.points[left] * self.weights[left][:, None])
        return counts, sums, nearest, len(left)


def _kept(vectors: DataFrame, dims: int) -> DataFrame:
    """(vec_id, embedding) of vectors of that many finite components."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where(F.coalesce((F.size(x) == dims) & finite, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding"))


def _scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as whole numbers."""
    out = np.floor(x * float(scale))
    if np.abs(out).max(initial=0) > LARGEST:
        raise ValueError(f"a scaled component is over {LARGEST}: its squared distance does not fit 64 bits")
    return out.astype(np.int64)


def ball_trees(kept: DataFrame, dims: int, scale: int) -> DataFrame:
    """Trees of up to TREE rows of (vec_id, embedding), each a row."""

    def tree(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        made, owner = BallTree.build(_scaled(x, scale))
        lists = [ids, pa.array(owner, pa.int32()), pa.array(made.points.ravel(), pa.int32()), pa.array(made.weights, pa.int64()), pa.array(made.sums.ravel(), pa.int64()), pa.array(made.counts, pa.int64()), pa.array(made.radius)]
        columns = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in lists]
        return pa.RecordBatch.from_arrays(columns, names=["ids", "owner", "points", "weights", "sums", "counts", "radius"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = [], np.zeros((0, dims))
        for batch in rows:
            ids.append(batch.column(0))
            x = np.concatenate([x, batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)])
            while len(x) >= TREE:
                whole = pa.concat_arrays(ids)
                yield tree(whole[:TREE], x[:TREE])
                ids, x = [whole[TREE:]], x[TREE:]
        if len(x):
            yield tree(pa.concat_arrays(ids), x)

    return kept.mapInArrow(run, _TREES)


def _read(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.Array, np.ndarray, BallTree]]:
    """(ids, point of each, tree) of each row."""
    names = ["owner", "points", "weights", "sums", "counts", "radius"]
    for k in range(batch.num_rows):
        owner, points, weights, sums, counts, radius = (batch.column(n)[k].values.to_numpy() for n in names)
        tree = BallTree(points.reshape(-1, dims).astype(np.int64), weights, sums.reshape(-1, dims), counts, radius)
        yield batch.column("ids")[k].values, owner, tree


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: componentwise floors of the means of what each has; those with nothing stay."""
    dims = centroids.shape[1]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in rows:
            for _, _, tree in _read(batch, dims):
                found = tree.assign(centroids)
                counts += found[0]
                sums += found[1]
        own = np.flatnonzero(counts)
        at = pa.array(np.arange(0, len(own) * dims + 1, dims), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(counts[own]), pa.ListArray.from_arrays(at, pa.array(sums[own].ravel()))], names=["cluster", "n", "s"])

    own = trees.select("owner", "points", "weights", "sums", "counts", "radius", F.array().cast("array<long>").alias("ids"))
    parts = own.mapInArrow(run, "cluster int, n long, s array<long>")
    whole = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)])
    out = centroids.copy()
    for r in whole.collect():  # a row for each centroid
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dims)]
    return out


def nearest_centroids(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance): the nearest centroid of every vector, and the squared distance."""
    dims = centroids.shape[1]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for ids, owner, tree in _read(batch, dims):
                nearest = tree.assign(centroids)[2]
                distance = ((tree.points - centroids[nearest]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(nearest[owner], pa.int32()), pa.array(distance[owner])], names=["vec_id", "cluster", "distance"])

    return trees.mapInArrow(run, "vec_id long, cluster int, distance long")


def centroid_clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: str = "3", dims: int = 64, scale: int = 1024) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): every vector of `dims` finite components.

    Components x become floor(scale * x), in double precision. The first centroids are the k vectors whose
    "<seed>:<vec_id>" has the smallest SHA-256, in that order; of rows with one vec_id those of smaller components come
    first, and rows without vec_id last. Fewer vectors than k are as many centroids. Equally near centroids: the smaller
    number. Other vectors (null, other lengths, null or non-finite components) have no row; vectors that share a vec_id
    have a row each. Other columns are not read. Scaled components over LARGEST are an error. No vectors: no rows.
    """
    spark = vectors.sparkSession
    kept = _kept(vectors, dims)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(hashed.asc_nulls_last(), "embedding").limit(k).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = _scaled(np.array([r["embedding"] for r in first]), scale)
    trees = cut(ball_trees(kept, dims, scale), "ball-trees")
    for _ in range(rounds):
        now = moved(trees, centroids)
        if np.array_equal(now, centroids):
            break  # every further round would give the same
        centroids = now
    assigned = cut(nearest_centroids(trees, centroids), "assigned")
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    told = spark.createDataFrame([(j, s, sum(sums.values()), sha[j]) for j, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
