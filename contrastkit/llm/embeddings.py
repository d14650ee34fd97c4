"""Embedding near-duplicates (operator 7): PCA-ordered tiles, compared a few leading dimensions at a time.

Vectors of one label and length are scaled to length 1, turned into principal axes and put in the order of the cells of
their leading coordinates. Blocks are runs of that order; two blocks whose boxes of leading coordinates lie further
apart than links reach are never brought together, nor are their vectors shipped. A pair of blocks is one task, which
goes through tiles of both: tiles are dropped by their boxes, then the products of the leading dimensions are summed
first and what the rest can add is bounded by the norms of the rest. Blocks grow with the table, up to BLOCK_BYTES, so
that a vector is shipped to about as many tasks in a larger table. Equal vectors are one class with a count, so copies
never meet each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, LongType, StructField, StructType

from contrastkit.llm.common import cut, hot_join
from contrastkit.llm.components import connected_components, forest
from contrastkit.operators.ordered import running

#: Most vectors of a block: as many as BLOCK_BYTES hold in double precision, and no more than the table's share in
#: PARTS, but LEAST_BLOCK in any case. Vectors in a tile of a block.
BLOCK_BYTES, PARTS, LEAST_BLOCK, TILE = 16 << 20, 12, 1024, 512
#: Leading coordinates that boxes hold, and those that the order is made of.
LEAD, ORDERED = 8, 3
#: Lengths of vectors that get principal axes, commonest first; others keep their own axes. Longest that get them.
TURNED, LONGEST = 16, 2048
_GROUP = ["label", "d"]
#: What rounding may add to a bound.
_SLACK = 1e-9


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The rows of a list column of equal lengths, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _fits() -> Column:
    """Rows that may link, never null: label and id are set, and the vector has finite components, not all zero."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    found = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists(x, lambda v: v != 0)
    return F.coalesce(found, F.lit(False))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    lengths = batch.column("d").to_numpy()
    for d in np.unique(lengths).tolist():
        yield d, batch.filter(pa.array(lengths == d))


def _axes(classes: DataFrame, lengths: list[int]) -> dict[int, np.ndarray]:
    """Principal axes, leading first, of each of some lengths, from the sum of all outer products: d squared numbers."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for whole in rows:
            for d, batch in _by_length(whole):
                x = _unit(_matrix(batch.column("embedding"), d))
                own = held.setdefault(d, [np.zeros((d + 1, d)), 0])
                own[0][:d] += x.T @ x
                own[0][d] += x.sum(axis=0)
                own[1] += len(x)
        for d, (total, n) in held.items():
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), d)), pa.array(np.arange(len(flat))), pa.array(flat), pa.array(np.full(len(flat), n))], names=["d", "k", "v", "n"])

    if not lengths:
        return {}
    own = classes.where(F.col("d").isin(lengths)).select("d", "embedding")
    found = own.mapInArrow(run, "d long, k long, v double, n long").groupBy("d", "k").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).toArrow()
    length, place, value, many = (found.column(c).to_numpy() for c in ("d", "k", "v", "n"))
    out = {}
    for d in np.unique(length).tolist():
        here = length == d
        flat = np.zeros((d + 1) * d)
        flat[place[here]] = value[here]
        total, n = flat.reshape(d + 1, d), int(many[here][0])
        mean = total[d] / n
        out[d] = np.linalg.eigh(total[:d] / n - np.outer(mean, mean))[1][:, ::-1].copy()
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _turned(x: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    own = axes.get(x.shape[1])
    return _unit(x) if own is None else _unit(x) @ own


def _leads(x: np.ndarray) -> np.ndarray:
    """The leading coordinates, zeros where there are fewer."""
    return np.hstack([x[:, :LEAD], np.zeros((len(x), max(0, LEAD - x.shape[1])))])


def _located(classes: DataFrame, axes: dict[int, np.ndarray], reach: float) -> DataFrame:
    """classes with their leading coordinates, and the cell of the first few as one number whose neighbours are near."""
    sent = classes.sparkSession.sparkContext.broadcast(axes)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for d, batch in _by_length(whole):
                lead = _leads(_turned(_matrix(batch.column("embedding"), d), sent.value))
                cell = np.clip(((lead[:, :ORDERED] + 1) / reach * 2), 0, (1 << 16) - 1).astype(np.int64)
                code = np.zeros(len(cell), np.int64)
                for bit in range(16):
                    for k in range(ORDERED):
                        code |= (cell[:, k] >> bit & 1) << (bit * ORDERED + ORDERED - 1 - k)
                at = pa.array(np.arange(0, len(lead) * LEAD + 1, LEAD, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.ListArray.from_arrays(at, pa.array(lead.ravel()))], names=[*batch.schema.names, "code", "lead"])

    return classes.mapInArrow(run, StructType([*classes.schema.fields, StructField("code", LongType()), StructField("lead", ArrayType(DoubleType()))]))


def _blocked(located: DataFrame) -> DataFrame:
    """located with block: runs of the order, of about equal size in a group."""
    sizes = cut(located.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("all")), "groups")
    total = sizes.agg(F.sum("all")).first()[0] or 0
    most = F.greatest(F.lit(1), F.least(F.floor(F.lit(BLOCK_BYTES) / (F.col("d") * 8)), F.lit(max(LEAST_BLOCK, -(-total // PARTS)))))
    placed = hot_join(running(located, _GROUP, ["code", "node"], {"place": F.lit(1)}), sizes, _GROUP)
    return placed.withColumn("block", F.floor((F.col("place") - 1) * F.ceil(F.col("all") / most) / F.col("all")).cast("long")).drop("place", "all", "code")


def _pairs(blocked: DataFrame, reach: float) -> DataFrame:
    """(pair, side, node, n, d, embedding): the classes of each pair of blocks that may hold links; side 1 is left out
    where a block meets itself."""
    edge = lambda f, name: F.array(*[f(F.col("lead")[k]) for k in range(LEAD)]).alias(name)
    boxes = cut(blocked.groupBy(*_GROUP, "block").agg(edge(F.min, "low"), edge(F.max, "high")), "boxes")
    others = boxes.select(*_GROUP, F.col("block").alias("other"), F.col("low").alias("olow"), F.col("high").alias("ohigh"))
    gap = F.aggregate(F.sequence(F.lit(0), F.lit(LEAD - 1)), F.lit(0.0), lambda t, k: t + F.pow(F.greatest(F.col("low")[k] - F.col("ohigh")[k], F.col("olow")[k] - F.col("high")[k], F.lit(0.0)), F.lit(2.0)))
    met = boxes.join(others, _GROUP).where((F.col("block") <= F.col("other")) & (gap <= F.lit((reach + _SLACK) ** 2)))
    ends = F.array(F.struct(F.lit(0).alias("side"), F.col("block").alias("b")), F.struct(F.lit(1).alias("side"), F.col("other").alias("b")))
    ends = F.when(F.col("block") == F.col("other"), F.slice(ends, 1, 1)).otherwise(ends)
    members = met.select(*_GROUP, F.xxhash64(*_GROUP, "block", "other").alias("pair"), F.explode(ends).alias("e")).select(*_GROUP, "pair", "e.side", F.col("e.b").alias("block"))
    return members.join(blocked, [*_GROUP, "block"]).select("pair", "side", "node", "n", "d", "embedding")


def _near(a: np.ndarray, b: np.ndarray, rest_a: np.ndarray, rest_b: np.ndarray, steps: list[int], least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs with a product of least or more. rest_x[k] are the norms of what is left behind steps[k]."""
    first = steps[0]
    sums = a[:, :first] @ b[:, :first].T
    open_ = sums + np.outer(rest_a[0], rest_b[0]) >= least - _SLACK
    if same:
        open_ = np.triu(open_, 1)
    i, j = np.nonzero(open_)
    held = sums[i, j]
    for k in range(1, len(steps)):
        if not len(i):
            break
        lo, hi = steps[k - 1], steps[k]
        held = held + np.einsum("ij,ij->i", a[i, lo:hi], b[j, lo:hi])
        stay = held + rest_a[k][i] * rest_b[k][j] >= least - _SLACK
        i, j, held = i[stay], j[stay], held[stay]
    return i, j


def _tiles(lead: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First rows of the tiles of a block, and the boxes of their leading coordinates."""
    first = np.arange(0, len(lead), size)
    return first, np.minimum.reduceat(lead, first, axis=0), np.maximum.reduceat(lead, first, axis=0)


def _compare(pairs: DataFrame, axes: dict[int, np.ndarray], least: float, reach: float) -> DataFrame:
    """(node, other, links): links of a class found in a pair of blocks (other null), and edges (links null) that join
    the same components as all links of the pair do."""
    sent, tile = pairs.sparkSession.sparkContext.broadcast(axes), TILE

    def half(rows: pa.Table, dims: int) -> tuple:
        rows = rows.combine_chunks()
        raw = _matrix(rows.column("embedding").combine_chunks(), dims)
        x = _turned(raw, sent.value)
        lead = _leads(x)
        order = np.lexsort((lead[:, 1], np.floor(lead[:, 0] / reach)))  # rows come in any order
        raw, x, lead = raw[order], x[order], lead[order]
        steps = sorted({min(dims, k) for k in (8, 16, 32, 64, 128, 256, 512)} | {dims})
        # norms of the rest behind each step
        rest = [np.sqrt((x[:, k:] ** 2).sum(axis=1)) for k in steps]
        return rows.column("node").to_numpy()[order], rows.column("n").to_numpy()[order], raw, x, rest, steps, *_tiles(lead, tile)

    def run(pair: pa.Table) -> pa.Table:
        side, dims = pair.column("side").to_numpy(), pair.column("d")[0].as_py()
        one = half(pair.filter(pa.array(side == 0)), dims)
        same = bool((side == 0).all())
        two = one if same else half(pair.filter(pa.array(side == 1)), dims)
        links = [np.zeros(len(one[0]), np.int64), np.zeros(len(two[0]), np.int64)]
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for p, a in enumerate(one[6].tolist()):
            gaps = np.maximum(np.maximum(two[7] - one[8][p], one[7][p] - two[8]), 0.0)
            for q in np.flatnonzero((gaps * gaps).sum(axis=1) <= (reach + _SLACK) ** 2).tolist():
                if same and q < p:
                    continue
                b = int(two[6][q])
                own, other = slice(a, a + tile), slice(b, b + tile)
                i, j = _near(one[3][own], two[3][other], [r[own] for r in one[4]], [r[other] for r in two[4]], one[5], least, same and p == q)
                if not len(i):
                    continue
                i, j = i + a, j + b
                # the turned vectors are rounded: what counts is the cosine of the vectors as they came
                x, y = one[2][i], two[2][j]
                x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
                cosine = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
                i, j = i[cosine >= least], j[cosine >= least]
                links[0] += np.bincount(i, weights=two[1][j], minlength=len(one[0])).astype(np.int64)
                links[1] += np.bincount(j, weights=one[1][i], minlength=len(two[0])).astype(np.int64)
                found = forest(one[0][i], two[0][j])
                ends.append((found[:, 0], found[:, 1]))
        edges = forest(*(np.concatenate([e[k] for e in ends]) for k in (0, 1))) if ends else np.zeros((0, 2), np.int64)
        nodes, many = np.concatenate([one[0], two[0]]), np.concatenate(links)
        counted = many > 0
        node = np.concatenate([nodes[counted], edges[:, 0]])
        is_edge = np.arange(len(node)) >= counted.sum()
        far, own = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
        far[is_edge], own[~is_edge] = edges[:, 1], many[counted]
        return pa.table({"node": pa.array(node, pa.int64()), "other": pa.array(far, mask=~is_edge), "links": pa.array(own, mask=is_edge)})

    return pairs.groupBy("pair").applyInArrow(run, "node long, other long, links long")


def embedding_near_duplicates(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of vectors (vec_id, embedding, label).

    Vectors of one label and one length link at a cosine of `least` (over 0) or more, in double precision. Labels are
    compared as they are, of whatever type. A vector that is null, empty or all zero, has null or non-finite components,
    or has a null label or id, links with nothing: 0 links, its own component, kept. Equal vectors link with each other.
    Other columns are not read. No rows in: no rows out.
    """
    kind = vectors.schema["embedding"].dataType.elementType
    kept = F.col("embedding") if kind in (FloatType(), DoubleType()) else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", kept.alias("embedding"))
    alone = ["vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")]
    keyed = rows.where(_fits()).withColumn("key", F.xxhash64("label", "embedding")).withColumn("key2", F.xxhash64(F.lit(7), "embedding", "label"))
    classes = keyed.groupBy("key", "key2").agg(F.min("vec_id").alias("node"), F.first("label").alias("label"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding"))
    classes = cut(classes.withColumn("d", F.size("embedding").cast("long")), "vectors")
    common = classes.where(F.col("d") <= LONGEST).groupBy("d").count().orderBy(F.desc("count"), "d").limit(TURNED)
    axes = _axes(classes, [r["d"] for r in common.collect()])
    reach = float(np.sqrt(2 - 2 * least)) * (1 + 1e-6)
    blocked = cut(_blocked(_located(classes.select("node", "label", "n", "d", "embedding"), axes, reach)), "blocks")
    found = cut(_compare(_pairs(blocked, reach), axes, least, reach), "links")
    roots = connected_components(found.where("other is not null").select("node", "other"), "node", "other")
    links = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("key", "key2", "node", "n").join(links, "node", "left").join(roots, "node", "left")
    named = named.select("key", "key2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    linked = hot_join(keyed.select("vec_id", "key", "key2"), named, ["key", "key2"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return linked.unionByName(rows.where(~_fits()).select(*alone))
