"""Near-duplicates by exact shingle similarity: SimHash BK-trees and MinHash bands retrieve pairs, shared shingles decide.

A pair at the least similarity differs in 5 to 14 bits of a 64-bit SimHash, which shards of bit blocks cannot search at
size, so MinHash bands retrieve what lies beyond the trees' radius. No pair is linked on a sketch alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrastkit.llm.common import cut, hot_join, text_slices
from contrastkit.llm.components import connected_components, forest
from contrastkit.llm.simhash import fingerprint_links, majority_bits, shingle_hashes

#: A pair of similarity 0.8 agrees in no band with probability (1 - 0.8 ** 3) ** 16 = 0.00001.
BANDS, BAND_ROWS = 16, 3
#: Most texts, and most shingles, in a tile of a bucket, as expected.
TILE, TILE_SHINGLES = 192, 1 << 21
_COLUMNS = 1 << 13
_SEEDS = np.random.default_rng(11).integers(0, 1 << 63, (BANDS * BAND_ROWS, 2), dtype=np.uint64) | np.uint64(1)


def _distinct(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    first = np.ones(len(hashes), dtype=bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[first], owner[first]


def _bands(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """int64 keys (text, band) of texts whose distinct hashes begin at begins."""
    out = np.zeros((len(begins), BANDS), dtype=np.uint64)
    for k, (flip, factor) in enumerate(_SEEDS):
        mixed = (hashes ^ flip) * factor
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        band = out[:, k // BAND_ROWS]
        band += np.minimum.reduceat(mixed, begins)
        band *= np.uint64(0x9E3779B97F4A7C15)
        band ^= band >> np.uint64(31)
    return (out + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _sketches(docs: DataFrame, size: int) -> DataFrame:
    """(doc, fp, whole, n, bands): SimHash, hash and number of distinct shingles, and band keys; none of a text without words."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for a, b, data, offsets in text_slices(batch.column(1), 2 << 20):
                hashes, owner = shingle_hashes(data, offsets, size)
                fp = majority_bits(hashes, owner, b - a)
                hashes, owner = _distinct(hashes, owner)
                n = np.bincount(owner, minlength=b - a)
                ends = np.concatenate([[0], np.cumsum(n)])
                worded = np.flatnonzero(n)
                keys = _bands(hashes, ends[worded]).reshape(-1) if len(worded) else np.zeros(0, dtype=np.int64)
                at = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
                whole = np.array([xxhash.xxh64_intdigest(hashes[x:y].tobytes()) for x, y in zip(ends[:-1], ends[1:])], dtype=np.uint64)
                columns = [batch.column(0).slice(a, b - a), pa.array(fp.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(at), pa.array(keys))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "fp", "whole", "n", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc"), "text").mapInArrow(run, "doc long, fp long, whole long, n long, bands array<long>")


def _shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc, shingles): the distinct shingle hashes of each text."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for a, b, data, offsets in text_slices(batch.column(1), 2 << 20):
                hashes, owner = _distinct(*shingle_hashes(data, offsets, size))
                at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=b - a))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(at), pa.array(hashes.view(np.int64)))], names=["doc", "shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("doc"), "text").mapInArrow(run, "doc long, shingles array<long>")


def _alike(pairs: DataFrame, docs: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs (a, b) whose distinct shingles have a Jaccard similarity of least or more."""
    named = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(named, "doc_id", "left_semi")
    sets = cut(_shingle_sets(texts, size), "shingles").dropDuplicates(["doc"])
    met = pairs.join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("doc").alias("b"), F.col("shingles").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return met.where(both >= F.lit(least) * (F.size("sa") + F.size("sb") - both) - 1e-9).select("a", "b")


def _shared_counts(a: np.ndarray, of_a: np.ndarray, rows_a: int, b: np.ndarray, of_b: np.ndarray, rows_b: int) -> np.ndarray:
    """How many hashes each text of one side shares with each of the other, by products of 0-1 matrices."""
    both = np.intersect1d(a, b)
    out = np.zeros((rows_a, rows_b), np.float32)
    place_a, place_b = np.searchsorted(both, a), np.searchsorted(both, b)
    known_a = both[np.minimum(place_a, len(both) - 1)] == a if len(both) else np.zeros(len(a), bool)
    known_b = both[np.minimum(place_b, len(both) - 1)] == b if len(both) else np.zeros(len(b), bool)
    for low in range(0, len(both), _COLUMNS):
        sides = []
        for place, of, rows, known in ((place_a, of_a, rows_a, known_a), (place_b, of_b, rows_b, known_b)):
            here = known & (place >= low) & (place < low + _COLUMNS)
            side = np.zeros((rows, min(_COLUMNS, len(both) - low)), np.float32)
            side[of[here], place[here] - low] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def _tile_links(members: DataFrame, docs: DataFrame, size: int, least: float) -> DataFrame:
    """(a, b): links of the least similarity between members (bucket, doc, n, root) of a bucket with different roots,
    enough of them to join whatever all such links would. A text goes to as many pairs of tiles as its bucket has tiles."""
    named = members.select(F.col("doc").alias("doc_id")).distinct()
    sets = cut(_shingle_sets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(named, "doc_id", "left_semi"), size).dropDuplicates(["doc"]), "shingles")
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(TILE * 0.75), F.sum("n") / F.lit(TILE_SHINGLES * 0.75))).cast("long")
    sizes = members.groupBy("bucket").agg(parts.alias("parts"))
    placed = hot_join(members, sizes, "bucket").withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")))
    # a text is sent to its own tile and to the pairs of it with every other
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda q: F.struct(F.least("part", q).alias("p"), F.greatest("part", q).alias("q")))
    sent = placed.select("bucket", "doc", "root", "part", F.explode(others).alias("x")).select(F.xxhash64("bucket", "x.p", "x.q").alias("pair"), (F.col("part") != F.col("x.p")).cast("int").alias("side"), "doc", "root")
    sent = sent.join(sets, "doc")

    def half(rows: pa.Table) -> tuple[np.ndarray, ...]:
        lists = rows.column("shingles").combine_chunks()
        n = np.asarray(lists.value_lengths()).astype(np.int64)
        return rows.column("doc").to_numpy(), rows.column("root").to_numpy(), n, lists.flatten().to_numpy(), np.repeat(np.arange(len(n)), n)

    def run(pair: pa.Table) -> pa.Table:
        side = pair.column("side").to_numpy()
        one = half(pair.filter(pa.array(side == 0)))
        two = half(pair.filter(pa.array(side == 1))) if (side == 1).any() else one
        shared = _shared_counts(one[3], one[4], len(one[0]), two[3], two[4], len(two[0])).astype(np.float64)
        linked = shared >= least * (one[2][:, None] + two[2][None, :] - shared) - 1e-9
        linked &= one[1][:, None] != two[1][None, :]
        i, j = np.nonzero(linked)
        # one link for each pair of groups joins them
        _, first = np.unique(np.stack([one[1][i], two[1][j]], axis=1), axis=0, return_index=True)
        edges = forest(one[1][i[first]], two[1][j[first]])
        return pa.table({"a": pa.array(edges[:, 0], pa.int64()), "b": pa.array(edges[:, 1], pa.int64())})

    return sent.groupBy("pair").applyInArrow(run, "a long, b long")


def _sized(pairs: DataFrame, least: float) -> DataFrame:
    """(a, b) once each, a < b, without pairs whose sizes alone rule out the least similarity."""
    able = F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb") - 1e-9
    return pairs.where(able & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def first_of_similar(docs: DataFrame, shingle_words: int = 5, least: float = 0.8, radius: int = 3) -> DataFrame:
    """(doc_id): the smallest doc_id of each group of docs linked by a shingle similarity of least or more.

    doc_id is never null, and rows that share one share their text. Texts without words are one group. No
    rows in: no rows out.

    A bucket's members are first compared with its smallest one. What then still lies in different groups of a bucket is
    compared by tiles of it, all in a pair of tiles at once, and only links that join groups come out. So every
    retrieved pair is either compared or already in one group.
    """
    sketched = cut(_sketches(docs, shingle_words), "sketches")
    points = sketched.groupBy("whole", "n").agg(F.min(F.struct("doc", "fp", "bands")).alias("s"))
    points = cut(points.select("s.doc", "s.fp", "n", "s.bands").where("doc is not null"), "points")
    banded = points.select("doc", "n", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min(F.struct("doc", "n")).alias("s"), F.count(F.lit(1)).alias("members")).where("members > 1")
    # a large bucket is a skewed key here, which adaptive execution splits
    banded = cut(banded.join(shared.select("bucket", F.col("s.doc").alias("head"), F.col("s.n").alias("head_n")), "bucket"), "buckets")
    stars = banded.select(F.col("head").alias("a"), F.col("doc").alias("b"), F.col("head_n").alias("na"), F.col("n").alias("nb"))
    # a print stands for its smallest text, with which others of that print are compared
    prints = points.where("n > 0").groupBy("fp").agg(F.min(F.struct("doc", "n")).alias("s")).select("fp", "s.doc", "s.n")
    same = points.select("fp", F.col("doc").alias("b"), F.col("n").alias("nb")).join(prints.select("fp", F.col("doc").alias("a"), F.col("n").alias("na")), "fp")
    trees = fingerprint_links(prints, radius).toDF("fa", "fb").join(prints.select(F.col("fp").alias("fa"), F.col("doc").alias("a"), F.col("n").alias("na")), "fa").join(prints.select(F.col("fp").alias("fb"), F.col("doc").alias("b"), F.col("n").alias("nb")), "fb")
    columns = ["a", "b", "na", "nb"]
    tried = cut(_sized(stars.union(same.select(*columns)).union(trees.select(*columns)), least), "pairs")
    links = cut(_alike(tried, docs, shingle_words, least), "links")
    parts = cut(connected_components(links), "components")
    rooted = banded.select("bucket", "doc", "n").join(parts.withColumnRenamed("node", "doc"), "doc", "left").select("bucket", "doc", "n", F.coalesce("root", "doc").alias("root"))
    split = rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
    rooted = cut(hot_join(rooted, split, "bucket"), "split")
    found = cut(_tile_links(rooted, docs, shingle_words, least), "found")
    if found.limit(1).count():
        parts = cut(connected_components(links.union(found)), "components")
    return points.join(parts.where("node <> root").select(F.col("node").alias("doc")), "doc", "left_anti").select(F.col("doc").alias("doc_id"))
