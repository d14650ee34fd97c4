"""SimHash near-duplicates (operator 6): BK-trees over shards of fingerprints.

Two fingerprints that differ in at most r bits agree on at least two of r + 2 bit blocks, so each pair of blocks and
its bits name a shard, and every link lies in some shard. A shard's distinct fingerprints go into a BK-tree whose
children are keyed by their Hamming distance to the parent; a search follows only edges within the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrastkit.llm.common import cut, hot_join, shuffle_partitions, text_slices, word_spans
from contrastkit.llm.components import connected_components

#: Largest shard that one tree takes; larger ones are split on further bits.
SHARD_CAP = 1024
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(uint64 hash, row) of each shingle, repeated ones included; a text of fewer words is one shingle."""
    rows = len(offsets) - 1
    start, end, row = word_spans(data, offsets)
    if not len(start):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    flat = _LOWER[data]
    keep = np.zeros(len(flat), dtype=bool)
    spans = np.zeros(len(flat) + 1, dtype=np.int32)
    np.add.at(spans, start, 1)
    np.add.at(spans, end, -1)
    keep[:] = np.cumsum(spans[:-1]) > 0
    later = start[1:][row[1:] == row[:-1]]
    flat[later - 1] = 32
    keep[later - 1] = True
    place = np.cumsum(keep) - 1
    first, last = place[start], place[end - 1] + 1
    text = flat[keep].tobytes()
    count = np.bincount(row, minlength=rows)
    begin = np.concatenate([[0], np.cumsum(count)])
    position = np.arange(len(row)) - begin[row]
    whole = count[row] < size
    heads = np.flatnonzero(np.where(whole, position == 0, position <= count[row] - size))
    tails = np.where(whole[heads], begin[row[heads] + 1] - 1, heads + size - 1)
    take, seed = xxhash.xxh64_intdigest, 42
    hashes = np.fromiter((take(text[a:b], seed) for a, b in zip(first[heads].tolist(), last[tails].tolist())), dtype=np.uint64, count=len(heads))
    return hashes, row[heads]


def _fingerprints(data: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """uint64 fingerprint of each text; 0 where it has no word."""
    return majority_bits(*shingle_hashes(data, offsets, size), len(offsets) - 1)


def majority_bits(hashes: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """uint64 of each row: the bits that more than half of its hashes have; 0 where it has none."""
    if not len(hashes):
        return np.zeros(rows, dtype=np.uint64)
    ones = np.zeros((rows, 64), dtype=np.int64)
    for a in range(0, len(hashes), 1 << 17):
        part, of = hashes[a : a + (1 << 17)], owner[a : a + (1 << 17)]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        ones[of[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
    shingles = np.bincount(owner, minlength=rows)
    packed = np.packbits(ones * 2 > shingles[:, None], axis=1)
    return packed.reshape(-1).view(">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of every whole text as a signed bigint. Null, empty or blank text: 0."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ids, texts = batch.column(0), batch.column(1)
            for a, b, data, offsets in text_slices(texts, 2 << 20):
                fp = _fingerprints(data, offsets, shingle_words).view(np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Children keyed by integer Hamming distance to their parent; searches follow edges within the radius only."""

    def __init__(self) -> None:
        self.items: list[int] = []
        self.edges: list[dict[int, int]] = []

    def add(self, item: int) -> int:
        place = len(self.items)
        self.items.append(item)
        self.edges.append({})
        at = 0
        while place:
            far = (self.items[at] ^ item).bit_count()
            if (onward := self.edges[at].get(far)) is None:
                self.edges[at][far] = place
                break
            at = onward
        return place

    def within(self, item: int, radius: int) -> list[int]:
        found, stack = [], [0] if self.items else []
        while stack:
            at = stack.pop()
            far = (self.items[at] ^ item).bit_count()
            if far <= radius:
                found.append(at)
            edges = self.edges[at]
            if len(edges) <= 2 * radius + 1:
                stack += [k for d, k in edges.items() if abs(d - far) <= radius]
            else:
                stack += [edges[d] for d in range(far - radius, far + radius + 1) if d in edges]
        return found


def _forest(items: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that hold a shard's components together: each item against the tree of those before it."""
    if len(items) == 2:  # a root and one edge
        return [(items[0], items[1])] if (items[0] ^ items[1]).bit_count() <= radius else []
    tree, parent, links = BKTree(), list(range(len(items))), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, item in enumerate(items):
        for near in tree.within(item, radius):
            a, b = root(near), root(k)
            if a != b:
                parent[b] = a
                links.append((items[near], item))
        tree.add(item)
    return links


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _block_columns(bits: list[int], blocks: int) -> list[list[int]]:
    size, more = divmod(len(bits), blocks)
    out, at = [], 0
    for k in range(blocks):
        width = size + (k < more)
        out.append(bits[at : at + width])
        at += width
    return out


def _mask(bits: list[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def _shards(points: DataFrame, radius: int, cap: int) -> DataFrame:
    """(shard, fp): rows of shards with 2 to cap fingerprints; a larger shard is split on two more blocks of its bits."""
    blocks = radius + 2

    def level(chosen: list[int]) -> list[list[int]]:
        rest = [b for b in range(64) if b not in set(chosen)]
        parts = _block_columns(rest, blocks)
        return [sorted(chosen + x + y) for x, y in combinations(parts, 2)]

    masks = level([])
    todo, done = points.select("fp"), None
    keyed = todo.select("fp", F.explode(F.array(*[F.lit(_mask(m)) for m in masks])).alias("mask"))
    while True:
        keyed = keyed.withColumn("shard", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))
        keyed = cut(keyed, "shards")
        counted = keyed.groupBy("shard").count()
        fit = keyed.join(counted.where((F.col("count") > 1) & (F.col("count") <= cap)), "shard", "left_semi").select("shard", "fp")
        done = fit if done is None else done.union(fit)
        hot = keyed.join(counted.where(F.col("count") > cap), "shard", "left_semi").select("mask", "fp")
        used = [r[0] & ((1 << 64) - 1) for r in hot.select("mask").distinct().collect()]  # of a fixed family, not of the data
        if not used:
            return done
        finer = [(_signed(m), _mask(x)) for m in used for x in level([b for b in range(64) if m >> b & 1])]
        onward = F.broadcast(points.sparkSession.createDataFrame(finer, "mask long, finer long"))
        keyed = hot.join(onward, "mask").select("fp", F.col("finer").alias("mask"))


def fingerprint_links(points: DataFrame, radius: int = 2, cap: int = SHARD_CAP) -> DataFrame:
    """(a, b): pairs of fp at Hamming distance 1 to radius that join the same components as all such pairs do."""
    n = shuffle_partitions(points.sparkSession)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []
        at = None
        for batch in rows:
            links: list[tuple[int, int]] = []
            for shard, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if shard != at:
                    links += _forest(held, radius)
                    held, at = [], shard
                held.append(fp & ((1 << 64) - 1))
            yield _links(links)
        yield _links(_forest(held, radius))

    def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([_signed(x[k]) for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    shards = _shards(points, radius, cap).repartition(n, "shard").sortWithinPartitions("shard", "fp")
    return shards.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle_words: int = 3, radius: int = 2, cap: int = SHARD_CAP) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of docs.

    Fingerprints link at radius or fewer differing bits; component_id is the smallest doc_id reachable. Null and blank
    texts have fingerprint 0 and link like any other. A null doc_id stays null and never names a component unless all
    of its members are null. Repeated rows are returned as often as they come. No rows in: no rows out.
    """
    prints = cut(fingerprints(docs, shingle_words), "prints")
    points = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = fingerprint_links(points, radius, cap)
    parts = cut(connected_components(links), "components")
    named = points.join(parts.withColumnRenamed("node", "fp"), "fp", "left")
    named = cut(named.select("fp", "least", F.coalesce("root", "fp").alias("root")), "named")
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = hot_join(named, lowest, "root").select("fp", "component_id")
    named = hot_join(prints, named, "fp")  # equal fingerprints may be a third of all rows
    return named.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
