"""Best-fit packing (operator 3): vector best-fit over bins with token, document-count and attention-cost capacities.

Pieces of one length are alike, so packing needs only how many pieces there are of each length: at most `tokens`
counts, however large the corpus. Bins in the same state (the same residual capacities) are kept as one class with a
multiplicity. Lengths are placed longest first, each into the class that the score prefers among all those with room
in every capacity. The plan that comes out gives ranges of ranks per length; pieces are ranked by Spark and look their
range up. A piece as long as a bin fills one by itself, and needs neither rank nor plan.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from contrastkit.llm.bpe import token_ids
from contrastkit.llm.common import cut

#: Id put after each document.
END = 0
#: Pieces of one length that are ranked together, as expected.
RANKED = 4096


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds: tokens, documents, and attention cost (the sum of squared piece lengths).

    weights are those of the three in the score, of shares of the capacities: "norm" prefers the bin with the least
    weighted residual norm after placing, "dot" the one with the largest weighted dot-product of demand and residual.
    Ties go to the bin with the fewest residual tokens.
    """

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.25, 0.25)
    score: str = "norm"


def token_pieces(docs: DataFrame, tokenizer: str, most: int) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32, alone): every document's ids and a final id 0, in pieces of at most most.

    A document of more than most ids has all its pieces full but the first. Null text is empty: one piece with id 0.
    row tells rows apart that share a doc_id; alone numbers full pieces by negative numbers, and is null for others.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = 0  # of this task, whose rows share the bits of row above the 33rd
        for batch in rows:
            out: list[tuple] = []
            for doc, row, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                ids = token_ids(tokenizer, text or "")
                ids.append(END)
                raw, n = memoryview(np.frombuffer(ids, dtype="<u4").tobytes()), len(ids)
                first = n % most or most
                edges = [0, *range(first, n + 1, most)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    alone = None
                    if b - a == most:
                        alone, full = -1 - ((row >> 33 << 33) + full), full + 1
                    out.append((doc, row, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b]), alone))
            columns = list(zip(*out)) if out else [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=["doc_id", "row", "piece", "start", "length", "ids_crc32", "alone"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(run, "doc_id long, row long, piece int, start long, length long, ids_crc32 long, alone long")


class _Classes:
    """Open bins by state; states of the same residual tokens share a list, so the search goes from tight to loose."""

    def __init__(self, capacity: Capacity) -> None:
        self.capacity = capacity
        #: residual tokens -> list of [residual documents, residual attention, ranges of (first bin, number)]
        self.by_tokens: dict[int, list[tuple[int, int, int, int]]] = {}
        self.filled: list[int] = []  # sorted residual token counts in use

    def put(self, tokens: int, documents: int, attention: int, first: int, number: int) -> None:
        if tokens <= 0 or documents <= 0 or attention <= 0:
            return
        if tokens not in self.by_tokens:
            self.by_tokens[tokens] = []
            self.filled.insert(bisect_right(self.filled, tokens), tokens)
        self.by_tokens[tokens].append((documents, attention, first, number))

    def best(self, length: int) -> tuple[int, int] | None:
        """(residual tokens, place in its list) of the bins that the score prefers for a piece of this length."""
        c = self.capacity
        caps, demand = (c.tokens, c.documents, c.attention), (length, 1, length * length)
        chosen, least = None, None
        start = bisect_right(self.filled, length - 1)
        by_tokens = c.weights[0] / c.tokens**2
        for tokens in self.filled[start:]:
            if c.score == "norm" and least is not None and by_tokens * (tokens - length) ** 2 >= least:
                break  # what is left of the tokens alone costs more in all bins from here on
            for k, (documents, attention, _, _) in enumerate(self.by_tokens[tokens]):
                if attention < demand[2]:
                    continue
                residual = (tokens, documents, attention)
                if c.score == "norm":
                    cost = sum(w * ((r - d) / m) ** 2 for w, r, d, m in zip(c.weights, residual, demand, caps))
                else:
                    cost = -sum(w * r * d / m / m for w, r, d, m in zip(c.weights, residual, demand, caps))
                if least is None or cost < least:
                    chosen, least = (tokens, k), cost
        return chosen

    def take(self, tokens: int, k: int) -> tuple[int, int, int, int]:
        own = self.by_tokens[tokens]
        found = own.pop(k)
        if not own:
            del self.by_tokens[tokens]
            self.filled.remove(tokens)
        return found


def plan_bins(counts: dict[int, int], capacity: Capacity) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, number, first bin, offset): ranks of pieces of a length that go to consecutive bins."""
    if any(x > capacity.tokens or x * x > capacity.attention for x in counts):
        raise ValueError("a piece is over the capacity of a bin")
    classes, plan, bins = _Classes(capacity), [], 0
    waiting = [(-length, 0, n) for length, n in counts.items() if n]
    heapq.heapify(waiting)
    while waiting:
        minus, rank, left = heapq.heappop(waiting)
        length = -minus
        while left:
            found = classes.best(length)
            if found is None:  # as many pieces as fit go into each of some new bins
                each = min(capacity.tokens // length, capacity.documents, capacity.attention // (length * length), left)
                number = left // each
                for k in range(each):
                    plan.append((length, rank, number, bins, k * length))
                    rank += number
                classes.put(capacity.tokens - each * length, capacity.documents - each, capacity.attention - each * length * length, bins, number)
                bins += number
                left -= each * number
                continue
            tokens = found[0]
            documents, attention, first, number = classes.take(*found)
            each = min(tokens // length, documents, attention // (length * length), left)
            used = min(number, left // each)
            for k in range(each):
                plan.append((length, rank, used, first, capacity.tokens - tokens + k * length))
                rank += used
            left -= each * used
            classes.put(tokens - each * length, documents - each, attention - each * length * length, first, used)
            classes.put(tokens, documents, attention, first + used, number - used) if number > used else None
    return plan


def packed_pieces(pieces: DataFrame, capacity: Capacity = Capacity()) -> DataFrame:
    """The pieces with sequence_id and offset: their place in a bin. Bins are gapless from offset 0.

    pieces has doc_id, row, piece and length. No pieces in: no rows out.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # one row per length, tokens at most
    parts = F.broadcast(spark.createDataFrame([(x, n // RANKED + 1) for x, n in counts.items()], "length long, parts long"))
    parted = pieces.join(parts, "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "row", "piece"), F.col("parts"))).drop("parts")
    counted = cut(parted.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranges: dict[int, list[tuple[int, int, int]]] = {}
    for length, rank, _, first, offset in plan_bins(counts, capacity):
        ranges.setdefault(length, []).append((rank, first, offset))
    columns = {x: tuple(np.array(v, dtype=np.int64) for v in zip(*sorted(own))) for x, own in ranges.items()}
    looked_up = spark.sparkContext.broadcast(columns)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = looked_up.value
        for batch in rows:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length).tolist():
                own = np.flatnonzero(length == x)
                first_rank, first_bin, at = plan[x]
                k = np.searchsorted(first_rank, rank[own], side="right") - 1
                sequence[own], offset[own] = first_bin[k] + rank[own] - first_rank[k], at[k]
            keep = [batch.column(name) for name in batch.schema.names if name != "rank"]
            names = [name for name in batch.schema.names if name != "rank"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    order = Window.partitionBy("length", "part").orderBy("doc_id", "row", "piece")
    ranked = parted.withColumn("place", F.row_number().over(order)).join(starts, ["length", "part"])
    names = pieces.columns
    ranked = ranked.select(*names, (F.col("before") + F.col("place") - 1).cast("long").alias("rank"))
    return ranked.mapInArrow(run, StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())]))


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: Capacity = Capacity()) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece of every document and its place.

    Null and empty texts are one piece of one id. Rows that share a doc_id, or have none, are packed each for itself.
    Other columns of docs are not read. No rows in: no rows out.
    """
    pieces = cut(token_pieces(docs, tokenizer, capacity.tokens), "pieces")
    full = pieces.where(F.col("alone").isNotNull())
    if capacity.attention < capacity.tokens**2 and full.limit(1).count():
        raise ValueError("a piece is over the capacity of a bin")
    own = full.withColumn("sequence_id", F.col("alone")).withColumn("offset", F.lit(0).cast("long"))
    packed = packed_pieces(pieces.where(F.col("alone").isNull()), capacity)
    return packed.select(*own.columns).unionByName(own).drop("row", "alone")
