"""Assigning rows to folds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrastkit.operators.ordered import running

#: Groups of one size whose folds are kept in one row of the plan.
_BLOCK = 1 << 16


def _dealt(seed: int, row_id: str):
    """An order that two engines share: md5 of "seed:id"."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")).cast("binary"))


def stratified_folds(rows: DataFrame, label: str, row_id: str, k: int = 5, seed: int = 44) -> DataFrame:
    """rows with fold: in each label, hashed order dealt round-robin."""
    placed = running(rows, [label], [_dealt(seed, row_id), row_id], {"_place": F.lit(1)})
    return placed.withColumn("fold", ((F.col("_place") - 1) % k).cast("int")).drop("_place")


class _Folds:
    """The folds' sizes and positives while groups are placed."""

    def __init__(self, k: int, share: float) -> None:
        self.k, self.share = k, share
        self.n, self.p = np.zeros(k, np.int64), np.zeros(k, np.int64)

    def place(self, n: int, p: int, many: int) -> Iterator[np.ndarray]:
        """The folds of `many` groups of n rows and p positives, one after the other."""
        while many:
            if many < self.k or self.n.max() - self.n.min() >= n:
                size = self.n + n
                off = np.abs((self.p + p) / np.maximum(size, 1) - self.share)
                best = np.lexsort((np.arange(self.k), off, size))[:1]
                self.n[best] += n
                self.p[best] += p
                many -= 1
                yield best
                continue
            # no fold is a group ahead of another, so groups go round: each round takes every fold once, and all rounds
            # of a block are worked out together
            rounds = min(many // self.k, max(1, _BLOCK // self.k))
            done = np.arange(1, rounds + 1)[:, None]
            size, positive = self.n + done * n, self.p + done * p
            off = np.abs(positive / np.maximum(size, 1) - self.share)
            turn = np.broadcast_to(np.arange(self.k), size.shape)
            yield np.lexsort((turn, off, size), axis=1).reshape(-1)
            self.n, self.p = size[-1].copy(), positive[-1].copy()
            many -= rounds * self.k


def group_folds(rows: DataFrame, group: str, label: str, k: int = 5, seed: int = 44) -> DataFrame:
    """rows with fold: whole groups, largest first, each to the fold that is smallest with it; ties go to the fold whose
    prevalence comes nearest to that of all rows, then to the lower fold. Groups of one size and number of positives
    come in hashed order. A null group is a group.

    Each choice depends on those before, so one task makes them all. It reads how many groups there are of each size,
    not the groups, and streams out the folds of their ranks, 64 K ranks a row; groups look theirs up.
    """
    groups = rows.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n"), F.sum(label).cast("long").alias("_p"))
    ranked = running(groups, ["_n", "_p"], [_dealt(seed, "_g"), "_g"], {"_rank": F.lit(1)}).withColumn("_rank", F.col("_rank") - 1)
    sizes = ranked.groupBy("_n", "_p").agg(F.count(F.lit(1)).alias("many"))
    first = sizes.agg(F.try_divide(F.sum(F.col("_p") * F.col("many")).cast("double"), F.sum(F.col("_n") * F.col("many")))).first()[0]
    share = float(first or 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folds = _Folds(k, share)
        for batch in batches:
            for n, p, many in zip(*(batch.column(c).to_pylist() for c in ("_n", "_p", "many"))):
                held, at = np.zeros(0, np.int32), 0
                for chosen in folds.place(n, p, many):
                    held = np.concatenate([held, chosen.astype(np.int32)])
                    while len(held) >= _BLOCK or (at + len(held) == many and len(held)):
                        yield _plan_row(n, p, at // _BLOCK, held[:_BLOCK])
                        at += len(held[:_BLOCK])
                        held = held[_BLOCK:]

    plan = sizes.repartition(1).sortWithinPartitions(F.desc("_n"), F.desc("_p")).mapInArrow(run, "_n long, _p long, _block long, _folds array<int>")
    placed = ranked.withColumn("_block", F.floor(F.col("_rank") / _BLOCK)).join(plan, ["_n", "_p", "_block"])
    placed = placed.select("_g", F.get("_folds", (F.col("_rank") % _BLOCK).cast("int")).alias("fold"))
    return rows.join(placed, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def _plan_row(n: int, p: int, block: int, folds: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([x], pa.int64()) for x in (n, p, block)]
    return pa.RecordBatch.from_arrays([*columns, pa.array([folds], pa.list_(pa.int32()))], names=["_n", "_p", "_block", "_folds"])


def leave_one_group_folds(rows: DataFrame, group: str) -> DataFrame:
    """rows with fold: one for each group, in the order of their names; a null group comes first."""
    numbered = running(rows.select(F.col(group).alias("_g")).distinct(), [], ["_g"], {"_place": F.lit(1)})
    numbered = numbered.select("_g", (F.col("_place") - 1).cast("int").alias("fold"))
    return rows.join(numbered, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def fold_diagnostics(rows: DataFrame, label: str, uniques: list[str], group: str | None = None) -> DataFrame:
    """For each fold: rows, positives, prevalence, and distinct filled values."""
    filled = lambda c: F.count_distinct(F.nullif(F.col(c).cast("string"), F.lit("")))
    own = [filled(c).alias(f"unique_{c}") for c in uniques]
    if group:
        own.append(filled(group).alias("unique_groups"))
    return rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum(label).cast("long").alias("positives"), F.avg(label).alias("prevalence"), *own)
