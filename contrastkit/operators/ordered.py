"""Places, running sums and order statistics over whole tables, without a task that holds all rows of a group.

Rows are dealt to tasks by ranges of their order and written once; sums run within a range, and the sums of the ranges
before it, one row for each group and range, are added.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrastkit.session import cut

#: Values of a group that are sorted in one task, and parts that the values between two bounds are counted in.
SORTED, BINS = 1 << 14, 256


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on keys in which null equals null; the right side's keys go."""
    own = right.select(*[F.col(f"`{c}`").alias(f"_right_{c}") if c in keys else F.col(f"`{c}`") for c in right.columns])
    same = F.lit(True)
    for c in keys:
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"`_right_{c}`"))
    return left.join(own, same, how).drop(*[f"_right_{c}" for c in keys])


def running(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], sums: Mapping[str, str | Column]) -> DataFrame:
    """rows with a column for each of sums: its sum over the rows of the same `by` up to and with this one, in `order`.

    The order should be total; rows that tie in it are taken in any order. Sums are whole numbers or doubles; nulls add
    nothing. The rows are written to the scratch folder, so this runs at once. No rows in: no rows out.
    """
    names = list(sums)
    values = {f"_add_{name}": F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)) for name, c in sums.items()}
    ranged = rows.withColumns(values).repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id())
    ranged = cut(ranged, "ranges")
    keys = [*by, "_range"]
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*keys).agg(*[F.sum(f"_add_{name}").alias(f"_all_{name}") for name in names])
    starts = totals.select(*keys, *[F.coalesce(F.sum(f"_all_{name}").over(before), F.lit(0)).alias(f"_before_{name}") for name in names])
    placed = ranged.withColumns({name: F.sum(f"_add_{name}").over(within) for name in names})
    placed = null_safe(placed, starts, keys)
    placed = placed.withColumns({name: F.col(name) + F.col(f"_before_{name}") for name in names})
    return placed.drop("_range", *values, *[f"_before_{name}" for name in names])


def with_row_id(df: DataFrame, order: Sequence[str], name: str = "row_id") -> DataFrame:
    """df with a dense number from 1 by the given total order."""
    return running(df, [], order, {name: F.lit(1)})


def order_statistics(rows: DataFrame, by: Sequence[str], value: str, statistics: Mapping[str, tuple[str, float]]) -> DataFrame:
    """(by, one column for each statistic): ("linear", q) interpolates at place q * (n - 1) of the sorted values,
    ("floor", q) takes the value at the place below it. Nulls are left out; a group without values has no row. NaN is
    above all numbers.

    Nothing is sorted as a whole. Rows are counted by value; then each wanted place is closed in on: the values between two
    bounds are counted in BINS equal parts, and the part that holds the place gives the next bounds, until SORTED values
    are left, which are put in order.
    """
    keys = list(by) or ["_k"]
    own = rows.where(F.col(value).isNotNull()).select(*by, *([] if by else [F.lit(1).alias("_k")]), F.col(value).cast("double").alias("_v"))
    counted = cut(own.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")), "values")
    whole = counted.groupBy(*keys).agg(F.sum("_n").alias("_total"), F.count(F.lit(1)).alias("_d"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    exact = {name: F.lit(float(q)) * (F.col("_total") - 1) for name, (_, q) in statistics.items()}
    sides = [f(exact[name]) for name, (kind, _) in statistics.items() for f in ((F.floor, F.ceil) if kind == "linear" else (F.floor,))]
    state = cut(whole.withColumn("_place", F.explode(F.array_distinct(F.array(*[s.cast("long") for s in sides])))).withColumn("_below", F.lit(0).cast("long")), "bounds")
    inside = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    one = [*keys, "_place"]
    for even in itertools.cycle((True, False)):  # by turns in equal parts and in powers of two, for values of many magnitudes
        open_ = state.where(F.col("_d") > SORTED)
        if not open_.limit(1).count():
            break
        met = null_safe(counted, open_.select(*one, "_below", "_lo", "_hi", "_total"), keys).where(inside)
        share = F.nanvl((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2), F.lit(0.5))  # 0.5 with an infinite bound
        part = F.floor(share * BINS) if even else F.when(share > 0, BINS - 1 + F.ceil(F.log2(share))).otherwise(0)
        part = F.when(F.col("_v") == F.col("_lo"), 0).when(F.col("_v") == F.col("_hi"), BINS - 1).otherwise(F.greatest(F.lit(0), F.least(part, F.lit(BINS - 1))))
        binned = met.groupBy(*one, "_below", "_total", part.alias("_bin")).agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_d"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        found = _at_place(binned, one, "_bin").withColumn("_below", F.col("_upto") - F.col("_n"))
        closer = found.select(*state.columns)
        state = cut(state.where(F.col("_d") <= SORTED).unionByName(closer), "bounds", instead_of=[state])
    left = null_safe(counted, state.select(*one, "_below", "_lo", "_hi", "_total"), keys).where(inside)
    found = _at_place(left, one, "_v")
    at = lambda place: F.max(F.when(F.col("_place") == place.cast("long"), F.col("_v")))
    out = []
    for name, (kind, _) in statistics.items():
        low = F.floor(exact[name])
        if kind == "floor":
            out.append(at(low).alias(name))
        else:
            out.append((at(low) + F.max(exact[name] - low) * (at(F.ceil(exact[name])) - at(low))).alias(name))
    return found.groupBy(*keys).agg(*out).select(*by, *statistics)


def _at_place(counted: DataFrame, one: Sequence[str], order: str) -> DataFrame:
    """Of the rows of each (keys, _place), the one at which _below and the counts _n in order go beyond the place."""
    upto = F.col("_below") + F.sum("_n").over(Window.partitionBy(*one).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn("_upto", upto).where((F.col("_upto") > F.col("_place")) & (F.col("_upto") - F.col("_n") <= F.col("_place")))
