"""Contingency tables, association and overlap of classes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contingency(rows: DataFrame, a: str, b: str, values: Sequence[str] | None = None) -> DataFrame:
    """A row for each value of a and a column for each of b, zeros included. values: the columns, if known."""
    grouped = rows.groupBy(a)
    return (grouped.pivot(b, list(values)) if values else grouped.pivot(b)).count().na.fill(0)


def associations(rows: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """(association, cramers_v, right_unique_values) for named pairs of columns, in one pass.

    Chi-squared over n is the sum of o * o / (row * column) - 1, so only cells that occur are looked at. V is null where
    a side has one value. A blank is a value for V; right_unique_values leaves blanks out.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    sides = F.explode(F.array(*[F.struct(F.lit(name).alias("association"), text(a).alias("a"), text(b).alias("b")) for name, (a, b) in pairs.items()]))
    cells = rows.select(sides.alias("s")).select("s.*").groupBy("association", "a", "b").agg(F.count(F.lit(1)).alias("o"))
    left = cells.groupBy("association", "a").agg(F.sum("o").alias("na"))
    right = cells.groupBy("association", "b").agg(F.sum("o").alias("nb"))
    met = cells.join(left, ["association", "a"]).join(right, ["association", "b"])
    whole = met.groupBy("association").agg(
        F.sum(F.col("o") * F.col("o") / (F.col("na").cast("double") * F.col("nb"))).alias("s"),
        F.count_distinct("a").alias("ka"),
        F.count_distinct("b").alias("kb"),
        F.count_distinct(F.nullif(F.col("b"), F.lit(""))).alias("right_unique_values"),
    )
    least = F.least("ka", "kb") - 1
    v = F.sqrt(F.greatest(F.col("s") - 1, F.lit(0.0)) / F.nullif(least, F.lit(0)))
    return whole.select("association", v.alias("cramers_v"), "right_unique_values")


def overlap(rows: DataFrame, context: Sequence[str], cls: str, ident: str, label: str) -> DataFrame:
    """For each context, blank or not: its classes, observations, identities, and whether its labels vary."""
    return rows.groupBy(*context).agg(
        F.count_distinct(cls).alias("degree"),
        F.count(F.lit(1)).alias("observations"),
        F.count_distinct(ident).alias("identities"),
        (F.min(label) != F.max(label)).cast("int").alias("has_label_variation"),
        F.array_join(F.array_sort(F.collect_set(cls)), "; ").alias("classes"),
    )


def crossed(overlaps: DataFrame, context: Sequence[str]) -> DataFrame:
    """Contexts of more than one class: most classes first, then most observations."""
    return overlaps.where("degree > 1").orderBy(F.desc("degree"), F.desc("observations"), *context)


def shared_contexts(rows: DataFrame, context: Sequence[str], cls: str, skip_blank: bool = False) -> DataFrame:
    """(class_a, class_b, shared): contexts that two classes share, zero for those that share none."""
    own = rows
    if skip_blank:
        for c in context:
            own = own.where(F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
    held = own.select(*context, F.col(cls).alias("cls")).distinct()
    classes = held.select("cls").distinct()
    every = classes.select(F.col("cls").alias("class_a")).join(classes.select(F.col("cls").alias("class_b")), F.col("class_a") < F.col("class_b"))
    left, right = held.withColumnRenamed("cls", "class_a"), held.withColumnRenamed("cls", "class_b")
    for c in context:
        right = right.withColumnRenamed(c, f"_{c}")
    same = F.col("class_a") < F.col("class_b")
    for c in context:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    met = left.join(right, same).groupBy("class_a", "class_b").agg(F.count(F.lit(1)).alias("shared"))
    return every.join(met, ["class_a", "class_b"], "left").na.fill(0, ["shared"])
