"""Measured rows: routing to a label or to the first reason against one, and collapsing repeated measurements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrastkit.functions.numeric import in_nm, threshold_label
from contrastkit.functions.text import first_filled

#: Why a row has no label, first reason first.
REASONS = ("non_potency_endpoint", "non_molar_or_missing_value", "ambiguous_censored_value")


def routed(rows: DataFrame, potency: Column, relation: str = "relation", value: str = "value_numeric", units: str = "units", threshold: float = 10.0) -> DataFrame:
    """rows with value_nm, label and reason: the label, or else the first reason why there is none."""
    own = F.coalesce(F.nullif(F.btrim(F.col(relation)), F.lit("")), F.lit("="))
    out = rows.withColumn("value_nm", in_nm(F.col(value), F.col(units))).withColumn("label", threshold_label(own, F.col("value_nm"), threshold))
    reason = F.when(~F.coalesce(potency, F.lit(False)), REASONS[0]).when(F.col("value_nm").isNull(), REASONS[1]).when(F.col("label").isNull(), REASONS[2])
    out = out.withColumn("reason", reason)
    return out.withColumn("label", F.when(F.col("reason").isNull(), F.col("label")))


def usable(rows: DataFrame) -> DataFrame:
    return rows.where("reason is null").drop("reason")


def excluded(rows: DataFrame) -> DataFrame:
    return rows.where("reason is not null")


def exclusion_counts(rows: DataFrame) -> DataFrame:
    """(reason, rows), most frequent first."""
    return excluded(rows).groupBy("reason").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "reason")


def collapsed(rows: DataFrame, keys: Sequence[str], value: str, label: str, row_id: str, keep: Sequence[str], source_id: str) -> DataFrame:
    """One row for each key: the columns `keep` of the row of least value (ties: least row_id), that value, 1 if any label
    is, how many rows there were, whether their labels conflict, and their source ids in row order."""
    least = F.min_by(F.struct(*[F.col(c) for c in (*keep, value)]), F.struct(F.col(value).alias("value"), F.col(row_id).alias("row_id")))
    ids = F.transform(F.array_sort(F.collect_list(F.struct(F.col(row_id).alias("r"), F.col(source_id).cast("string").alias("s")))), lambda x: x["s"])
    out = rows.groupBy(*keys).agg(
        least.alias("kept"),
        F.max(label).alias(label),
        F.count(F.lit(1)).alias("source_rows"),
        (F.min(label) != F.max(label)).cast("int").alias("has_conflicting_labels"),
        F.array_join(ids, ";").alias("source_ids"),
    )
    return out.select(*keys, *[F.col(f"kept.{c}").alias(c) for c in (*keep, value)], label, "source_rows", "has_conflicting_labels", "source_ids")


def conflicts(rows: DataFrame, keys: Sequence[str], value: str, label: str, row_id: str) -> DataFrame:
    """Keys whose rows have both labels: the labels and values in row order, most rows first."""
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(row_id).alias("r"), F.col(c).cast("string").alias("s")))), lambda x: x["s"]), ";")
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("source_rows"), F.sort_array(F.collect_set(F.col(label))).cast("array<string>").alias("labels"), ordered(value).alias("values"))
    out = out.where(F.size("labels") > 1).withColumn("labels", F.array_join("labels", ","))
    return out.orderBy(F.desc("source_rows"), *keys)


def units(rows: DataFrame, context: Sequence[str], cls: str, ident: str, label: str, value: str | None = None, source: str | None = None, weight: str | None = None) -> DataFrame:
    """One row for each context, class and identity: how its observations respond.

    value: its least is kept; source: counted distinct; weight: rows that an observation stands for, summed.
    """
    own = [
        F.count(F.lit(1)).alias("n_observations"),
        F.sum(F.col(label)).cast("long").alias("positives"),
        (F.count(F.lit(1)) - F.sum(F.col(label))).cast("long").alias("negatives"),
        F.avg(F.col(label)).alias("response_rate"),
        F.max(label).alias("response_any"),
        F.min(label).alias("response_all"),
        (F.count(F.lit(1)) > 1).cast("int").alias("repeated"),
        (F.min(label) != F.max(label)).cast("int").alias("discordant"),
    ]
    if value:
        own.append(F.min(value).alias("value_min"))
    if source:
        own.append(F.count_distinct(F.nullif(F.col(source).cast("string"), F.lit(""))).alias("unique_sources"))
    if weight:
        own.append(F.sum(F.coalesce(F.col(weight), F.lit(1))).cast("long").alias("source_rows"))
    return rows.groupBy(*context, F.col(cls).alias("cls"), F.col(ident).alias("ident")).agg(*own)


def context_key(key: str, *parts: str) -> Column:
    """The given key, or where it is blank the parts joined for display."""
    return first_filled(F.col(key), F.concat_ws(" || ", *[F.coalesce(F.col(p), F.lit("")) for p in parts]), otherwise="")
