"""Class audits: sizes, distinct values, top values, degrees and functional dependencies. Blank counts as missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filled(column: str) -> Column:
    """The column with blanks as null, so that counts skip them."""
    return F.nullif(F.col(column).cast("string"), F.lit(""))


def unique_counts(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the distinct filled values of each column."""
    return rows.agg(*[F.count_distinct(filled(c)).alias(f"unique_{c}") for c in columns])


def top_values(rows: DataFrame, group: str, column: str, k: int, row_id: str) -> DataFrame:
    """(group, column, n, place): the k most frequent values in each group; ties go to what appears first."""
    counted = rows.groupBy(group, column).agg(F.count(F.lit(1)).alias("n"), F.min(row_id).alias("_first"))
    order = Window.partitionBy(group).orderBy(F.desc("n"), "_first")
    return counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("_first")


def class_summary(rows: DataFrame, cls: str, ident: str, uniques: Sequence[str], row_id: str, unit: str | None = None, top: int = 4) -> DataFrame:
    """For each class: rows, distinct filled values, the top identity and its share, and with `unit` the rows in nM and
    in molar units and the top units as "unit:n"."""
    counts = [F.count(F.lit(1)).alias("n_rows"), *[F.count_distinct(filled(c)).alias(f"unique_{c}") for c in uniques]]
    if unit:
        lower = F.lower(F.btrim(F.col(unit)))
        counts += [F.count_if(lower == "nm").alias("nm_rows"), F.count_if(lower.isin("pm", "nm", "um", "µm", "μm")).alias("molar_rows")]
    out = rows.groupBy(cls).agg(*counts)
    first = top_values(rows, cls, ident, 1, row_id).select(cls, F.col(ident).alias("top_identity"), F.col("n").alias("top_identity_rows"))
    out = out.join(first, cls).withColumn("top_identity_share", F.col("top_identity_rows") / F.col("n_rows"))
    if unit:
        ordered = top_values(rows, cls, unit, top, row_id).groupBy(cls).agg(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(":", F.coalesce(F.nullif(F.col(unit), F.lit("")), F.lit("<blank>")), "n").alias("t")))).alias("u"))
        out = out.join(ordered.select(cls, F.array_join(F.col("u.t"), ", ").alias("top_units")), cls)
    return out


def pair_counts(rows: DataFrame, a: str, b: str, row_id: str) -> DataFrame:
    """(a, b, n): most frequent first, ties by first appearance."""
    return rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"), F.min(row_id).alias("_first")).orderBy(F.desc("n"), "_first").drop("_first")


def key_degrees(rows: DataFrame, key: str, cls: str, skip_blank: bool = True) -> DataFrame:
    """(key, degree, n_rows, classes): how many classes each key is found in."""
    own = rows.where(filled(key).isNotNull()) if skip_blank else rows
    return own.groupBy(key).agg(F.count_distinct(cls).alias("degree"), F.count(F.lit(1)).alias("n_rows"), F.array_join(F.array_sort(F.collect_set(cls)), "; ").alias("classes"))


def degree_distribution(degrees: DataFrame) -> DataFrame:
    """(degree, keys): how many keys are in how many classes."""
    return degrees.groupBy("degree").agg(F.count(F.lit(1)).alias("keys")).orderBy("degree")


def dependency(rows: DataFrame, ident: str, cls: str) -> DataFrame:
    """One row: identities, those in one class and in several, and the share in one (null if there are none)."""
    own = rows.where(filled(ident).isNotNull()).groupBy(ident).agg(F.count_distinct(cls).alias("classes"))
    return own.agg(F.count(F.lit(1)).alias("identities"), F.count_if(F.col("classes") == 1).alias("single"), F.count_if(F.col("classes") > 1).alias("multiple")).withColumn(
        "single_share", F.try_divide(F.col("single").cast("double"), F.col("identities"))
    )


def imbalance(rows: DataFrame, cls: str) -> DataFrame:
    """One row: the largest class over the smallest."""
    sizes = rows.groupBy(cls).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n").alias("largest"), F.min("n").alias("smallest")).withColumn("ratio", F.try_divide(F.col("largest").cast("double"), F.col("smallest")))


def rows_in_shared_keys(rows: DataFrame, key: str, cls: str) -> DataFrame:
    """(cls, n): rows whose key is found in several classes."""
    shared = key_degrees(rows, key, cls).where("degree > 1").select(key)
    return rows.join(shared, key, "left_semi").groupBy(cls).agg(F.count(F.lit(1)).alias("n"))


def effective_number(rows: DataFrame, group: str, column: str) -> DataFrame:
    """(group, effective_n): the exponential of the Shannon entropy of a column's values in each group."""
    counted = rows.groupBy(group, column).agg(F.count(F.lit(1)).alias("n"))
    entropy = F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")
    return counted.groupBy(group).agg(F.exp(entropy).alias("effective_n"))


def modelling_summary(rows: DataFrame, cls: str, ident: str, label: str, others: Sequence[str], row_id: str) -> DataFrame:
    """For each class: observations, positives, prevalence, distinct values (here a blank is one), the effective number
    of identities, and the top identity with its share."""
    present = lambda c: F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("")))
    out = rows.groupBy(cls).agg(
        F.count(F.lit(1)).alias("observations"),
        F.sum(label).cast("long").alias("positives"),
        F.avg(label).alias("prevalence"),
        present(ident).alias("unique_identities"),
        *[present(c).alias(f"unique_{c}") for c in others],
    )
    top = top_values(rows, cls, ident, 1, row_id).select(cls, F.col(ident).alias("top_identity"), F.col("n").alias("top_identity_rows"))
    out = out.join(effective_number(rows, cls, ident), cls).join(top, cls)
    return out.withColumn("top_identity_share", F.col("top_identity_rows") / F.col("observations"))


def prevalence(rows: DataFrame, label: str) -> DataFrame:
    """One row; null on no rows."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("prevalence"))


# A generic audit of any table: required columns are checked, others may be left out.


def checked(rows: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return rows


def value_counts(rows: DataFrame, column: str, missing: str = "<missing>") -> DataFrame:
    value = F.coalesce(F.col(column).cast("string"), F.lit(missing))
    return rows.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")


def identities_by_class(rows: DataFrame, cls: str, ident: str) -> DataFrame:
    """(cls, identities): a null class is kept, null identities are not counted."""
    return rows.groupBy(cls).agg(F.count_distinct(ident).alias("identities"))


def single_class_share(rows: DataFrame, cls: str, ident: str) -> DataFrame:
    """One row: the share of identities in exactly one class; rows with a null are left out."""
    own = rows.select(cls, ident).dropna().distinct().groupBy(ident).agg(F.count(F.lit(1)).alias("classes"))
    return own.agg(F.count(F.lit(1)).alias("identities"), F.avg((F.col("classes") == 1).cast("double")).alias("single_share"))


def shared_keys(rows: DataFrame, key: str, cls: str) -> DataFrame:
    """One row: keys found, and those in more than one class; null keys are left out."""
    own = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(cls).alias("classes"))
    return own.agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("classes") > 1).alias("shared"))


def generic_audit(rows: DataFrame, cls: str, ident: str, optional: Sequence[str] = ()) -> dict[str, DataFrame]:
    """All of the generic audit; optional columns that the table lacks are skipped."""
    checked(rows, (cls, ident))
    out = {"classes": value_counts(rows, cls), "identities": identities_by_class(rows, cls, ident), "dependency": single_class_share(rows, cls, ident)}
    return out | {f"shared_{c}": shared_keys(rows, c, cls) for c in optional if c in rows.columns}
