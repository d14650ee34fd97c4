"""The tables of a star schema, an event log and a document store in the roles that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAJOR = ("ECONOMY", "PROMO", "STANDARD")
#: The views as SQL that DuckDB runs on the same tables.
SQL = {
    "obs": """select p_type as cls, p_type || '|' || p_brand as ident, o_custkey as customer, l_suppkey as supplier, l_quantity as value,
        case when l_quantity <= 10 then 1 else 0 end as label from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey
        where p_type in ('ECONOMY', 'PROMO', 'STANDARD')""",
    "acts": """select event_id as row_id, user_id as ctx, event_type as cls, event_type || '|' || props as ident, value, case when value <= 10 then 1 else 0 end as label,
        case user_id % 5 when 0 then 'nM' when 1 then 'uM' when 2 then 'pM' when 3 then 'mg/mL' else ' NM ' end as units,
        case event_id % 7 when 0 then '<' when 1 then '>' when 2 then '<=' when 3 then '>=' else '=' end as relation,
        case event_id % 9 when 0 then 'Cmax' else 'IC 50' end as kind from events""",
    "scored": """select event_id as row_id, event_type as grp, case when value <= 10 then 1 else 0 end as label, (user_id * 7 % 23) / 23.0::double as score from events""",
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of the major part types: class, nested identity, exact context (customer, supplier), value, label."""
    part = _read(spark, sf_dir, "part").where(F.col("p_type").isin(*MAJOR)).select("p_partkey", "p_type", "p_brand")
    lines = _read(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_suppkey", "l_quantity")
    rows = lines.join(part, lines.l_partkey == part.p_partkey).join(_read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.col("p_type").alias("cls"), F.concat_ws("|", "p_type", "p_brand").alias("ident"), F.col("o_custkey").alias("customer"), F.col("l_suppkey").alias("supplier"), F.col("l_quantity").alias("value"), (F.col("l_quantity") <= 10).cast("int").alias("label")
    )


def acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events: class is their type, identity type and properties, context the user; units, relations and kinds are made
    from keys, so that every branch of the routing occurs."""
    by = lambda c, n, names, rest: F.coalesce(*[F.when(F.col(c) % n == k, F.lit(v)) for k, v in enumerate(names)], F.lit(rest))
    return _read(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"),
        F.col("user_id").alias("ctx"),
        F.col("event_type").alias("cls"),
        F.concat_ws("|", "event_type", "props").alias("ident"),
        "value",
        (F.col("value") <= 10).cast("int").alias("label"),
        by("user_id", 5, ("nM", "uM", "pM", "mg/mL"), " NM ").alias("units"),
        by("event_id", 7, ("<", ">", "<=", ">="), "=").alias("relation"),
        by("event_id", 9, ("Cmax",), "IC 50").alias("kind"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a label and a score that has ties."""
    return _read(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), F.col("event_type").alias("grp"), (F.col("value") <= 10).cast("int").alias("label"), (F.col("user_id") * 7 % 23 / F.lit(23.0)).alias("score"))
