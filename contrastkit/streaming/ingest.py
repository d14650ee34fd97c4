"""Measured rows as they arrive: the row-wise operators run unchanged on a stream of activity files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from contrastkit.functions.text import contains_any
from contrastkit.operators.measurements import routed
from contrastkit.sources.tables import ACTIVITY


def activity_stream(spark: SparkSession, path: str, columns: tuple[str, ...] = tuple(ACTIVITY)) -> DataFrame:
    """Delimited activity files of a folder, each read when it appears; all columns are text."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    return spark.readStream.schema(schema).option("header", True).option("escape", '"').csv(path).na.fill("")


def routed_stream(rows: DataFrame, threshold: float = 10.0) -> DataFrame:
    """rows with value_nm, label and reason, as in a batch."""
    potency = (F.col("is_potency_endpoint") == "1") | contains_any(F.col("standard_type"))
    return routed(rows, potency, threshold=threshold)


def write_routed(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Usable and excluded rows to two tables below `out`, both from one pass over each batch; ends when all is read."""

    def both(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).withColumn("kind", F.when(F.col("reason").isNull(), "usable").otherwise("excluded")).write.mode("append").partitionBy("kind").parquet(out)

    return rows.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
