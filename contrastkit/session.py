"""Session settings that the operators' results rely on, and the shared scratch folder for steps that are read again."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session(name: str = "contrastkit", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; settings are Spark options with underscores for dots."""
    builder = SparkSession.builder.appName(name)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in (defaults | {k.replace("_", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir. Where none is set, a temporary folder if Spark runs
    in this one process (local mode), and an error on a cluster, whose machines would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="contrastkit-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "step", instead_of: Sequence[DataFrame] = ()) -> DataFrame:
    """Write df to the shared scratch folder and read it back: the result survives lost executors and has no lineage.

    instead_of: tables that cut gave before and that nothing but df reads; their files go when df is written.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # the shuffles behind the table are not needed again
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    forget(*instead_of)
    return out


def _file_system(spark: SparkSession, path: str):
    """(file system, path) as Spark's own writers would take them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _file_system(spark, path)
    return system.exists(where)


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables that cut gave; other frames are left alone."""
    for table in tables:
        path = table.__dict__.pop("_scratch", None)
        if path:
            system, where = _file_system(table.sparkSession, path)
            system.delete(where, True)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """df dealt to at least as many tasks as there are cores, by columns if given: for steps that compute much from few
    bytes, which adaptive execution would put into a task or two."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *columns)
