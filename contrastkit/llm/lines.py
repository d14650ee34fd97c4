"""Line dedup (operator 8): levelled sorted runs of line hashes, probed by each new batch of documents.

A run is a table of line hashes and owners, bucketed and sorted by hash in the shared folder. A batch groups its own
lines by hash, merge-anti-joins the runs, and what is left becomes a run of the lowest level; when a level holds
`fanout` runs they are merged into one of the next level. Batches come in doc_id order, so the first run to hold a
line also holds its owner, the smallest doc_id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contrastkit.llm.common import SPACE, cut, hot_join, own_names, row_key, scratch_dir, shuffle_partitions

_HASH = ["h1", "h2"]
#: Stands for a null doc_id: after all others.
_LAST = (1 << 63) - 1


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Sorted runs in levels. Runs never share a hash."""

    def __init__(self, spark: SparkSession, fanout: int = 4) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = shuffle_partitions(spark)
        self.levels: list[list[str]] = [[]]

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        writer = rows.repartition(self.buckets, *_HASH).sortWithinPartitions(*_HASH).write.format("parquet")
        writer.bucketBy(self.buckets, *_HASH).sortBy(*_HASH).option("path", f"{scratch_dir(self.spark)}/{name}").saveAsTable(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The keys that no run holds: one merge anti join for each run."""
        for run in self.runs():
            keys = keys.join(run.hint("merge"), _HASH, "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """Add keys that no run holds; merge the runs of a full level."""
        self.levels[0].append(self._write(keys))
        for k in range(64):
            if len(self.levels[k]) < self.fanout:
                return
            if k + 1 == len(self.levels):
                self.levels.append([])
            merged = None
            for name in self.levels[k]:
                run = self.spark.table(name)
                merged = run if merged is None else merged.unionByName(run)
            self.levels[k + 1].append(self._write(merged))
            self._discard(self.levels[k])
            self.levels[k] = []

    def discard(self) -> None:
        """Drop all runs, whose lines nothing reads any more."""
        for k, level in enumerate(self.levels):
            self._discard(level)
            self.levels[k] = []

    def _discard(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"drop table {name}")  # leaves the files of tables with a path
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(self.spark)}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _line_rows(docs: DataFrame, least: int) -> DataFrame:
    """(key, d, p, h1, h2): the hashes of lines whose key has at least `least` code points, and their places."""
    lines = docs.select("key", "d", F.posexplode(_lines(F.col("text"))).alias("p", "line")).select("key", "d", "p", line_key(F.col("line")).alias("k"))
    return lines.where(F.length("k") >= least).select("key", "d", "p", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), "k").alias("h2"))


def deduplicated_lines(docs: DataFrame, least: int = 10, n_batches: int = 3, fanout: int = 2) -> DataFrame:
    """All columns of docs beside n_lines, n_dropped and kept (the text without its dropped lines): one row per row.

    Lines are parted by \\n; null or empty text is one empty line. A key of at least `least` code points found in two
    documents or more loses all its lines except those of the smallest doc_id that holds it. Rows with one doc_id
    are one document; those with null doc_id are one document after all others. Columns of docs named n_lines,
    n_dropped or kept are replaced. No rows in: no rows out.
    """
    spark = docs.sparkSession
    key, lost = own_names(docs, "row_key", "lost_places")
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    placed = docs.withColumn(key, row_key(docs))
    # texts are taken apart once; what follows reads hashes and places
    rows = cut(_line_rows(placed.select(F.col(key).alias("key"), doc_id.alias("d"), "text"), least), "line-hashes")
    low, high = docs.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long"))).first()
    low, high = (0, 0) if low is None else (low, high)
    width = (high - low) // n_batches + 1
    runs, hot = LineRuns(spark, fanout), None
    for k in range(n_batches):
        own = F.col("d") >= low + k * width if k else F.lit(True)
        if k + 1 < n_batches:
            own = own & (F.col("d") < low + (k + 1) * width)
        keys = cut(rows.where(own).groupBy(*_HASH).agg(F.min("d").alias("owner"), F.count(F.lit(1)).alias("n")), "line-keys")
        # keys with over a thousandth of a batch's lines: under 1,000 for each batch
        total = keys.agg(F.sum("n")).first()[0] or 0
        often = keys.where(F.col("n") > max(500, total // 1000)).select(*_HASH)
        hot = often if hot is None else hot.union(often)
        runs.add(runs.unseen(keys.drop("n")))
    owners = None
    for run in runs.runs():
        owners = run if owners is None else owners.unionByName(run)
    drops = hot_join(rows, owners, _HASH, hot=cut(hot.distinct(), "hot-lines")).where("owner <> d")
    drops = cut(drops.groupBy(F.col("key").alias(key)).agg(F.collect_set("p").alias(lost)), "lost-lines")
    runs.discard()
    joined = placed.join(drops.hint("shuffle_hash"), key, "left")
    lines = _lines(F.col("text"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce(lost, F.array().cast("array<int>")))
    shown = F.when(F.col(lost).isNull(), lines).otherwise(F.transform(stay, lambda p: F.get(lines, p)))
    return (
        joined.withColumn("n_lines", F.size(lines).cast("long"))
        .withColumn("n_dropped", F.coalesce(F.size(lost), F.lit(0)).cast("long"))
        .withColumn("kept", F.array_join(shown, "\n"))
        .drop(key, lost)
    )
