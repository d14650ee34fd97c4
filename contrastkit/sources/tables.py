"""Delimited files, page files, file inventories and their sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from contrastkit.functions import text as tx
from contrastkit.sources import files

#: Columns of an activity table, in order.
ACTIVITY = (
    "adc_id adc_name drug_status antibody_name antigen_id antigen_name payload_id payload_name payload_identity payload_target payload_mechanism linker_name "
    "activity_id standard_type is_potency_endpoint relation value_raw value_numeric units is_molar_unit cell_line disease_model source_url source_html"
).split()

#: Folders that page files are dealt to.
FOLDERS = 1024


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A delimited file with a header; every column is text and a missing value is empty, not null.

    columns: the header, if known; it spares a pass over the file.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
    frame = reader.schema(StructType([StructField(c, StringType()) for c in columns])).csv(path) if columns else reader.csv(path)
    return frame.na.fill("")


def read_inferred_csv(spark: SparkSession, path: str) -> DataFrame:
    """A delimited file with types found by reading it."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", True).csv(path)


def _folder(key: Column) -> Column:
    return F.lpad(F.hex(F.pmod(F.xxhash64(key), F.lit(FOLDERS))), 3, "0")


def write_pages(pages: DataFrame, path: str, ending: str = ".html") -> int:
    """Write pages (key, page) of different keys as files named by their keys, dealt by hash to FOLDERS folders; the number
    of files. A page without a key or text has no file. For file systems that Arrow knows."""
    own = pages.where(F.col("key").isNotNull() & F.col("page").isNotNull())
    return files.store(own.select(_folder(F.col("key")).alias("folder"), "key", "page"), path, ending)


def page_folders(spark: SparkSession) -> DataFrame:
    """The names of the folders that write_pages deals to, in a few tasks a core."""
    return spark.range(0, FOLDERS, 1, min(FOLDERS, 4 * spark.sparkContext.defaultParallelism)).select(F.lpad(F.hex("id"), 3, "0").alias("folder"))


def read_pages(spark: SparkSession, path: str, pattern: str = "*.html", key: str = r"([^/]*?)(?:\.[^./]*)?$", folders: DataFrame | None = None) -> DataFrame:
    """(key, path, page): one row per file; undecodable bytes become U+FFFD. key: a regular expression whose first group
    on a file's path is its key, else its name without the ending.

    folders: names of the folders below path that hold the files, where they are known, as page_folders gives them; tasks
    list and read them, and no list of files passes the driver.
    """
    if folders is None:
        found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    else:
        found = files.contents(folders, path, pattern)
    return found.select(F.regexp_extract("path", key, 1).alias("key"), "path", F.make_valid_utf8(F.col("content").cast("string")).alias("page"))


def activity_rows(pages: DataFrame, labels: Mapping[str, str], links: Mapping[str, tuple[str, str]], block: Sequence[str], url: str = "") -> DataFrame:
    """The activity table of pages (key, path, page): one row per record in the section that `block` delimits.

    labels: column -> header cell; links: column -> (header cell, href prefix); block: start, inner, end, fallback.
    """
    page = F.col("page")
    own = pages.select("key", "path", *[tx.labelled_value(page, label).alias(c) for c, label in labels.items()], *[tx.labelled_link_id(page, label, prefix).alias(c) for c, (label, prefix) in links.items()], tx.section(page, *block).alias("_block"))
    rows = own.select("*", F.posexplode(tx.record_table(F.col("_block"))).alias("row_no", "_m")).drop("_block")
    fields = {name: F.col(f"_m.{name}") for name in tx.RECORD_FIELDS}
    rows = rows.select("*", *[(tx.clean_text(c) if name != "activity_id" else F.btrim(c)).alias(name) for name, c in fields.items()]).drop("_m")
    have = lambda c: F.col(c) if c in rows.columns else F.lit("")
    raw = F.col("value_raw")
    derived: dict[str, Column] = {
        "adc_id": F.col("key"),
        "payload_identity": tx.first_filled(have("payload_id"), have("payload_name")),
        "payload_mechanism": tx.class_by_rules(have("payload_target"), have("payload_name")),
        "is_potency_endpoint": tx.contains_any(F.col("standard_type")).cast("int").cast("string"),
        "relation": tx.relation_of(raw),
        "value_numeric": tx.first_number(tx.value_of(raw)),
        "is_molar_unit": tx.is_molar(F.col("units")).cast("int").cast("string"),
        "source_url": F.concat(F.lit(url), F.col("key")),
        "source_html": F.col("path"),
    }
    rows = rows.withColumns(derived)
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit("")).alias(c) for c in ACTIVITY], "row_no")


def distinct_ids(rows: DataFrame, column: str, row_no: str) -> DataFrame:
    """(id, place): the filled ids, trimmed, once each, by first appearance."""
    if column not in rows.columns:
        raise ValueError(f"no column {column}")
    own = rows.select(F.btrim(F.col(column).cast("string")).alias("id"), F.col(row_no).alias("place")).where("id <> ''")
    return own.groupBy("id").agg(F.min("place").alias("place")).orderBy("place")


def to_fetch(ids: DataFrame, manifest: DataFrame, limit: int | None = None, force: bool = False) -> DataFrame:
    """The ids that a manifest (adc_id, status, bytes) has no filled page for; the first `limit` of all, if given."""
    own = ids.orderBy("place").limit(limit) if limit else ids
    done = manifest.where(F.col("status").isin("ok", "cached") & (F.col("bytes").cast("long") > 0)).select(F.col("adc_id").alias("id"))
    return own if force else own.join(done, "id", "left_anti")


def inventory(spark: SparkSession, path: str, notes: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(path, relative_path, top_level, suffix, bytes, sha256, note) of all files below a folder.

    notes: (regular expression on the relative path, note); the first that matches counts. Files of up to files.WHOLE bytes
    are read by Spark; larger ones a piece at a time by files.digests, in file systems that Arrow knows.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small = F.col("length") <= files.WHOLE
    root = F.regexp_replace(F.lit(path.rstrip("/")), "^[a-z]+:/*(?=/)", "")
    relative = F.call_function("substring_index", F.col("path"), F.concat(root, F.lit("/")), F.lit(-1))
    name = F.element_at(F.split(relative, "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]+)$", 1))
    note = F.coalesce(*[F.when(relative.rlike(pattern), F.lit(note)) for pattern, note in notes], F.lit(""))
    top = F.element_at(F.split(relative, "/"), 1)
    read = found.where(small).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = found.where(~small).select("path", "length")
    own = read.unionByName(large.join(files.digests(large), "path"))
    return own.select("path", relative.alias("relative_path"), top.alias("top_level"), F.coalesce(F.nullif(suffix, F.lit("")), F.lit("<none>")).alias("suffix"), F.col("length").alias("bytes"), "sha256", note.alias("note"))


def inventory_summary(found: DataFrame) -> DataFrame:
    """(top_level, files, total_bytes, suffixes); a null suffix is "<none>"."""
    each = found.withColumn("suffix", F.coalesce("suffix", F.lit("<none>"))).groupBy("top_level", "suffix").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("suffix", "n"))), lambda x: F.concat_ws(":", x["suffix"], x["n"].cast("string"))), ", ")
    return each.groupBy("top_level").agg(F.sum("n").alias("files"), F.sum("b").alias("total_bytes"), listed.alias("suffixes"))


def label_profile(rows: DataFrame, fragment: str = "label") -> DataFrame:
    """(column, value, n) of the columns whose name holds the fragment; a blank value is "<blank>"."""
    columns = [c for c in rows.columns if fragment in c.lower()]
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("<blank>")).alias("value")) for c in columns]).cast("array<struct<column: string, value: string>>")
    return rows.select(F.explode(each).alias("x")).groupBy("x.column", "x.value").agg(F.count(F.lit(1)).alias("n"))


def write_csv(rows: DataFrame, path: str, columns: Sequence[str] | None = None, parts: int | None = None, crlf: bool = False) -> None:
    """Delimited text with a header; columns the table lacks are blank, others are left out. parts: number of files, one
    of which is there, with the header alone, even where there are no rows. crlf: lines end with \\r\\n."""
    if columns:
        rows = rows.select(*[F.col(c) if c in rows.columns else F.lit("").alias(c) for c in columns])
    rows = rows.coalesce(parts) if parts else rows
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("lineSep", "\r\n" if crlf else "\n").csv(path)


def stacked(*frames: DataFrame) -> DataFrame:
    """Rows of tables of different shapes: all columns, by first appearance; what a table lacks is null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
