"""Pages fetched over HTTP into a folder of runs, each a table that is written as a whole; what is there is not fetched again.

    fetch_pages(spark, ids, "https://host/page/", folder)    # a run: the manifest of all ids
    stored_pages(spark, folder)                              # (key, path, page), as tables.read_pages gives them

Ids that no run has a filled page for are found by an anti join, dealt to tasks by host and lane, and asked for one after
the other in a task. A host has `lanes` lanes, each of which waits `lanes` times the delay between requests, so a host
gets no more than one request for each delay however many tasks run. A run that is cut off leaves nothing; the next one
asks for its ids again.
"""

from __future__ import annotations

import http.client
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contrastkit.session import exists
from contrastkit.sources import tables

_SCHEMA = "id string, url string, status string, bytes long, error string, page binary"


@dataclass(frozen=True)
class Manners:
    """How hosts are asked: seconds between requests to one, seconds until a request is given up, lanes of a host, tasks
    in all, and the name given as user agent."""

    delay: float = 0.25
    timeout: float = 60.0
    lanes: int = 4
    tasks: int = 32
    agent: str = "contrastkit"


def asked(url: str, manners: Manners) -> tuple[str, bytes | None, str]:
    """(status, body, error) of one request: ok, http_<code>, url_error or timeout."""
    try:
        request = urllib.request.Request(url, headers={"User-Agent": manners.agent})
        with urllib.request.urlopen(request, timeout=manners.timeout) as response:
            return "ok", response.read(), ""
    except urllib.error.HTTPError as e:
        return f"http_{e.code}", None, str(e)
    except urllib.error.URLError as e:
        return "url_error", None, str(e.reason)
    except TimeoutError as e:
        return "timeout", None, str(e)
    except (OSError, http.client.HTTPException, ValueError) as e:
        return "url_error", None, str(e)


def fetched(wanted: DataFrame, manners: Manners = Manners()) -> DataFrame:
    """(id, url, status, bytes, error, page) of each (id, url): page is null and bytes 0 unless the status is ok."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, float] = {}
        for batch in rows:
            for name, url in zip(*(c.to_pylist() for c in batch.columns)):
                host = urllib.parse.urlsplit(url or "").netloc
                time.sleep(max(0.0, ready.get(host, 0.0) - time.monotonic()))
                status, page, error = asked(url or "", manners)
                if host:
                    ready[host] = time.monotonic() + manners.delay * manners.lanes
                columns = [pa.array([x], kind) for x, kind in ((name, pa.string()), (url, pa.string()), (status, pa.string()), (len(page or b""), pa.int64()), (error, pa.string()), (page, pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "url", "status", "bytes", "error", "page"])

    host = F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-z+]+://([^/?#]*)", 1)
    lane = F.pmod(F.xxhash64("id"), F.lit(manners.lanes))
    return wanted.select("id", "url").repartition(manners.tasks, host, lane).mapInArrow(run, _SCHEMA)


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    """(id, url, status, bytes, error, page, run) of all runs."""
    if not exists(spark, folder):
        return spark.createDataFrame([], f"{_SCHEMA}, run int")
    return spark.read.schema(f"{_SCHEMA}, run int").parquet(folder)


def _filled(runs: DataFrame) -> DataFrame:
    return runs.where((F.col("status") == "ok") & (F.col("bytes") > 0))


def fetch_pages(spark: SparkSession, ids: DataFrame, url: str | Column, folder: str, limit: int | None = None, force: bool = False, manners: Manners = Manners()) -> DataFrame:
    """The manifest (adc_id, place, url, path, status, bytes, error) of ids (id, place), after fetching those that no run
    has a filled page for; all of them with force.

    url: what stands before an id, or a column worked out from ids. limit: the first so many ids by place. path: the run
    that holds the page. Pages of earlier runs are "cached". An id that failed is asked for again by the next run.
    """
    link = F.concat(F.lit(url), F.col("id")) if isinstance(url, str) else url
    own = ids.orderBy("place").limit(limit) if limit else ids
    runs = _stored(spark, folder)
    done = _filled(runs).groupBy("id").agg(F.max_by(F.struct("run", "bytes"), "run").alias("held"))
    last = runs.agg(F.max("run")).first()[0]
    number = 0 if last is None else last + 1
    wanted = tables.to_fetch(own, done.select(F.col("id").alias("adc_id"), F.lit("ok").alias("status"), F.col("held.bytes").alias("bytes")), force=force)
    if wanted.limit(1).count():
        fetched(wanted.select("id", link.alias("url")), manners).write.parquet(f"{folder}/run={number}")
    new = _stored(spark, folder).where(F.col("run") == number).drop("page")
    met = own.withColumn("_url", link).join(new, "id", "left").join(done, "id", "left")
    here = F.col("run").isNotNull()
    failed = here & ((F.col("status") != "ok") | (F.col("bytes") == 0))
    path = F.when(~failed, F.concat(F.lit(f"{folder}/run="), F.coalesce("run", "held.run")))
    return met.select(
        F.col("id").alias("adc_id"),
        "place",
        F.col("_url").alias("url"),
        F.coalesce(path, F.lit("")).alias("path"),
        F.when(here, F.col("status")).otherwise("cached").alias("status"),
        F.when(here, F.col("bytes")).otherwise(F.col("held.bytes")).alias("bytes"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


def stored_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(key, path, page) of the ids that a run has a filled page for, each from its latest; bytes that are no UTF-8 become U+FFFD."""
    runs = _filled(_stored(spark, folder))
    latest = runs.groupBy("id").agg(F.max("run").alias("run"))
    found = runs.join(latest, ["id", "run"], "left_semi")
    return found.select(F.col("id").alias("key"), F.concat(F.lit(f"{folder}/run="), "run").alias("path"), F.make_valid_utf8(F.col("page").cast("string")).alias("page"))
