"""Scratch tables, row keys and word spans that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contrastkit.session import cut as cut
from contrastkit.session import forget as forget
from contrastkit.session import scratch_dir as scratch_dir
from contrastkit.session import spread as spread

#: The white space of every word and line rule here: \x20 and \x09-\x0D.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = "[\\x20\\x09-\\x0D]+"
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE.encode())] = True


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def own_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, lengthened by underscores until no column of docs is called so, whatever its case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def hot_join(rows: DataFrame, table: DataFrame, keys: str | Sequence[str], how: str = "inner", share: int = 1000, hot: DataFrame | None = None) -> DataFrame:
    """rows joined with a table that holds a key once. A key in over 1/share of the rows is looked up in a broadcast of
    under `share` entries, so that no task gets all rows of a key. hot: those keys, if they are known."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if hot is None:
        total = rows.count()
        hot = cut(rows.groupBy(*keys).count().where(F.col("count") > F.lit(max(64, total // share))).select(*keys), "hot")
    few = rows.join(F.broadcast(hot), keys, "left_anti").join(table, keys, how)
    many = rows.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(table.join(F.broadcast(hot), keys, "left_semi")), keys, how)
    return few.unionByName(many)


def row_key(docs: DataFrame) -> Column:
    """A bigint that tells the rows of (doc_id, text) apart: doc_id where it is unique and never null, else a hash of both.

    Rows that agree in doc_id and text share a key; they get the same results.
    """
    counted = docs.groupBy("doc_id").count()
    odd = counted.where("doc_id is null or count > 1").limit(1).count()
    return F.xxhash64("doc_id", "text") if odd else F.col("doc_id").cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once for a row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Array of the words [^\\x20\\x09-\\x0D]+ of a text; empty for null."""
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(F.length(bare) > 0, F.split(bare, SPACE_RE)).otherwise(F.array().cast("array<string>"))


def text_slices(column: pa.Array, most_bytes: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows holding about most_bytes; a longer text is alone in its slice."""
    if pa.types.is_large_string(column.type):
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)
    else:
        column = column.cast(pa.string())
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None and held.size else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + most_bytes, side="right")) - 1
        end = min(len(column), max(first + 1, end))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word in concatenated UTF-8 texts; words never cross rows."""
    solid = ~_IS_SPACE[data]
    if not len(solid):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before = np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    before[edges] = False
    after = np.empty_like(solid)
    after[-1], after[:-1] = False, solid[1:]
    after[edges[edges > 0] - 1] = False
    start = np.flatnonzero(solid & ~before)
    end = np.flatnonzero(solid & ~after) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1

