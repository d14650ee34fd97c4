"""One delimited file from a table of any size: rows.write.format("single_csv").mode("append").save(path).

Tasks write their rows beside the place of the file; when all are done the parts are put behind one another in the order
of partitions, so a table that is in order stays so, and the file appears at once. If a task fails for good nothing
appears at path; tasks that were still running then may leave their parts beside it. Only the parts that were reported are taken, so a task may run twice.

Options: path; columns (names as a JSON list: the header; what the table lacks is blank, what it has besides is left
out); lineSep (\\r\\n by default); noRows: "header" (by default) or "blank", a single empty line.
"""

from __future__ import annotations

import csv
import io
import json
import sys
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StringType, StructField, StructType

from contrastkit.sources.files import PIECE, located


@dataclass
class Part(WriterCommitMessage):
    partition: int
    name: str
    rows: int


class SingleCsv(DataSource):
    @classmethod
    def name(cls) -> str:
        return "single_csv"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return SingleCsvWriter(dict(self.options), schema.names)


class SingleCsvWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], names: list[str]) -> None:
        options = {k.lower(): v for k, v in options.items()}
        self.path, self.names = options["path"], names
        self.columns = json.loads(options["columns"]) if "columns" in options else names
        self.end = options.get("linesep", "\r\n")
        self.blank = options.get("norows", "header") == "blank"
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"

    def _lines(self, rows: Iterator[Sequence]) -> Iterator[bytes]:
        held = io.StringIO(newline="")
        writer = csv.writer(held, lineterminator=self.end)
        for row in rows:
            writer.writerow(["" if x is None else x for x in row])
            if held.tell() > PIECE:
                yield held.getvalue().encode()
                held.seek(0)
                held.truncate()
        yield held.getvalue().encode()

    def write(self, iterator: Iterator[Row]) -> Part:
        system, folder = located(self.parts)
        system.create_dir(folder, recursive=True)
        partition, name, n = TaskContext.get().partitionId(), f"{folder}/{uuid.uuid4().hex}", 0
        place = [self.names.index(c) if c in self.names else None for c in self.columns]

        def cells() -> Iterator[list]:
            nonlocal n
            for row in iterator:
                n += 1
                yield [None if k is None else row[k] for k in place]

        with system.open_output_stream(name) as stream:
            for piece in self._lines(cells()):
                stream.write(piece)
        return Part(partition, name, n)

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m), key=lambda m: m.partition)
        system, path = located(self.path)
        above = path.rpartition("/")[0]
        if above:
            system.create_dir(above, recursive=True)
        whole = f"{path}.{uuid.uuid4().hex}"
        header = [] if self.blank and not any(m.rows for m in parts) else self.columns
        with system.open_output_stream(whole) as stream:
            stream.write(b"".join(self._lines(iter([header]))))
            for part in parts:
                with system.open_input_stream(part.name) as held:
                    while piece := held.read(PIECE):
                        stream.write(piece)
        system.move(whole, path)
        self.abort(messages)

    def abort(self, messages: list[Part | None]) -> None:
        system, folder = located(self.parts)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


def write_single_csv(rows: DataFrame, path: str, columns: Sequence[str] | None = None, line_sep: str = "\r\n", no_rows: str = "header") -> None:
    """One file at path with a header, in the order of rows; see above. The folder is made if it is not there, a file that is
    there is replaced, null is blank."""
    rows.sparkSession.dataSource.register(SingleCsv)
    writer = rows.write.format("single_csv").mode("append").option("path", path).option("lineSep", line_sep).option("noRows", no_rows)
    (writer.option("columns", json.dumps(list(columns))) if columns is not None else writer).save()


#: Bytes of a range of a file that a task reads, and of cells that a batch holds.
RANGE, BATCH = 32 << 20, 4 << 20


def read_single_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A file that write_single_csv wrote with these columns, read in ranges of RANGE bytes; every column is text.

    Quotes stand around or are doubled inside of cells only, so a line feed ends a row if the quotes before it are even in
    number. They are counted by range first; a task then reads the rows that begin in its range. A file with a blank line
    instead of a header has no rows.
    """
    system, name = located(path)
    size, each = system.get_file_info(name).size, RANGE
    many = max(1, -(-size // each))
    ranges = spark.range(0, many, 1, many)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, name = located(path)
        for batch in batches:
            for k in batch.column("id").to_pylist():
                quotes, left = 0, min(size, (k + 1) * each) - k * each
                with system.open_input_file(name) as held:
                    held.seek(k * each)
                    while left > 0 and (piece := held.read(min(PIECE, left))):
                        quotes += piece.count(b'"')
                        left -= len(piece)
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([quotes])], names=["id", "quotes"])

    # one number for each range
    odd, before = {}, 0
    for row in sorted(ranges.mapInArrow(count, "id long, quotes long").collect()):
        odd[row["id"]] = before % 2 == 1
        before += row["quotes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            for k in batch.column("id").to_pylist():
                rows, held = [], 0
                for record in _records(path, k * each, min(size, (k + 1) * each), odd[k]):
                    row = next(csv.reader([record.decode(errors="replace")]), [])
                    if row:
                        rows.append((row + [""] * len(columns))[: len(columns)])
                        held += len(record)
                    if held > BATCH:
                        yield _text_batch(rows, columns)
                        rows, held = [], 0
                yield _text_batch(rows, columns)

    return ranges.mapInArrow(run, StructType([StructField(c, StringType()) for c in columns]))


def _text_batch(rows: list[list[str]], columns: Sequence[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(len(columns))], names=list(columns))


def _records(path: str, first: int, last: int, inside: bool) -> Iterator[bytes]:
    """The rows of a file, but for the header, that begin at bytes from first up to last; inside: first lies inside a cell
    in quotes."""
    system, name = located(path)
    with system.open_input_file(name) as file:
        file.seek(max(0, first - 1))
        held = io.BufferedReader(file, PIECE)

        def record(open_: bool) -> bytes:
            lines = []
            while line := held.readline():
                lines.append(line)
                open_ ^= line.count(b'"') % 2 == 1
                if not open_:
                    break
            return b"".join(lines)

        if first:
            # up to the end of the row that the byte before belongs to
            byte = held.read(1)
            at = first if byte == b"\n" and not inside else first + len(record(inside))
        else:
            at = len(record(False))
        while at < last and (found := record(False)):
            at += len(found)
            yield found


def write_manifest(manifest: DataFrame, path: str) -> None:
    """The manifest of a fetch in the order of its ids."""
    write_single_csv(manifest.orderBy("place"), path, ["adc_id", "url", "path", "status", "bytes", "error"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SingleCsv)
