"""A Spark data source for the first sheet of spreadsheet files (.xlsx): spark.read.format("xlsx").load(path).

Options: dropBlankRows (true) leaves out rows without a filled cell; strict (false) raises where a shared string or a
cell reference is missing; unescape (false) decodes entities in plain values. The first row that is kept is the header.
One file is one partition; all columns are text, and _row is the place of a row below the header. The data source opens
paths itself, on disks that all machines have or in stores that Arrow knows, and reads a sheet as it goes: what it holds is
the shared strings and BATCH rows. `read_workbooks` reads through Spark, from any file system that Spark knows, and holds
the file's own bytes besides.
"""

from __future__ import annotations

import fnmatch
import html
import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from typing import BinaryIO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

from contrastkit.sources.files import located

#: Rows that are given out together.
BATCH = 4096
#: Namespaces of the format (fixed values).
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def column_place(reference: str, strict: bool) -> int:
    letters = re.match(r"[A-Za-z]*", reference)[0].upper()
    if not letters:
        if strict:
            raise ValueError("a cell without a reference")
        letters = "A"
    place = 0
    for letter in letters:
        place = place * 26 + ord(letter) - 64
    return place - 1


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheet = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}sheets/{_MAIN}sheet")
    wanted = sheet.get(f"{_REL}id")
    for link in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter(f"{_PACKAGE}Relationship"):
        if link.get("Id") == wanted:
            target = link.get("Target")
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise ValueError("the first sheet has no part")


def _parsed(part: BinaryIO, tag: str, inside: str) -> Iterator[ElementTree.Element]:
    """The elements of a tag, each let go of when the next is asked for."""
    above = None
    for event, element in ElementTree.iterparse(part, ("start", "end")):
        if event == "start" and element.tag == inside:
            above = element
        if event == "end" and element.tag == tag:
            yield element
            (element if above is None else above).clear()


def sheet_rows(content: bytes | BinaryIO, drop_blank: bool = True, strict: bool = False, unescape: bool = False) -> Iterator[list[str]]:
    """The rows of the first sheet as texts, padded to their last filled cell, as the sheet is read."""
    with zipfile.ZipFile(io.BytesIO(content) if isinstance(content, bytes) else content) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as part:
                shared = ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in _parsed(part, f"{_MAIN}si", f"{_MAIN}sst")]
        with book.open(_first_sheet(book)) as part:
            for element in _parsed(part, f"{_MAIN}row", f"{_MAIN}sheetData"):
                cells: list[str] = []
                for cell in element.iter(f"{_MAIN}c"):
                    place = column_place(cell.get("r") or "", strict)
                    cells += [""] * (place + 1 - len(cells))
                    cells[place] = _text(cell, shared, strict, unescape)
                if not drop_blank or any(x.strip() for x in cells):
                    yield cells


def _batches(rows: Iterator[list[str]], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows below the header as the named columns and _row, BATCH at a time."""
    header, first, done = next(rows, []), 0, False
    at = {c: k for k, c in enumerate(header)}
    while not done:
        held = []
        for cells in rows:
            held.append(cells)
            if len(held) == BATCH:
                break
        else:
            done = True
        cell = lambda x, c: x[at[c]] if c in at and at[c] < len(x) else ""
        made = [pa.array(range(first, first + len(held)), pa.int64()) if c == "_row" else pa.array([cell(x, c) for x in held], pa.string()) for c in columns]
        first += len(held)
        if held:
            yield pa.RecordBatch.from_arrays(made, names=columns)


def _text(cell: ElementTree.Element, shared: list[str], strict: bool, unescape: bool) -> str:
    kind, raw = cell.get("t"), cell.findtext(f"{_MAIN}v") or ""
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
    if kind == "s" and raw:
        if raw.isdigit() and int(raw) < len(shared):
            return shared[int(raw)]
        if strict:
            raise ValueError(f"no shared string {raw}")
    return html.unescape(raw) if unescape else raw


def _opened(path: str) -> BinaryIO:
    system, name = located(path)
    return system.open_input_file(name)


class XlsxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def _flag(self, name: str, default: bool) -> bool:
        return str(self.options.get(name, default)).lower() == "true"

    def _settings(self) -> dict[str, bool]:
        return {"drop_blank": self._flag("dropBlankRows", True), "strict": self._flag("strict", False), "unescape": self._flag("unescape", False)}

    def _files(self) -> list[str]:
        system, path = located(self.options["path"])
        if system.get_file_info(path).type != fs.FileType.Directory:
            return [self.options["path"]]
        found = (f.path for f in system.get_file_info(fs.FileSelector(path)) if fnmatch.fnmatch(f.base_name, "*.xlsx"))
        return sorted(self.options["path"].rstrip("/") + "/" + p.rpartition("/")[2] for p in found)

    def schema(self) -> StructType:
        header: list[str] = []
        for path in self._files():
            with _opened(path) as book:
                first = next(sheet_rows(book, **self._settings()), [])
            header += [c for c in first if c not in header]
        return StructType([StructField(c, StringType()) for c in header] + [StructField("_row", LongType())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return XlsxReader(self._files(), [f.name for f in schema.fields], self._settings())


class XlsxReader(DataSourceReader):
    def __init__(self, files: list[str], columns: list[str], settings: dict[str, bool]) -> None:
        self.files, self.columns, self.settings = files, columns, settings

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in self.files]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        with _opened(partition.value) as book:
            yield from _batches(sheet_rows(book, **self.settings), self.columns)


def read_workbooks(spark: SparkSession, path: str, pattern: str = "*.xlsx", drop_blank: bool = True, strict: bool = False, unescape: bool = False) -> DataFrame:
    """The first sheets of all files at path: the columns of all headers, by first appearance in the order of paths, as
    text, blank where a file lacks them, and _row. No files: _row alone, and no rows."""
    settings = {"drop_blank": drop_blank, "strict": strict, "unescape": unescape}
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([next(sheet_rows(content.as_py(), **settings), [])], pa.list_(pa.string()))], names=["path", "header"])

    found = sorted(files.mapInArrow(headers, "path string, header array<string>").collect())  # a row for each file
    columns = list(dict.fromkeys(c for _, header in found for c in header))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                yield from _batches(sheet_rows(content.as_py(), **settings), [*columns, "_row"])

    return files.mapInArrow(run, StructType([StructField(c, StringType()) for c in columns] + [StructField("_row", LongType())]))


def workbook(header: list[str], rows: Iterator[list[str]]) -> bytes:
    """A workbook of one sheet with these texts; the header's are shared strings."""
    main, held = f'xmlns="{_MAIN[1:-1]}"', io.BytesIO()
    line = lambda k, cells: f'<row r="{k}">{"".join(cells)}</row>'
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{_REL[1:-1]}"><sheets><sheet name="1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE[1:-1]}"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><t>{escape(c)}</t></si>" for c in header) + "</sst>")
        with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(f"<worksheet {main}><sheetData>{line(1, [f'<c r="{_letters(j)}1" t="s"><v>{j}</v></c>' for j in range(len(header))])}".encode())
            for k, cells in enumerate(rows, 2):
                sheet.write(line(k, [f'<c r="{_letters(j)}{k}" t="inlineStr"><is><t>{escape(x)}</t></is></c>' for j, x in enumerate(cells) if x]).encode())
            sheet.write(b"</sheetData></worksheet>")
    return held.getvalue()


def _letters(place: int) -> str:
    """The name of a column from 0."""
    out, place = "", place + 1
    while place:
        place, k = divmod(place - 1, 26)
        out = chr(65 + k) + out
    return out


def write_workbooks(rows: DataFrame, folder: str, key: str) -> DataFrame:
    """(key, path): a workbook in folder for each value of key, whose rows must fit a task, named by it; null is blank. The
    files are written when the result is read, and put in place as a whole."""
    columns = [c for c in rows.columns if c != key]
    kind = rows.schema[key].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        name = group.column(key)[0].as_py()
        texts = zip(*(group.column(c).cast(pa.string()).fill_null("").to_pylist() for c in columns))
        system, place = located(folder)
        system.create_dir(place, recursive=True)
        part = f"{place}/{name}.{uuid.uuid4().hex}.part"
        with system.open_output_stream(part) as stream:
            stream.write(workbook(columns, map(list, texts)))
        system.move(part, f"{place}/{name}.xlsx")
        return pa.table({key: group.column(key).slice(0, 1), "path": pa.array([f"{folder}/{name}.xlsx"])})

    return rows.groupBy(key).applyInArrow(run, f"{key} {kind}, path string")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxSource)
