"""Files by path or address, opened where a task or the driver runs: local and mounted disks, and the stores that Arrow knows."""

from __future__ import annotations

import fnmatch
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes read at once.
PIECE = 1 << 20
#: Files up to this are read as a whole by Spark, in any file system that it knows.
WHOLE = 64 << 20
#: Ending of a file that is being written.
BEGUN = ".begun"


def located(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a path, or of an address as Spark writes it."""
    local = re.fullmatch(r"(?:file:/*(?=/))?(/?.*)", path) if re.match(r"file:|(?![a-z][a-z0-9+.-]*:/)", path) else None
    return (fs.LocalFileSystem(), local[1]) if local else fs.FileSystem.from_uri(quote(path, safe=":/@?=&%"))


def pieces(path: str) -> Iterator[bytes]:
    system, name = located(path)
    with system.open_input_stream(name) as stream:
        while piece := stream.read(PIECE):
            yield piece


def sha256(path: str) -> str:
    """The digest of a file of any size, a piece at a time."""
    digest = hashlib.sha256()
    for piece in pieces(path):
        digest.update(piece)
    return digest.hexdigest()


def digests(files: DataFrame) -> DataFrame:
    """(path, sha256) of a column of paths, one task for as many files as come to it; a file is never held."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for path in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([sha256(path)])], names=["path", "sha256"])

    return files.select(F.col("path").cast("string").alias("path")).mapInArrow(run, "path string, sha256 string")


def store(pages: DataFrame, path: str, ending: str) -> int:
    """Write each row (folder, key, page) to path/folder/key and the ending, inside tasks; the number of files.

    A file comes under its name when it is whole, so what a task wrote that ran again is written over. What a name may not
    hold is written as %XX.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (system, root), made = located(path), set()
        for batch in rows:
            for folder, key, page in zip(batch.column("folder").to_pylist(), batch.column("key").to_pylist(), batch.column("page")):
                if folder not in made:
                    system.create_dir(f"{root}/{folder}", recursive=True)
                    made.add(folder)
                begun = f"{root}/{folder}/{uuid.uuid4().hex}{BEGUN}"
                with system.open_output_stream(begun) as stream:
                    stream.write(page.as_buffer())
                system.move(begun, f"{root}/{folder}/{quote(key, safe=' ')}{ending}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    own = pages.select("folder", "key", F.col("page").cast("binary").alias("page"))
    return own.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def contents(folders: DataFrame, path: str, pattern: str) -> DataFrame:
    """(path, content) of the files in the folders below path, a column of names, that match the pattern. A task lists
    its folders and reads their files; a folder that is not there is empty."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = located(path)
        made = lambda found: pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.binary())], names=["path", "content"])
        for batch in rows:
            for folder in batch.column(0).to_pylist():
                held, size = [], 0
                for info in system.get_file_info(fs.FileSelector(f"{root}/{folder}", allow_not_found=True)):
                    if info.is_file and not info.base_name.endswith(BEGUN) and fnmatch.fnmatchcase(info.base_name, pattern):
                        with system.open_input_stream(info.path) as stream:
                            held.append((f"{path}/{folder}/{info.base_name}", stream.read()))
                        size += len(held[-1][1])
                        if size >= 8 * PIECE:
                            yield made(held)
                            held, size = [], 0
                yield made(held)

    return folders.mapInArrow(run, "path string, content binary")
