"""Named format ``landed_lines``: the text lines of a folder, for batch and stream.

``flights_in(spark.read.format("landed_lines").load(folder), "EUROPE")``

For file systems that pyarrow reaches and Spark doesn't. It hands lines to Spark and no more: the
operators decode them as they do for Spark's own text reader, which is the better choice wherever
it works, since it splits large files and bounds a micro-batch.
"""

from __future__ import annotations

import base64
import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

READ_BYTES = 1 << 20
#: A stream reads a file when it is this many seconds old, so that it is complete.
SETTLE_SECONDS = 5.0


@dataclass
class LandedFile(InputPartition):
    """One file, or none: Spark wants one partition at least."""

    path: str | None


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of an absolute path or URI; ``s3a`` is Spark's name for ``s3``."""
    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def landed_files(folder: str) -> list[tuple[int, str]]:
    """Time of landing and path of each file, sub-folders included, hidden and marker files not."""
    system, root = open_folder(folder)
    found = []
    for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
        parts = info.path[len(root) :].strip("/").split("/")
        if info.type == fs.FileType.File and info.size and not any(p[0] in "._" for p in parts):
            found.append((info.mtime_ns or 0, info.path))
    return sorted(found)


def read_landed(folder: str, path: str | None) -> Iterator[pa.RecordBatch]:
    """The lines of one file, whatever its name says it is compressed with, by blocks."""
    if path is None:
        return
    system, _ = open_folder(folder)
    rest = b""
    with system.open_input_stream(path, compression="detect") as file:
        while block := file.read(READ_BYTES):
            *lines, rest = (rest + block).split(b"\n")
            yield _batch(lines)
    if rest:
        yield _batch([rest])


def _batch(lines: list[bytes]) -> pa.RecordBatch:
    texts = [line.removesuffix(b"\r").decode("utf-8", "replace") for line in lines]
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["value"])


class LandedLines(DataSource):
    """Options: ``path``, and ``settle_seconds`` for streams."""

    known = {"path", "settle_seconds"}

    def __init__(self, options):
        super().__init__(options)
        unknown = set(options) - self.known
        if unknown:
            raise ValueError(f"unknown options {sorted(unknown)}; known are {sorted(self.known)}")
        if "path" not in options:
            raise ValueError("option path is missing")
        self.folder = options["path"]
        self.settle = float(options.get("settle_seconds", SETTLE_SECONDS))

    @classmethod
    def name(cls) -> str:
        return "landed_lines"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(self.folder)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(self.folder, self.settle)


class _BatchReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self):
        return [LandedFile(path) for _, path in landed_files(self.folder)] or [LandedFile(None)]

    def read(self, partition):
        return read_landed(self.folder, partition.path)


def _mark(file: tuple[int, str]) -> bytes:
    name = f"{file[0]} {file[1]}".encode("utf-8", "surrogatepass")
    return hashlib.blake2b(name, digest_size=8).digest()


def _seen(offset: dict) -> Callable[[tuple[int, str]], bool]:
    """Whether a file has been read up to an offset; those of older checkpoints have the newest file only."""
    if "seen" not in offset:
        return lambda f: f <= (offset["time"], offset["path"])
    data = base64.b64decode(offset["seen"])
    marks = {data[k : k + 8] for k in range(0, len(data), 8)}
    return lambda f: _mark(f) in marks


class _StreamReader(DataSourceStreamReader):
    """The offset tells the time of landing and path of the newest file read, and which files have been
    read: eight bytes of a hash for each that is still there. So a file that appears late with an old
    time, as renamed ones do, is read too."""

    def __init__(self, folder: str, settle: float):
        self.folder = folder
        self.settle = settle

    def initialOffset(self):  # noqa: N802
        return {"time": 0, "path": ""}

    def latestOffset(self):  # noqa: N802
        until = time.time_ns() - round(self.settle * 1e9)
        settled = [f for f in landed_files(self.folder) if f[0] <= until]
        if not settled:
            return self.initialOffset()
        seen = b"".join(sorted(map(_mark, settled)))
        return {"time": settled[-1][0], "path": settled[-1][1], "seen": base64.b64encode(seen).decode()}

    def partitions(self, start, end):
        before, after = _seen(start), _seen(end)
        return [LandedFile(f[1]) for f in landed_files(self.folder) if after(f) and not before(f)] or [LandedFile(None)]

    def read(self, partition):
        return read_landed(self.folder, partition.path)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    spark.dataSource.register(LandedLines)
