"""Growing log files as a streaming source: `spark.readStream.format("log_tail").option("path", ...)`.

The offset of a file holds its inode, the hash of its head and the byte up to which whole lines were read. What stands behind the
last line feed is a partial line: it is not read until it is finished, so its carry is its place in the file. A
file that got another inode, another head or fewer bytes was rotated or truncated and is read from its start; if the file
of the old inode is still there under a name that begins alike (app.log.1 beside app.log), its rest is read first, an unfinished last line included.
Ranges of bytes are tasks of `rangeBytes` (8 MB); a line belongs to the range in which it starts. A batch is planned by offsets alone, so
one that is run again after a restart reads the same lines.

The path is a file or a glob, on a file system that driver and executors mount alike.
"""

from __future__ import annotations

import glob
import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, inode bigint, byte bigint, value string"
RANGE_BYTES = 8 << 20
_HEAD, _STEP, _LINES = 256, 1 << 16, 4096


def head_of(path: str) -> str:
    """Hash of the first line, as far as the first bytes hold it; empty while there is no whole line."""
    with open(path, "rb") as f:
        first = f.read(_HEAD)
    cut = first.find(b"\n")
    return hashlib.sha256(first[:cut] if cut >= 0 else first).hexdigest()[:16] if cut >= 0 or len(first) == _HEAD else ""


def whole_lines(path: str) -> int:
    """Bytes of a file up to and with its last line feed."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at:
            low = max(0, at - _STEP)
            f.seek(low)
            cut = f.read(at - low).rfind(b"\n")
            if cut >= 0:
                return low + cut + 1
            at = low
    return 0


def state_of(path: str) -> dict:
    return {"inode": os.stat(path).st_ino, "head": head_of(path), "byte": whole_lines(path)}


def rotated(path: str, inode: int) -> list[str]:
    """Files named like the path with something behind that hold the old inode or were written after it, oldest first."""
    others = sorted((os.stat(p).st_mtime_ns, p) for p in glob.glob(glob.escape(path) + ".*"))
    at = next((i for i, (_, p) in enumerate(others) if os.stat(p).st_ino == inode), None)
    return [] if at is None else [p for _, p in others[at:]]


class Range(InputPartition):
    def __init__(self, path: str, name: str, inode: int, low: int, high: int):
        self.path, self.name, self.inode, self.low, self.high = path, name, inode, low, high


def ranges(path: str, name: str, inode: int, low: int, high: int, size: int) -> list[Range]:
    return [Range(path, name, inode, at, min(high, at + size)) for at in range(low, high, size)]


def lines_of(part: Range) -> Iterator[pa.RecordBatch]:
    """Lines that start in the range, with the byte at which they do."""
    rows: list[tuple[int, str]] = []

    def batch() -> pa.RecordBatch:
        columns = [pa.array([part.name] * len(rows)), pa.array([part.inode] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["path", "inode", "byte", "value"])

    if os.stat(part.path).st_ino != part.inode:
        # Rotated since it was planned.
        found = next((p for p in rotated(part.name, part.inode) if os.stat(p).st_ino == part.inode), None)
        if found is None:
            raise FileNotFoundError(f"the file of inode {part.inode} is gone: {part.name}")
        part = Range(found, part.name, part.inode, part.low, part.high)
    with open(part.path, "rb") as f:
        at = part.low
        if at:  # the line that runs into the range belongs to the one before
            f.seek(at - 1)
            at += len(f.readline()) - 1
        while at < part.high:
            line = f.readline()
            if not line:
                break
            rows.append((at, line.rstrip(b"\r\n").decode("utf-8", "replace")))
            at += len(line)
            if len(rows) == _LINES:
                yield batch()
                rows.clear()
    if rows:
        yield batch()


class _Reader:
    def __init__(self, options: dict):
        self.pattern, self.size = options["path"], int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))

    def files(self) -> list[str]:
        return [self.pattern] if os.path.exists(self.pattern) else sorted(glob.glob(self.pattern))

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        yield from lines_of(part)


class TailReader(_Reader, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {p: state_of(p) for p in self.files()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        found = []
        for name, now in end.items():
            was = start.get(name, {"inode": now["inode"], "head": now["head"], "byte": 0})
            low = was["byte"]
            if was["inode"] != now["inode"]:
                for k, p in enumerate(rotated(name, was["inode"])):
                    inode = os.stat(p).st_ino
                    if inode != now["inode"]:
                        found += ranges(p, name, inode, low if k == 0 else 0, os.path.getsize(p), self.size)
                low = 0
            elif now["byte"] < low or was["head"] and now["head"] != was["head"]:
                low = 0
            found += ranges(name, name, now["inode"], low, now["byte"], self.size)
        return found

    def commit(self, end: dict) -> None:
        """Nothing is kept besides the offsets."""


class FileReader(_Reader, DataSourceReader):
    def partitions(self) -> list[Range]:
        return [r for p in self.files() for r in ranges(p, p, os.stat(p).st_ino, 0, os.path.getsize(p), self.size)] or [Range(os.devnull, "", os.stat(os.devnull).st_ino, 0, 0)]


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FileReader:
        return FileReader(self.options)

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(LogTail)
    return spark
