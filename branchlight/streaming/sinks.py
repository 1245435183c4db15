"""JSON lines written once: a sink for batches and streams whose tasks stage files and whose driver publishes them.

A task writes its rows to a file of its own in `_staging` and reports the name. When all tasks are done the driver moves the files into
`batch=<number>` (streams) or `batch=<id of the write>` and then creates `_commits/<batch>`, which makes them count. A task that was killed leaves
no more than a staged file; a batch that is run again after it was committed is dropped, and one that was half moved is published anew. Readers take
the files of committed batches: `read_jsonl`.

A stateful sink is a function with a state of its own: `stateful_sink` calls it with (state, batch number, rows) once for each batch and keeps
the state in the same commit. Paths are any that pyarrow's file systems know, or local ones that all machines mount.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming.query import StreamingQuery


def place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}") if "://" in path or path.startswith("/") else (pafs.LocalFileSystem(), path)


def exists(fs: pafs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type != pafs.FileType.NotFound


def write_text(fs: pafs.FileSystem, path: str, text: str) -> None:
    """A file that is there whole or not at all."""
    staged = f"{path}.{uuid4()}"
    with fs.open_output_stream(staged) as out:
        out.write(text.encode())
    fs.move(staged, path)


@dataclass
class Staged(WriterCommitMessage):
    file: str
    rows: int


class _Writer:
    def __init__(self, options: dict):
        self.path, self.write_id = options["path"].rstrip("/"), options.get("batch") or uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        fs, base = place(self.path)
        fs.create_dir(f"{base}/_staging", recursive=True)
        name, rows = f"{uuid4().hex}.jsonl", 0
        with fs.open_output_stream(f"{base}/_staging/{name}") as out:
            for batch in iterator:
                rows += len(batch)
                out.write("".join(json.dumps(r, ensure_ascii=False, default=str, separators=(",", ":")) + "\n" for r in batch.to_pylist()).encode())
        return Staged(name, rows)

    def publish(self, messages: list[Staged | None], batch: str) -> None:
        fs, base = place(self.path)
        done = f"{base}/_commits/{batch}"
        if exists(fs, done):
            return self.discard(messages)
        folder = f"{base}/batch={batch}"
        if exists(fs, folder):  # half moved by a driver that was lost
            fs.delete_dir(folder)
        fs.create_dir(folder, recursive=True)
        fs.create_dir(f"{base}/_commits", recursive=True)
        staged = [m for m in messages if m]
        for k, m in enumerate(staged):
            if m.rows:
                fs.move(f"{base}/_staging/{m.file}", f"{folder}/part-{k:05d}.jsonl")
            else:
                fs.delete_file(f"{base}/_staging/{m.file}")
        write_text(fs, done, json.dumps({"rows": sum(m.rows for m in staged), "files": sum(m.rows > 0 for m in staged)}))

    def discard(self, messages: list[Staged | None]) -> None:
        fs, base = place(self.path)
        for m in messages:
            if m and exists(fs, f"{base}/_staging/{m.file}"):
                fs.delete_file(f"{base}/_staging/{m.file}")


class BatchWriter(_Writer, DataSourceArrowWriter):
    def commit(self, messages: list[Staged | None]) -> None:
        self.publish(messages, self.write_id)

    def abort(self, messages: list[Staged | None]) -> None:
        self.discard(messages)


class StreamWriter(_Writer, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        self.publish(messages, f"{batchId:08d}")

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        self.discard(messages)


class JsonLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "jsonl_once"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> BatchWriter:
        return BatchWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options)


def append_jsonl(df: DataFrame, path: str, batch: str | None = None) -> None:
    """Rows as JSON lines, all or none. Of writes that name the same batch the first counts."""
    df.sparkSession.dataSource.register(JsonLines)
    w = df.write.format("jsonl_once").mode("append").option("path", path)
    (w.option("batch", batch) if batch else w).save()


def stream_jsonl(df: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    df.sparkSession.dataSource.register(JsonLines)
    w = df.writeStream.format("jsonl_once").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(**trigger) if trigger else w).start()


def committed(path: str) -> list[str]:
    """Folders of the committed batches, in order of their names."""
    fs, base = place(path.rstrip("/"))
    if not exists(fs, f"{base}/_commits"):
        return []
    names = sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(f"{base}/_commits")) if "." not in f.base_name)
    return [f"{path.rstrip('/')}/batch={n}" for n in names if exists(fs, f"{base}/batch={n}")]


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of committed batches."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("pathGlobFilter", "*.jsonl").json(committed(path)) if committed(path) else spark.createDataFrame([], schema)


def stateful_sink(df: DataFrame, path: str, checkpoint: str, handle: Callable[[dict, int, DataFrame], dict], **trigger) -> StreamingQuery:
    """handle(state, batch number, batch) -> new state, for each batch; state is JSON in `path`/_state/<batch>. A batch whose state is there was
    handled and is passed over, so what handle writes under the batch's number counts once."""

    def run(batch: DataFrame, number: int) -> None:
        fs, base = place(path.rstrip("/"))
        fs.create_dir(f"{base}/_state", recursive=True)
        if exists(fs, f"{base}/_state/{number:08d}"):
            return
        known = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(f"{base}/_state")) if "." not in f.base_name)
        state = json.loads(fs.open_input_stream(known[-1]).read()) if known else {}
        write_text(fs, f"{base}/_state/{number:08d}", json.dumps(handle(state, number, batch)))

    w = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    return (w.trigger(**trigger) if trigger else w).start()
