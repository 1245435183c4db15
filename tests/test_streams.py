"""Log tails, exactly-once sinks and event state."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from branchlight.streaming import metrics, sinks, tail


def started(frame, name, ckpt):
    return frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(ckpt)).start()


def test_tail_reads_each_line_once(spark, tmp_path):
    log, out = tmp_path / "app.log", tmp_path / "out"
    raw = lambda: tail.register(spark).readStream.format("log_tail").option("path", str(log)).option("rangeBytes", "16").load()

    def run():
        q = sinks.stream_jsonl(raw().select("value", "byte"), str(out), str(tmp_path / "c"), availableNow=True)
        q.awaitTermination(120)

    def seen():
        return sorted(r["value"] for r in sinks.read_jsonl(spark, str(out), "value string, byte long").collect())

    log.write_text("step:1 - loss:3.0\nstep:2 - lo")
    run()
    assert seen() == ["step:1 - loss:3.0"]
    with log.open("a") as f:
        f.write("ss:2.0\nstep:3 - loss:1.5\n")
    run()  # a restart from the checkpoint
    assert seen() == ["step:1 - loss:3.0", "step:2 - loss:2.0", "step:3 - loss:1.5"]
    with log.open("a") as f:
        f.write("step:4 - loss:1.2\n")
    os.rename(log, f"{log}.1")
    log.write_text("step:5 - loss:1.1\n")
    run()
    assert seen() == [f"step:{i} - loss:{v}" for i, v in ((1, "3.0"), (2, "2.0"), (3, "1.5"), (4, "1.2"), (5, "1.1"))]
    log.write_text("cut\n")  # truncated in place
    run()
    run()
    assert seen()[0] == "cut" and len(seen()) == 6


def test_tail_points(spark, tmp_path):
    log = tmp_path / "m.log"
    log.write_text("step:1 - loss:3.0\nnoise\nstep:2 - loss:2")
    q = started(metrics.tail(spark, str(log)), "tailed", tmp_path / "c")
    q.processAllAvailable()
    with log.open("a") as f:
        f.write(".5\nstep:2 - loss:9\nstep:3 - loss:2.0\n")
    q.processAllAvailable()
    q.stop()
    assert sorted((r["step"], r["value"], r["change"]) for r in spark.table("tailed").collect() if r["step"] > 1) == [(2, 2.5, -0.5), (3, 2.0, -0.5)]


def test_batch_read_of_ranges(spark, tmp_path):
    log = tmp_path / "b.log"
    text = [f"line {i} " + "x" * (i % 37) for i in range(500)]
    log.write_text("\n".join(text))
    got = tail.register(spark).read.format("log_tail").option("path", str(log)).option("rangeBytes", "100").load()
    assert [r["value"] for r in got.orderBy("byte").collect()] == text
    assert tail.register(spark).read.format("log_tail").option("path", str(tmp_path / "none")).load().count() == 0


def test_jsonl_once(spark, tmp_path):
    path = str(tmp_path / "j")
    rows = spark.range(10).select("id", F.concat(F.lit("é"), "id").alias("s"))
    sinks.append_jsonl(rows, path, "one")
    sinks.append_jsonl(rows, path, "one")
    sinks.append_jsonl(rows.limit(0), path, "none")
    broken = rows.withColumn("s", F.when(F.col("id") == 9, F.raise_error(F.lit("lost task")).cast("string")).otherwise(F.col("s")))
    with pytest.raises(Exception, match="lost task"):
        sinks.append_jsonl(broken, path, "two")
    assert sinks.read_jsonl(spark, path, "id long, s string").count() == 10
    sinks.append_jsonl(rows, path, "two")
    assert sinks.read_jsonl(spark, path, "id long, s string").count() == 20


def test_half_published_batch_and_retried_commit(tmp_path):
    w = sinks.StreamWriter({"path": str(tmp_path / "s")})
    import pyarrow as pa

    batch = lambda *v: iter([pa.RecordBatch.from_arrays([pa.array(v)], names=["v"])])
    lost = w.write(batch(1, 2))
    os.makedirs(tmp_path / "s/batch=00000000")
    os.rename(tmp_path / f"s/_staging/{lost.file}", tmp_path / "s/batch=00000000/part-00000.jsonl")  # the driver died here
    w.commit([w.write(batch(1, 2))], 0)
    w.commit([w.write(batch(1, 2)), None], 0)
    w.abort([w.write(batch(3))], 1)
    assert [open(f"{d}/{f}").read() for d in sinks.committed(str(tmp_path / "s")) for f in os.listdir(d)] == ['{"v":1}\n{"v":2}\n']
    assert os.listdir(tmp_path / "s/_staging") == []


def test_stateful_sink(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text('{"v": 1}\n{"v": 2}\n')

    def handle(state, number, batch):
        return {"total": state.get("total", 0) + (batch.agg(F.sum("v")).first()[0] or 0), "batches": state.get("batches", 0) + 1}

    def run():
        sinks.stateful_sink(spark.readStream.schema("v long").json(str(source)), str(tmp_path / "s"), str(tmp_path / "c"), handle, availableNow=True).awaitTermination(120)

    run()
    (source / "b.json").write_text('{"v": 5}\n')
    run()
    run()
    last = sorted(os.listdir(tmp_path / "s/_state"))[-1]
    assert (tmp_path / "s/_state" / last).read_text() == '{"total": 8, "batches": 2}'
