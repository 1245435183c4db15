"""Metric logs: encode, parse, and follow as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from .tail import register


def encode(step: Column, metrics: Column) -> Column:
    """`step:<int> - key:<float> - key:<float>` of a map, keys sorted."""
    pairs = F.transform(F.array_sort(F.map_entries(metrics)), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return F.array_join(F.concat(F.array(F.concat(F.lit("step:"), step.cast("string"))), pairs), " - ")


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """(step, key, value) of log lines; colour codes are dropped, and so is what is no finite number."""
    bare = F.regexp_replace(column, r"\x1b\[[0-9;]*m", "")
    step = F.regexp_extract(bare, r"step:(\d+)", 1).try_cast("long")
    fields = F.filter(F.split(bare, " - "), lambda f: ~F.trim(f).startswith("step:"))
    got = lines.select(step.alias("step"), F.explode(fields).alias("f")).filter("step is not null")
    value = F.element_at(F.split("f", ":"), -1).try_cast("double")
    got = got.select("step", F.trim(F.regexp_extract("f", r"^(.*):[^:]*$", 1)).alias("key"), value.alias("value"))
    return got.filter((F.col("key") != "") & F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < F.lit(float("inf"))))


def with_change(points: DataFrame) -> DataFrame:
    """points with the change against the step before of the same key; of repeated steps the last value counts."""
    w = Window.partitionBy("key").orderBy("step")
    return points.withColumn("change", F.col("value") - F.lag("value").over(w))


def advancing(points: DataFrame) -> DataFrame:
    """A stream of points (key, step, value) with their change; a step that is not later than the last one seen of its key is
    stale and dropped. State per key is its last step and value."""

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, previous = state.get if state.exists else (-1, float("nan"))
        rows = pd.concat(list(frames)).sort_values("step")
        out = []
        for step, value in zip(rows["step"], rows["value"], strict=True):
            if step > last:
                out.append((key[0], int(step), float(value), float(value - previous) if last >= 0 else None))
                last, previous = int(step), float(value)
        state.update((last, previous))
        yield pd.DataFrame(out, columns=["key", "step", "value", "change"])

    return points.groupBy("key").applyInPandasWithState(advance, "key string, step long, value double, change double", "last long, previous double", "append", "NoTimeout")


def follow(spark: SparkSession, folder: str) -> DataFrame:
    """advancing() points of a growing folder of finished log files."""
    return advancing(parse(spark.readStream.text(folder)))


def tail(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """advancing() points of log files that are being written: appended lines, lines in two parts, rotation and truncation; see streaming.tail."""
    return advancing(parse(register(spark).readStream.format("log_tail").option("path", path).options(**options).load()))
