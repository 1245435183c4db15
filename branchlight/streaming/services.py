"""Sinks and guards of long-running streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources import io


def flush_cache(entries: DataFrame, path: str, checkpoint: str, every: str = "60 seconds") -> StreamingQuery:
    """A stream of cache entries (key, value) merged into a cache folder at intervals; in a batch the later of repeated keys may be either,
    against the cache the batch wins."""
    return entries.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(lambda batch, _: io.save_cache(batch.dropDuplicates(["key"]), path)).start()


def metric_sink(points: DataFrame, sinks: list[Callable[[int, list[dict]], None]], checkpoint: str, every: str = "10 seconds") -> StreamingQuery:
    """Points (key, step, value) handed to each sink as (step, metrics by key), step by step in order. Metrics of a batch are small: a few keys a step."""

    def write(batch: DataFrame, _: int) -> None:
        steps = batch.groupBy("step").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("metrics")).orderBy("step")
        for r in steps.toLocalIterator():
            for sink in sinks:
                sink(r["step"], r["metrics"])

    return points.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(write).start()


def stop_on_systemic(candidates: DataFrame) -> None:
    """Raise if an annotated batch holds a failure that no retry mends (column systemic_failure): the caller's stream ends with it."""
    found = candidates.filter("systemic_failure is not null").groupBy("systemic_failure").count().limit(5).collect()
    if found:
        raise RuntimeError(f"systemic failure: {sorted((r['systemic_failure'], r['count']) for r in found)}")
