"""Calls to an outside service, many at a time and each key once, with time limits, back-off and a budget of retries."""

from __future__ import annotations

import queue
import random
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.io import cache_misses

RESULT = "value string, error string, attempts int"


@dataclass(frozen=True)
class Limits:
    """parallel: calls at a time in a task. attempts: calls for a key at most. timeout: seconds until a call is given up. first_wait: seconds before
    the first retry, doubled with each and spread by up to half. retries, retry_share: a task may retry `retries` times and once more for each
    1 / retry_share calls, so that a service that is down is not called `attempts` times for every key."""

    parallel: int = 8
    attempts: int = 3
    timeout: float = 60.0
    first_wait: float = 0.5
    retries: int = 20
    retry_share: float = 0.2


class _Budget:
    def __init__(self, limits: Limits):
        self.limits, self.calls, self.used, self.lock = limits, 0, 0, threading.Lock()

    def called(self) -> None:
        with self.lock:
            self.calls += 1

    def retry(self) -> bool:
        with self.lock:
            allowed = self.used < self.limits.retries + self.limits.retry_share * self.calls
            self.used += allowed
            return allowed


def timed(fetcher: Callable[[str], str], key: str, timeout: float) -> tuple[str | None, str | None]:
    """(value, error) of one call. A call that hangs is left to its thread, which does not keep the task alive."""
    box: queue.SimpleQueue = queue.SimpleQueue()

    def call() -> None:
        try:
            box.put((fetcher(key), None))
        except Exception as e:  # the service's failures are results
            box.put((None, f"{type(e).__name__}: {e}"))

    threading.Thread(target=call, daemon=True).start()
    try:
        return box.get(timeout=timeout)
    except queue.Empty:
        return None, f"timeout after {timeout:g} s"


def attempted(fetcher: Callable[[str], str], key: str, limits: Limits, budget: _Budget) -> tuple[str | None, str | None, int]:
    wait = limits.first_wait
    for n in range(1, limits.attempts + 1):
        budget.called()
        value, error = timed(fetcher, key, limits.timeout)
        if error is None or n == limits.attempts or not budget.retry():
            return value, error, n
        time.sleep(wait * random.uniform(1.0, 1.5))
        wait *= 2
    raise ValueError("attempts must be at least one")


def together(fetcher: Callable[[str], str], keys: list[str], limits: Limits, budget: _Budget) -> list[tuple[str | None, str | None, int]]:
    """Results in the order of the keys."""
    found: list = [None] * len(keys)
    left = iter(range(len(keys)))
    lock = threading.Lock()

    def work() -> None:
        while True:
            with lock:
                i = next(left, None)
            if i is None:
                return
            found[i] = attempted(fetcher, keys[i], limits, budget)

    workers = [threading.Thread(target=work, daemon=True) for _ in range(min(limits.parallel, len(keys)))]
    for w in workers:
        w.start()
    for w in workers:
        w.join()
    return found


def fetch(queries: DataFrame, fetcher: Callable[[str], str], key: str = "key", limits: Limits = Limits(), tasks: int | None = None) -> DataFrame:
    """(key, value, error, attempts) for each distinct key that is not null. A key that could not be fetched is a row with its last error and no value;
    nothing is raised. tasks: how many tasks call at once, so that at most tasks * parallel calls are under way."""
    names = queries.select(F.col(key).cast("string").alias("key")).filter("key is not null").distinct()
    names = names.repartition(tasks, "key") if tasks else names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        budget = _Budget(limits)
        for b in batches:
            keys = b.column(0).to_pylist()
            found = together(fetcher, keys, limits, budget)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32())))], names=["key", "value", "error", "attempts"])

    return names.mapInArrow(run, f"key string, {RESULT}").withColumnRenamed("key", key)


def through_cache(queries: DataFrame, cache: DataFrame, fetcher: Callable[[str], str], key: str = "key", limits: Limits = Limits(), tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """queries with value and error, from the cache or fetched; and what was fetched without error, to be saved. The fetched rows are written down
    first, so that no key is fetched for the one and again for the other."""
    from .rounds import stored

    got = stored(fetch(cache_misses(queries.filter(F.col(key).isNotNull()), cache, key), fetcher, key, limits, tasks))
    known = cache.select(key, "value", F.lit(None).cast("string").alias("error")).unionByName(got.select(key, "value", "error"))
    return queries.join(known, key, "left"), got.filter("error is null").select(key, "value")
