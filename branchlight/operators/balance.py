"""Balanced partitions of sequence lengths, by the largest differencing method and greedily."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differencing(lengths: Sequence[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """Indices in k parts of near-equal sum: the two partial partitions that spread most are merged, the
    heaviest part of one with the lightest of the other, until one is left. With equal_size the parts hold
    as many indices each, and k must divide their number."""
    if k < 1 or len(lengths) < k or equal_size and len(lengths) % k:
        raise ValueError("lengths cannot be parted so")
    empty = [(0, ()) for _ in range(k)]
    ordered = sorted((int(n), i) for i, n in enumerate(lengths))
    if equal_size:
        states = [sorted(((n, (i,)) for n, i in ordered[at : at + k]), reverse=True) for at in range(0, len(ordered), k)]
    else:
        states = [[(n, (i,)), *empty[1:]] for n, i in ordered]
    heap = [(parts[-1][0] - parts[0][0], at, parts) for at, parts in enumerate(states)]
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        parts = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True)), key=lambda p: (-p[0], p[1]))
        heapq.heappush(heap, (parts[-1][0] - parts[0][0], serial, parts))
        serial += 1
    return sorted(sorted(p[1]) for p in heap[0][2])


def greedy(lengths: Sequence[int], k: int) -> list[list[int]]:
    """Each length, as it comes, to the part with the least sum."""
    parts: list[list[int]] = [[] for _ in range(k)]
    heap = [(0, i) for i in range(k)]
    for i, n in enumerate(lengths):
        total, at = heapq.heappop(heap)
        parts[at].append(i)
        heapq.heappush(heap, (total + int(n), at))
    return parts


def balance(rows: DataFrame, group: str, key: str, length: str, k: int, method: str = "differencing") -> DataFrame:
    """rows with `part`: each group (a batch, of bounded size) is parted by itself. A group is one row of its members in order of the key; batches of
    groups go to Python with their lengths alone."""

    @F.arrow_udf("array<int>")
    def parted(column: pa.Array) -> pa.Array:
        made = []
        for sizes in column.to_pylist():
            found = greedy(sizes, k) if method == "greedy" else differencing(sizes, min(k, len(sizes)))
            parts = [0] * len(sizes)
            for at, members in enumerate(found):
                for i in members:
                    parts[i] = at
            made.append(parts)
        return pa.array(made, pa.list_(pa.int32()))

    rest = [c for c in rows.columns if c not in (group, key)]
    # An item begins with its key and length, so that items can be sorted whatever else a row holds; a missing key sorts last.
    item = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col(length).alias("length"), F.struct(*rest).alias("rest"))
    held = rows.groupBy(group).agg(F.sort_array(F.collect_list(item)).alias("items"))
    held = held.withColumn("parts", parted.asNondeterministic()(F.col("items.length")))
    return held.select(group, F.explode(F.arrays_zip("items", "parts")).alias("x")).select(group, F.col("x.items.key").alias(key), *[F.col("x.items.rest")[c].alias(c) for c in rest], F.col("x.parts").alias("part"))


def imbalance(parted: DataFrame, length: str) -> DataFrame:
    """Smallest, mean and largest sum of a group's parts."""
    sums = parted.groupBy("group", "part").agg(F.sum(length).alias("total"))
    return sums.groupBy("group").agg(F.min("total").alias("least"), F.avg("total").alias("mean"), F.max("total").alias("most"))
