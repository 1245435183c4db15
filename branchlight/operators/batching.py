"""Dynamic batches: rows of a request packed by padded tokens, and the way back to the order that they came in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pack(rows: DataFrame, request: str, order: list[str], length: str, budget: int, by_length: bool = False, chunk: int | None = None) -> DataFrame:
    """rows with row_idx (place in the request as it came), batch, slot, place (in the request as packed) and width (the longest row of the batch).

    Rows join a batch, one after the other, until one more would make rows times width exceed the budget; a row that alone exceeds it is a batch by
    itself. With by_length the longest come first, so that rows of a batch are of like length and little is padding. Rows of a request stream
    through one task, which remembers the batch it fills and nothing else. A request of any number of rows is cut every `chunk` rows into
    requests of its own, if that is given; batch and place then count within (request, piece), and `piece` comes along.
    A length that is null or less than one is an error.
    """
    at = F.row_number().over(Window.partitionBy(request).orderBy(*order)) - 1
    numbered = rows.withColumn("row_idx", at)
    numbered = numbered.withColumn("piece", F.floor(F.col("row_idx") / chunk).cast("int") if chunk else F.lit(0))
    keys = [request, "piece"] if chunk else [request]
    sorted_rows = numbered.repartition(*keys).sortWithinPartitions(*keys, *([F.desc(length)] if by_length else []), "row_idx")
    columns = sorted_rows.columns

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, number, count, widest, place = None, 0, 0, 0, 0
        for b in batches:
            owners = list(zip(*(b.column(columns.index(k)).to_pylist() for k in keys), strict=True))
            found = np.empty((3, len(b)), np.int32)
            for i, (owner, n) in enumerate(zip(owners, b.column(columns.index(length)).to_pylist(), strict=True)):
                if n is None or n < 1:
                    raise ValueError(f"row length must be positive, not {n}")
                if owner != current:
                    current, number, count, widest, place = owner, 0, 0, 0, 0
                elif (count + 1) * max(widest, n) > budget:
                    number, count, widest = number + 1, 0, 0
                found[:, i] = number, count, place
                count, widest, place = count + 1, max(widest, n), place + 1
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x) for x in found)], names=[*columns, "batch", "slot", "place"])

    schema = sorted_rows.schema.simpleString()[len("struct<") : -1] + ",batch:int,slot:int,place:int"
    got = sorted_rows.mapInArrow(packed, f"struct<{schema}>")
    got = got.withColumn("width", F.max(length).over(Window.partitionBy(*keys, "batch")))
    return got if chunk else got.drop("piece")


def window_positions(positions: Column, length: Column, width: Column, keep: Column) -> Column:
    """Asked positions of a row, as its batch has them: padded on the left to the width, of which the last `keep` columns are computed."""
    return F.transform(positions, lambda p: p + (width - length) - (width - keep))


def kept_tail(rows: DataFrame, keys: list[str], positions: str, length: str) -> DataFrame:
    """rows of packed batches with `keep`: how many columns at the end of the batch hold all positions asked for (one at least, the width at most)."""
    need = F.max(F.when(F.size(positions) > 0, F.col(length) - F.array_min(positions))).over(Window.partitionBy(*keys, "batch"))
    return rows.withColumn("keep", F.least(F.coalesce(need, F.lit(1)), F.col("width")))


def restore(results: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    """results (keys, place, ...) with the row_idx that their rows had; a place without a result, or two, is an error."""
    mine = results.groupBy(*keys, "place").agg(F.count("*").alias("__n"), F.first(F.struct(*[c for c in results.columns if c not in (*keys, "place")])).alias("__r"))
    met = plan.select(*keys, "place", "row_idx").join(mine, [*keys, "place"], "full")
    wrong = F.when(F.coalesce("__n", F.lit(0)) != 1, F.raise_error(F.concat(F.lit("results of a place: "), F.coalesce("__n", F.lit(0)).cast("string"))).cast("int")).when(F.col("row_idx").isNull(), F.raise_error(F.lit("a result that no row asked for")).cast("int"))
    return met.select(*keys, F.coalesce(wrong, "row_idx").alias("row_idx"), "__r.*")


def micro_batches(total: Column, budget: int) -> Column:
    """How many batches of the budget hold so many tokens."""
    return F.ceil(total / budget)
