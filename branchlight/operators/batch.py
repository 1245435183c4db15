"""Algebra of batches: DataFrames whose rows are numbered 0 to n - 1 in `row_idx`."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .curate import draw, global_rank

ROW = "row_idx"


def select(batch: DataFrame, columns: list[str]) -> DataFrame:
    return batch.select(ROW, *columns)


def pop(batch: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The columns as a batch of their own, and the batch without them."""
    return batch.select(ROW, *columns), batch.drop(*columns)


def rename(batch: DataFrame, names: dict[str, str]) -> DataFrame:
    missing = set(names) - set(batch.columns)
    if missing:
        raise KeyError(f"no columns {sorted(missing)}")
    return batch.withColumnsRenamed(names)


def subset(batch: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows listed as (at, row_idx), renumbered by at; columns that belong to rows go with them. A row may be listed twice."""
    return batch.join(rows.select(ROW, "at"), ROW).withColumn(ROW, F.col("at")).drop("at")


def size(batch: DataFrame) -> int:
    return batch.agg(F.coalesce(F.max(ROW) + 1, F.lit(0))).first()[0]


def pad_to_divisor(batch: DataFrame, divisor: int, n: int) -> tuple[DataFrame, int]:
    """The batch of n rows with rows from its head, as often as it takes, up to a multiple of divisor; and how many were added."""
    pad = -n % divisor if n else 0
    if not pad:
        return batch, 0
    times = F.sequence(F.lit(0).cast("long"), F.floor((F.lit(pad - 1) - F.col(ROW)) / n))
    extra = batch.filter(F.col(ROW) < pad).withColumn("__k", F.explode(times)).withColumn(ROW, F.col(ROW) + n * (F.col("__k") + 1)).drop("__k")
    return batch.unionByName(extra), pad


def unpad(batch: DataFrame, n: int, pad: int) -> DataFrame:
    return batch.filter(F.col(ROW) < n - pad) if pad else batch


def chunk(batch: DataFrame, chunks: int, n: int, rest: bool = False) -> DataFrame:
    """The batch with `chunk`, its number among equal runs of rows. Rows that equal runs leave over are an error, or with rest further chunks behind them."""
    if n % chunks and (n < chunks or not rest):
        raise ValueError(f"{n} rows do not make {chunks} equal chunks")
    return batch.withColumn("chunk", F.floor(F.col(ROW) / max(1, n // chunks)))


def fold(batch: DataFrame, rows: int, n: int) -> DataFrame:
    """Every n / rows neighbours nested in one row, as arrays."""
    if n % rows:
        raise ValueError(f"{n} rows do not fold into {rows}")
    return fold_by(batch, n // rows)


def fold_by(batch: DataFrame, width: int) -> DataFrame:
    """Every width neighbours nested in one row, as arrays; the last row may hold fewer."""
    inner = [c for c in batch.columns if c != ROW]
    nested = batch.groupBy(F.floor(F.col(ROW) / width).alias("__row")).agg(F.array_sort(F.collect_list(F.struct(ROW, *inner))).alias("__r"))
    return nested.select(F.col("__row").alias(ROW), *[F.col(f"__r.{c}").alias(c) for c in inner])


def unfold(folded: DataFrame, width: int) -> DataFrame:
    """fold() undone, for rows that hold width neighbours each."""
    inner = [c for c in folded.columns if c != ROW]
    rows = folded.select(ROW, F.posexplode(F.arrays_zip(*inner)).alias("__at", "__r"))
    return rows.select((F.col(ROW) * width + F.col("__at")).alias(ROW), "__r.*")


def lists(batch: DataFrame) -> DataFrame:
    """One row with a list for each column, in row order; for small batches, as it is one value."""
    inner = [c for c in batch.columns if c != ROW]
    return batch.agg(F.array_sort(F.collect_list(F.struct(ROW, *inner))).alias("__r")).select(*[F.col(f"__r.{c}").alias(c) for c in inner])


def rows_of_lists(lists: DataFrame, key: str | None = None) -> DataFrame:
    """The rows of lists again, numbered from zero (within the key, if rows of lists have one); lists of unequal length are an error."""
    names = [c for c in lists.columns if c != key]
    size = F.size(names[0])
    same = F.lit(True)
    for c in names[1:]:
        same = same & (F.size(c) == size)
    zipped = F.when(same, F.arrays_zip(*names)).otherwise(F.raise_error(F.lit("lists of unequal length")).cast("array<struct<" + ",".join(f"{c}:{lists.schema[c].dataType.elementType.simpleString()}" for c in names) + ">>"))
    return lists.select(*([key] if key else []), F.posexplode(zipped).alias(ROW, "__r")).select(*([key] if key else []), ROW, *[F.col(f"__r.{c}").alias(c) for c in names])


def lists_by(rows: DataFrame, key: str) -> DataFrame:
    """A row for each key with a list for each other column, in row order: what lists() is for a whole batch, for groups of bounded size."""
    inner = [c for c in rows.columns if c not in (key, ROW)]
    got = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(ROW, *inner))).alias("__r"))
    return got.select(key, *[F.col(f"__r.{c}").alias(c) for c in inner])


def size_report(batch: DataFrame) -> DataFrame:
    """(column, values, missing, bytes): non-null values of each column and the bytes that they take as UTF-8 text, arrays by their elements."""
    def width(f):
        c = F.col(f.name)
        if f.dataType.typeName() == "array":
            return F.aggregate(F.transform(c, lambda x: F.octet_length(x.cast("string")).cast("long")), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0).cast("long")))
        return F.octet_length(c.cast("string")).cast("long")

    sums = batch.agg(*[F.struct(F.count(f.name).alias("values"), F.count_if(F.col(f.name).isNull()).alias("missing"), F.coalesce(F.sum(width(f)), F.lit(0)).alias("bytes")).alias(f.name) for f in batch.schema.fields])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in batch.columns])).alias("x")).select("x.column", "x.s.*")


def mini_batches(batch: DataFrame, rows: int, epochs: int, seed: int | None = None) -> DataFrame:
    """The batch once for each epoch, with `epoch` and `step`: shuffled anew by a seeded draw, or in order without a seed."""
    passes = batch.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    if seed is None:
        return passes.withColumn("step", F.floor(F.col(ROW) / rows))
    passes = passes.withColumn("__draw", draw(seed, "epoch", ROW))
    return global_rank(passes, ["epoch"], "__draw", [ROW], "__at").withColumn("step", F.floor((F.col("__at") - 1) / rows)).drop("__at", "__draw")


def each(batches: DataFrame) -> Iterator[DataFrame]:
    """The mini-batches in turn; each is read when it is its turn."""
    for r in batches.select("epoch", "step").distinct().orderBy("epoch", "step").toLocalIterator():
        yield batches.filter((F.col("epoch") == r["epoch"]) & (F.col("step") == r["step"]))


def consistency(batch: DataFrame) -> DataFrame:
    """One row: rows, distinct and missing row numbers. A sound batch has as many distinct as rows and none missing."""
    return batch.agg(F.count("*").alias("n_rows"), F.countDistinct(ROW).alias("n_distinct"), (F.coalesce(F.max(ROW) + 1, F.lit(0)) - F.countDistinct(ROW)).alias("n_missing"))


def from_columns(columns: list[DataFrame]) -> DataFrame:
    """One batch of several that must have the same rows: a row that one of them lacks is an error."""
    out = columns[0].withColumn("__in0", F.lit(True))
    for i, c in enumerate(columns[1:], 1):
        out = out.join(c.withColumn(f"__in{i}", F.lit(True)), ROW, "full")
    whole = F.lit(True)
    for i in range(len(columns)):
        whole = whole & F.col(f"__in{i}").isNotNull()
    names = [c for c in out.columns if not c.startswith("__in")]
    return out.select(*[F.when(whole, F.col(c)).otherwise(F.raise_error(F.lit("batches of unequal length")).cast(out.schema[c].dataType)).alias(c) if c == ROW else F.col(c) for c in names])


def concat(batches: list[tuple[DataFrame, int]]) -> DataFrame:
    """Batches (with their sizes) one after the other. Columns must be the same; arrays keep their own lengths."""
    first = set(batches[0][0].columns)
    out, before = None, 0
    for b, n in batches:
        if set(b.columns) != first:
            raise ValueError(f"columns differ: {sorted(first ^ set(b.columns))}")
        moved = b.withColumn(ROW, F.col(ROW) + before)
        out = moved if out is None else out.unionByName(moved)
        before += n
    return out


def padded_right(values: Column, width: Column, filler) -> Column:
    """An array filled up to a width; ragged arrays need none of this until they leave for a dense consumer."""
    return F.concat(values, F.array_repeat(F.lit(filler), F.greatest(F.lit(0), width - F.size(values))))


def preference_pair(prompt: Column, answer: Column, length: int, eos: int, filler: int = 0) -> Column:
    """Token ids of prompt, answer and end mark, cut or filled up on the right to a length."""
    whole = F.concat(prompt, answer, F.array(F.lit(eos)))
    return padded_right(F.slice(whole, 1, length), F.lit(length), filler)
