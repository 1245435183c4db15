"""Evaluation statistics."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .curate import draw, global_rank
from .rounds import stored


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval of k of n; (0, 0) of none."""
    p = F.try_divide(k, n)
    middle, width = p + z * z / (2 * n), z * F.sqrt(F.greatest(p * (1 - p) / n + F.try_divide(F.lit(z * z / 4), n * n), F.lit(0.0)))
    scale = 1 + F.try_divide(F.lit(z * z), n)
    bound = lambda x: F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(x, scale)))).otherwise(0.0)
    return bound(middle - width), bound(middle + width)


def explained_variance(predicted: str, actual: str) -> Column:
    return 1 - F.var_samp(F.col(actual) - F.col(predicted)) / (F.var_samp(actual) + 1e-5)


def exact_sum(x: Column) -> Column:
    """The sum of doubles up to 1e16 to twelve decimals, the same in any order of rows; with a value that is no such number the sum of doubles."""
    whole = x.try_cast("decimal(28,12)")
    return F.when(F.count(whole) == F.count(x), F.sum(whole).cast("double")).otherwise(F.sum(x))


#: A group's values are dealt to so many buckets, by value.
BUCKETS = 64


def _resamples(pdf: pd.DataFrame, samples: int, seed: int, name: str) -> pd.DataFrame:
    """For one group with the size n of each bucket: how many of the draws of each resample fall into it, as one array a bucket."""
    pdf = pdf.sort_values("bucket")
    sizes = pdf["n"].to_numpy(np.int64)
    rng = np.random.default_rng([seed, *hashlib.sha256(str(name).encode()).digest()[:8]])
    draws = np.concatenate([rng.multinomial(sizes.sum(), sizes / sizes.sum(), size=min(500, samples - at)) for at in range(0, samples, 500)])
    return pdf.assign(draws=list(draws.T))


def bootstrap(rows: DataFrame, group: str, value: str, samples: int = 10_000, seed: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """(group, mean, low, high, n): percentile 95 % interval of the mean of each group, by resamples as large as the group.

    Equal values are counted first and dealt to buckets by a hash of the value. One multinomial draw a resample splits its size over the
    buckets; in each bucket, a task of its own, a second one splits that over the values. Both are seeded by group and bucket, so the result
    is the same however rows are partitioned. A bucket sends one sum a resample; the sums of a resample are added in the order of buckets. Null values do not count.
    """
    kind = rows.schema[group].dataType.simpleString()
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("k")).withColumn("bucket", F.pmod(F.xxhash64("v"), F.lit(buckets)).cast("int"))
    counts = stored(counts)
    sizes = counts.groupBy("g", "bucket").agg(F.sum("k").alias("n"))
    split = sizes.groupBy("g").applyInPandas(lambda pdf: _resamples(pdf, samples, seed, pdf["g"].iloc[0]), f"g {kind}, bucket int, n long, draws array<long>")

    def summed(key: tuple, values: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        if drawn.empty or values.empty:
            return pd.DataFrame({"g": [], "bucket": [], "sums": []})
        values = values.sort_values("v")
        v, share = values["v"].to_numpy(float), values["k"].to_numpy(float) / values["k"].sum()
        rng = np.random.default_rng([seed, 1, int(key[1]), *hashlib.sha256(str(key[0]).encode()).digest()[:8]])
        draws = np.asarray(drawn["draws"].iloc[0], np.int64)
        step = max(1, (1 << 22) // len(v))  # a block of draws at a time
        sums = np.concatenate([rng.multinomial(draws[at : at + step], share) @ v for at in range(0, len(draws), step)])
        return pd.DataFrame({"g": [key[0]], "bucket": [key[1]], "sums": [sums]})

    parts = counts.groupBy("g", "bucket").cogroup(split.groupBy("g", "bucket")).applyInPandas(summed, f"g {kind}, bucket int, sums array<double>")
    means = parts.select("g", "bucket", F.posexplode("sums").alias("at", "s")).groupBy("g", "at").agg(F.sort_array(F.collect_list(F.struct("bucket", "s"))).alias("x"))
    means = means.select("g", F.aggregate("x.s", F.lit(0.0), lambda a, s: a + s).alias("s"))
    whole = counts.groupBy("g").agg(F.sum("k").alias("n"), (F.sum(F.col("v") * F.col("k")) / F.sum("k")).alias("mean"))
    bounds = means.groupBy("g").agg(F.percentile("s", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return whole.join(bounds, "g").select(F.col("g").alias(group), "mean", (F.col("q")[0] / F.col("n")).alias("low"), (F.col("q")[1] / F.col("n")).alias("high"), "n")


#: Draws that fall into one block of places, on average; and draws that are made at a time.
BLOCK_DRAWS, AT_ONCE = 1 << 20, 1 << 19


def _drawn(name: str, at: list[int], n: int, samples: int, seed: int) -> np.ndarray:
    """The places that draws i of every resample take, resample after resample."""
    ends = [b"%d" % i for i in at]
    digests = bytearray()
    for r in range(samples):
        head = hashlib.sha256(f"{seed}:{name}:{r}:".encode())
        for end in ends:
            h = head.copy()
            h.update(end)
            digests += h.digest()[:8]
    # Thirteen hex digits are 52 bits.
    share = (np.frombuffer(digests, ">u8") >> np.uint64(12)).astype(np.float64) / float(16**13)
    return np.floor(share * float(n)).astype(np.int64)


def _picks(batches: Iterator[pa.RecordBatch], samples: int, seed: int, width: int, most: int) -> Iterator[pa.RecordBatch]:
    """(g, block, codes) of the draws that start from rows (g, at, n), `most` rows at a time: by blocks of `width` places, resample * width + place in the block as unsigned of 32 bits."""
    def rows() -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) >= most:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    for b in rows():
        groups, at, sizes = b.column(0).dictionary_encode(), b.column(1).to_numpy(), b.column(2).to_numpy()
        number = groups.indices.to_numpy(zero_copy_only=False)
        for g, name in enumerate(groups.dictionary.to_pylist()):
            mine = np.flatnonzero(number == g)
            for lo in range(0, len(mine), most):
                some = at[mine[lo : lo + most]].tolist()
                place = _drawn(name, some, int(sizes[mine[0]]), samples, seed)
                block, code = place // width, np.repeat(np.arange(samples), len(some)) * width + place % width
                order = np.argsort(block, kind="stable")
                found, starts = np.unique(block[order], return_index=True)
                parts = [x.tobytes() for x in np.split(code[order].astype("<u4"), starts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found), pa.array(parts, pa.binary())], names=["g", "block", "codes"])


def bootstrap_by_index(rows: DataFrame, group: str, key: list[str], value: str, samples: int, seed: int) -> DataFrame:
    """The same interval from draws that any engine can repeat: draw i of resample r takes the row whose place, in the order of a seeded draw by
    key, is floor(u * n), u from a SHA-256 of seed, group, r and i. It costs n * samples hashes; no task holds a group, and one row a group is broadcast.

    As many draws start from a row as there are resamples, so they are made where the rows are. Four bytes of each travel to the block of places it falls
    into, where they are counted and meet the values. Null values do not count in a resample, and null groups have none.
    """
    drawn = rows.filter(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"), *key).withColumn("d", draw(seed, *key))
    width, most = max(1, BLOCK_DRAWS // samples), max(1, AT_ONCE // samples)
    placed = stored(global_rank(drawn, ["g"], "d", key, "at").select("g", "v", (F.col("at") - 1).alias("at")))
    whole = stored(placed.groupBy("g").agg(F.count("*").alias("n"), F.avg("v").alias("mean")))
    starts = placed.join(F.broadcast(whole.select("g", "n")), "g").select(F.col("g").cast("string").alias("g"), "at", "n")
    picks = starts.mapInArrow(lambda batches: _picks(batches, samples, seed, width, most), "g string, block long, codes binary")
    values = placed.select(F.col("g").cast("string").alias("g"), F.floor(F.col("at") / width).alias("block"), (F.col("at") % width).alias("at"), "v")

    def summed(key: tuple, values: pd.DataFrame, picked: pd.DataFrame) -> pd.DataFrame:
        if picked.empty:
            return pd.DataFrame({"g": [], "block": [], "sums": [], "known": []})
        v = np.full(width, np.nan)
        v[values["at"].to_numpy(np.int64)] = values["v"].to_numpy(float)
        times = np.bincount(np.frombuffer(b"".join(picked["codes"]), "<u4"), minlength=samples * width).reshape(samples, width)
        has = ~np.isnan(v)
        return pd.DataFrame({"g": [key[0]], "block": [key[1]], "sums": [times[:, has] @ v[has]], "known": [times[:, has].sum(axis=1)]})

    parts = values.groupBy("g", "block").cogroup(picks.groupBy("g", "block")).applyInPandas(summed, "g string, block long, sums array<double>, known array<long>")
    each = parts.select("g", "block", F.posexplode(F.arrays_zip("sums", "known")).alias("r", "x")).groupBy("g", "r").agg(F.array_sort(F.collect_list(F.struct("block", "x.sums"))).alias("s"), F.sum("x.known").alias("k"))
    means = each.select("g", (F.aggregate("s.sums", F.lit(0.0), lambda a, x: a + x) / F.nullif("k", F.lit(0))).alias("m"))
    bounds = means.groupBy(F.col("g").alias("__g")).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return whole.join(bounds, F.col("g").cast("string") == F.col("__g")).select(F.col("g").alias(group), "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "n")


def paired_lifts(rows: DataFrame, key: str, arms: str, metrics: list[str], real: str, baselines: list[str], samples: int, seed: int) -> DataFrame:
    """(metric, baseline, n, mean, low, high) of real minus baseline over the keys that both have. rows: one for each key and arm, with the metrics."""
    wide = rows.groupBy(key).agg(*[F.max(F.when(F.col(arms) == a, F.col(m))).alias(f"{a}_{m}") for a in (real, *baselines) for m in metrics])
    name = lambda arm, m: F.col(f"`{arm}_{m}`").cast("double")
    pairs = F.array(*[F.struct(F.lit(f"{m}:{b}").alias("what"), (name(real, m) - name(b, m)).alias("delta")) for m in metrics for b in baselines])
    deltas = wide.select(F.col(key).alias("key"), F.explode(pairs).alias("p")).select("key", "p.what", "p.delta").filter("delta is not null")
    got = bootstrap_by_index(deltas, "what", ["key"], "delta", samples, seed)
    return got.select(F.substring_index("what", ":", 1).alias("metric"), F.substring_index("what", ":", -1).alias("baseline"), "n", "mean", "low", "high")


def strict_gate(lifts: DataFrame, valid_rate: float, leak_rate: float, least_lift: float, sure_against: list[str], least_valid: float = 0.8, most_leak: float = 0.05) -> DataFrame:
    """One row of checks and gate_pass: the hit lift over each baseline, its lower bound and the lift of the reciprocal rank over `sure_against`, the share
    of valid and of leaking texts. lifts: paired_lifts() with the metrics hit and mrr."""
    sure = F.col("baseline").isin(*sure_against)
    hit, mrr = F.col("metric") == "hit", F.col("metric") == "mrr"
    checks = {"hit_check": F.bool_and(F.when(hit, F.col("mean") >= least_lift)), "ci_check": F.bool_and(F.when(hit & sure, F.col("low") >= 0)), "mrr_check": F.bool_and(F.when(mrr & sure, F.col("mean") > 0))}
    got = lifts.agg(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()])
    got = got.withColumns({"valid_check": F.lit(valid_rate >= least_valid), "leak_check": F.lit(leak_rate <= most_leak)})
    return got.withColumn("gate_pass", F.col("hit_check") & F.col("ci_check") & F.col("mrr_check") & F.col("valid_check") & F.col("leak_check"))


def arm_report(rows: DataFrame, uid: str, arm: str, right: str, answered: str) -> DataFrame:
    """By arm, over the uids that all arms have: uids, samples, em and answered (shares of samples), pass_at_k (share of uids with any right)."""
    arms = rows.select(arm).distinct().count()
    by = rows.groupBy(arm, uid).agg(F.count("*").alias("k"), F.count_if(right).alias("c"), F.count_if(answered).alias("a"))
    shared = by.groupBy(uid).agg(F.count("*").alias("__arms")).filter(F.col("__arms") == arms).select(uid)
    got = by.join(shared, uid).groupBy(arm)
    return got.agg(F.count("*").alias("uids"), F.sum("k").alias("samples"), (F.sum("c") / F.sum("k")).alias("em"), (F.sum("a") / F.sum("k")).alias("answered"), F.avg((F.col("c") > 0).cast("double")).alias("pass_at_k"))


def retrieval_overlap(found: Column, gold: Column) -> dict[str, Column]:
    """Of titles found against gold ones: recall, jaccard, any and all; nothing found and no gold agree in nothing."""
    both, either = F.size(F.array_intersect(found, gold)), F.size(F.array_union(found, gold))
    n = F.size(F.array_distinct(gold))
    return {"recall": F.coalesce(F.try_divide(both, n), F.lit(0.0)), "jaccard": F.coalesce(F.try_divide(both, either), F.lit(0.0)), "any_hit": both > 0, "all_hit": (n > 0) & (both == n)}


def absolute_changes(old: DataFrame, new: DataFrame, metrics: list[str], judged: list[str]) -> DataFrame:
    """One row of two one-row summaries: the change of each metric, null if either lacks it, and whether the judged ones rose."""
    both = old.select(*[F.col(m).alias(f"old_{m}") for m in metrics]).crossJoin(F.broadcast(new.select(*[F.col(m).alias(f"new_{m}") for m in metrics])))
    change = {m: F.col(f"new_{m}") - F.col(f"old_{m}") for m in metrics}
    return both.select(*[c.alias(f"{m}_absolute_change") for m, c in change.items()], *[(change[m] > 0).alias(f"{m}_improved") for m in judged])
