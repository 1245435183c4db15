"""Dataset curation: de-duplication, splits, samples and contracts. Order is always an explicit column."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rounds import stored


def draw(seed: int, *key: str) -> Column:
    """A repeatable random order: 13 hex digits of a SHA-256 over seed and key, the same in any engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 13)


def ranked(rows: DataFrame, by: list[str], order: list, into: str) -> DataFrame:
    return rows.withColumn(into, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def first_per_key(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key; order may descend, which keeps the last or the largest."""
    return ranked(rows, key, order, "__at").filter("__at = 1").drop("__at")


def global_rank(rows: DataFrame, by: list[str], drawn: str, ties: list[str], into: str) -> DataFrame:
    """rows with their place (from one) in the order of a hex draw within each group, however large the groups are: the rank among
    rows whose draws begin alike, and the sizes of the beginnings before. There are 4096 beginnings a group, so as many rows are broadcast."""
    start = rows.withColumn("__p", F.substring(drawn, 1, 3))
    before = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = start.groupBy(*by, "__p").agg(F.count("*").alias("__k")).withColumn("__before", F.coalesce(F.sum("__k").over(before), F.lit(0))).drop("__k")
    at = F.row_number().over(Window.partitionBy(*by, "__p").orderBy(drawn, *ties))
    return start.withColumn("__near", at).join(sizes, [*by, "__p"]).withColumn(into, F.col("__near") + F.col("__before")).drop("__near", "__before", "__p")


def numbered(rows: DataFrame, key: str, into: str, buckets: int = 1024) -> DataFrame:
    """rows with their place (from zero) in the order of a whole-number key: the rank within one of equally wide ranges of keys, and the
    sizes of the ranges before. As many rows as ranges are broadcast; keys that crowd in one range crowd in one task."""
    ends = rows.agg(F.min(key).alias("__lo"), F.max(key).alias("__hi"))  # one row
    cut = rows.crossJoin(F.broadcast(ends)).withColumn("__b", F.floor((F.col(key) - F.col("__lo")) * buckets / (F.col("__hi") - F.col("__lo") + 1))).drop("__lo", "__hi")
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("__b").agg(F.count("*").alias("__k")).withColumn("__before", F.coalesce(F.sum("__k").over(before), F.lit(0))).drop("__k")
    at = F.row_number().over(Window.partitionBy("__b").orderBy(key)) - 1
    return cut.withColumn("__near", at).join(F.broadcast(sizes), "__b").withColumn(into, F.col("__near") + F.col("__before")).drop("__near", "__before", "__b")


def running_sum(rows: DataFrame, by: list[str], key: str, order: list[str], value: str, into: str, buckets: int = 1024) -> DataFrame:
    """rows with the sum of value up to each, within its group and in the order of a whole-number key and then of the rest of the order: the
    sum within one of equally wide ranges of keys, and the sums of the ranges before. So a group of any size is many tasks."""
    ends = rows.agg(F.min(key).alias("__lo"), F.max(key).alias("__hi"))  # one row
    cut = rows.crossJoin(F.broadcast(ends)).withColumn("__b", F.floor((F.col(key) - F.col("__lo")) * buckets / (F.col("__hi") - F.col("__lo") + 1))).drop("__lo", "__hi")
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*by, "__b").agg(F.sum(value).alias("__k")).withColumn("__before", F.coalesce(F.sum("__k").over(before), F.lit(0))).drop("__k")
    within = F.sum(value).over(Window.partitionBy(*by, "__b").orderBy(key, *order).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("__in", within).join(sums, [*by, "__b"]).withColumn(into, F.col("__in") + F.col("__before")).drop("__in", "__before", "__b")


def sample_per_group(rows: DataFrame, group: str, key: list[str], n: int, seed: int) -> DataFrame:
    """min(n, size) rows of each group, by a seeded draw."""
    return ranked(rows.withColumn("__draw", draw(seed, *key)), [group], ["__draw", *key], "__at").filter(F.col("__at") <= n).drop("__draw", "__at")


def split_by_group(rows: DataFrame, group: str, ratio: float, seed: int) -> DataFrame:
    """rows with `split`: whole groups go to val, max(1, min(n - 1, round(n * ratio))) of n, half to even."""
    groups = rows.select(group).distinct().withColumn("__draw", draw(seed, group))
    n = groups.agg(F.count("*").alias("n"))  # one row
    wanted = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.bround(F.col("n") * ratio)))
    placed = global_rank(groups.withColumn("__all", F.lit(0)), ["__all"], "__draw", [group], "at").crossJoin(F.broadcast(n))
    named = placed.select(group, F.when(F.col("at") <= wanted, "val").otherwise("train").alias("split"))
    return rows.join(named, group)


def stratified_split(rows: DataFrame, stratum: str, key: list[str], ratio: float, seed: int) -> DataFrame:
    """rows with `split`: val sizes per stratum by largest remainder, ties to the stratum that sorts first."""
    # As many rows as there are strata.
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("n")).withColumn("share", F.col("n") * ratio).withColumn("base", F.floor("share"))
    total = Window.partitionBy(F.lit(0))
    short = F.bround(F.sum("n").over(total) * ratio) - F.sum("base").over(total)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round(F.col("share") - F.col("base"), 9)), stratum))
    quota = sizes.withColumn("short", short).withColumn("quota", F.col("base") + (rank <= F.col("short")).cast("long")).select(stratum, "quota")
    at = global_rank(rows.withColumn("__draw", draw(seed, *key)), [stratum], "__draw", key, "__at").join(F.broadcast(quota), stratum)
    return at.withColumn("split", F.when(F.col("__at") <= F.col("quota"), "val").otherwise("train")).drop("__draw", "__at", "quota")


def weighted_sample(rows: DataFrame, group: str, key: list[str], weight: str, n: int, seed: int) -> DataFrame:
    """n rows of each group without replacement: the least of -ln(u) / weight, u from a seeded draw."""
    u = (F.conv(draw(seed, *key), 16, 10).cast("double") + 1) / float(16**13 + 1)
    race = rows.filter(F.col(weight) > 0).withColumn("__race", -F.log(u) / F.col(weight))
    return ranked(race, [group], ["__race", *key], "__at").filter(F.col("__at") <= n).drop("__race", "__at")


def require_empty(rows: DataFrame, message: str) -> None:
    """Raise if there is any row: leaks between splits, unknown ids, broken contracts."""
    bad = rows.limit(3).collect()
    if bad:
        raise ValueError(f"{message}: {[tuple(r) for r in bad]}")


def union_checked(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Columns of both by key; where a column is in both, differing values are an error."""
    both = [c for c in left.columns if c in right.columns and c != key]
    joined = left.join(right.withColumnsRenamed({c: f"__r_{c}" for c in both}), key)
    for c in both:
        same = F.col(c).eqNullSafe(F.col(f"__r_{c}"))
        joined = joined.withColumn(c, F.when(same, F.col(c)).otherwise(F.raise_error(F.lit(f"conflict in {c}")).cast(left.schema[c].dataType)))
    return joined.drop(*[f"__r_{c}" for c in both])


#: Beginnings of draws are told apart by so many hex digits more in each round of a search; as many sums reach the driver at most.
_DIGITS = 3
_DRAWN = 13


def _overflow(sizes: DataFrame, room: int) -> tuple[str, int] | None:
    """The first draw whose group does not fit when groups (__draw, __n) are taken in order, and the rows taken before; None if all fit.
    Sums by the beginning of the draw lead to the beginning in which the room ends, and so on into it."""
    beginning, taken = "", 0
    while True:
        width = min(_DRAWN, len(beginning) + _DIGITS)
        within = sizes.filter(F.col("__draw").startswith(beginning)) if beginning else sizes
        sums = within.groupBy(F.substring("__draw", 1, width).alias("p")).agg(F.sum("__n").alias("n")).orderBy("p").collect()
        for r in sums:
            if taken + r["n"] > room:
                break
            taken += r["n"]
        else:
            return None
        beginning = r["p"]
        if width == _DRAWN:
            return beginning, taken


def split_by_budget(rows: DataFrame, group: str, ratio: float, seed: int) -> DataFrame:
    """rows with `split`: whole groups go to val, in the order of a seeded draw, as long as their rows fit in the budget of ratio of
    all rows (the first in any case); one that does not fit is passed over. If that were all groups, the first goes to train.

    Of groups that may still fit (size within the room left) all up to the one at which the room ends are taken at once, and that one is passed
    over; then the same with the room that is left, behind it. Where the room ends is found by sums over ranges of draws, so the driver
    sees at most 4096 sums at a time and no key. There are as many rounds as sizes that overflow, each smaller than the one before.
    Groups whose draws are equal (52 bits) are taken or passed over together.
    """
    sizes = stored(rows.groupBy(group).agg(F.count("*").alias("__n")).withColumn("__draw", draw(seed, group)))
    total, groups, first = sizes.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.count("*"), F.min(F.struct("__draw", "__n"))).first()
    budget = max(1, int(total * ratio)) if ratio > 0 and total > 1 else 0
    picked = F.lit(False)
    if budget and groups > 1:
        taken, after = first["__n"], first["__draw"]
        picked = F.col("__draw") == first["__draw"]
        while taken < budget:
            room = budget - taken
            fitting = sizes.filter((F.col("__draw") > after) & (F.col("__n") <= room))
            found = _overflow(fitting.select("__draw", "__n"), room)
            span = (F.col("__draw") > after) & (F.col("__n") <= room)
            if found is None:
                taken += fitting.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
                picked = picked | span
                break
            picked = picked | (span & (F.col("__draw") < found[0]))
            after, taken = found[0], taken + found[1]
        if taken == total:
            picked = picked & (F.col("__draw") != first["__draw"])
    named = sizes.select(F.col(group).alias("__g"), F.when(picked, "val").otherwise("train").alias("split"))
    return rows.join(named, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def fraction_sample(rows: DataFrame, key: list[str], fraction: float, seed: int) -> DataFrame:
    """The share of all rows with the least draws, to the row."""
    n = int(rows.count() * fraction)
    drawn = rows.withColumn("__draw", draw(seed, *key)).withColumn("__all", F.lit(0))
    return global_rank(drawn, ["__all"], "__draw", key, "__at").filter(F.col("__at") <= n).drop("__draw", "__all", "__at")


def capped_per_source(rows: DataFrame, source: str, order: list[str], most: int) -> DataFrame:
    """Up to ceil(most / sources) rows of each source in order, then the first `most` by source and order."""
    n = max(1, rows.select(source).distinct().count())
    return ranked(rows, [source], order, "__at").filter(F.col("__at") <= max(1, -(-most // n))).orderBy(source, *order).limit(most).drop("__at")


def route(rows: DataFrame, key: str, train: DataFrame, val: DataFrame, otherwise: str | None = None) -> DataFrame:
    """rows with `split` by membership of their key in two lists, which must not share a key. The rest is dropped, or an error if otherwise is `error`."""
    names = train.select(F.col(key).alias("__k"), F.lit("train").alias("split")).unionByName(val.select(F.col(key).alias("__k"), F.lit("val").alias("split")))
    one = names.groupBy("__k").agg(F.min("split").alias("split"), F.countDistinct("split").alias("__n"))
    clash = F.when(F.col("__n") > 1, F.raise_error(F.lit(f"{key} in both splits")).cast("string")).otherwise(F.col("split"))
    got = rows.join(one, F.col(key) == F.col("__k"), "left" if otherwise == "error" else "inner").withColumn("split", clash)
    if otherwise == "error":
        got = got.withColumn("split", F.when(F.col("__k").isNull(), F.raise_error(F.lit(f"{key} in no split")).cast("string")).otherwise(F.col("split")))
    return got.drop("__k", "__n")


def derangement(rows: DataFrame, key: list[str], value: str, seed: int, into: str) -> DataFrame:
    """rows with another row's value in `into`: each row gets that of the next in the order of a seeded draw, the last that of the first. Of two rows or
    more none keeps its own; equal values of different rows may meet. Places come from ranks within beginnings of draws, so no task holds all."""
    drawn = rows.withColumn("__draw", draw(seed, *key)).withColumn("__all", F.lit(0))
    placed = stored(global_rank(drawn, ["__all"], "__draw", key, "__at").drop("__draw", "__all"))
    n = placed.count()
    given = placed.select((F.when(F.col("__at") == 1, n).otherwise(F.col("__at") - 1)).alias("__to"), F.col(value).alias(into))
    return placed.join(given, F.col("__at") == F.col("__to")).drop("__at", "__to")


def require_counts(rows: DataFrame, source: str, counts: dict[str, int]) -> DataFrame:
    """rows, if each source has exactly as many as it must and there is no other; else an error that names what differs."""
    found = {r[source]: r["n"] for r in rows.groupBy(source).agg(F.count("*").alias("n")).limit(len(counts) + 100).collect()}
    wrong = {k: (found.get(k, 0), counts.get(k, 0)) for k in {*found, *counts} if found.get(k, 0) != counts.get(k, 0)}
    if wrong:
        raise ValueError(f"rows by {source}, found and required: {dict(sorted(wrong.items(), key=str))}")
    return rows


def mixture(rows: DataFrame, source: str, key: list[str], shares: dict[str, float], total: int, seed: int) -> DataFrame:
    """`total` rows: floor(total * share) of each source by a seeded draw, the last source the remainder. A source with fewer rows is an error."""
    wanted = {s: int(total * p) for s, p in shares.items()}
    last = list(shares)[-1]
    wanted[last] = total - sum(n for s, n in wanted.items() if s != last)
    have = {r[source]: r["n"] for r in rows.filter(F.col(source).isin(*wanted)).groupBy(source).agg(F.count("*").alias("n")).collect()}
    short = {s: (have.get(s, 0), n) for s, n in wanted.items() if have.get(s, 0) < n}
    if short:
        raise ValueError(f"rows by {source}, found and required: {short}")
    at = global_rank(rows.filter(F.col(source).isin(*wanted)).withColumn("__draw", draw(seed, *key)), [source], "__draw", key, "__at")
    n = F.create_map(*[x for s, k in wanted.items() for x in (F.lit(s), F.lit(k))])
    return at.filter(F.col("__at") <= F.element_at(n, F.col(source))).drop("__at", "__draw")


def fetch(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """rows of a list (at, key) in its order. A key listed or found twice, or not found, is an error."""
    listed = ids.groupBy(F.col(key).alias("__k")).agg(F.min("at").alias("at"), F.count("*").alias("__twice"))
    found = listed.join(rows, F.col(key) == F.col("__k"), "left")
    times = F.count("*").over(Window.partitionBy("__k"))
    wrong = F.when(F.col("__twice") > 1, "listed twice").when(F.col(key).isNull(), "not found").when(times > 1, "found twice")
    checked = found.withColumn("__wrong", wrong)
    return checked.withColumn("at", F.when(F.col("__wrong").isNull(), F.col("at")).otherwise(F.raise_error(F.concat_ws(" ", F.lit(key), F.col("__k").cast("string"), "__wrong")).cast("int"))).drop("__k", "__twice", "__wrong")


def alternating_sample(rows: DataFrame, key: list[str], bucket: str, order: list, owner: str, limit: int, cap: int, seed: int) -> DataFrame:
    """Up to `limit` rows, in turn from each bucket of the order, each bucket by a seeded draw; at most `cap` rows of an owner over all buckets. Rows
    get their place `at` from one. A bucket without a row that may be taken loses its turn; rows of other buckets are left out, null owners are one owner.

    The turns are walked in one task, over at most 2 * limit rows a bucket, and are exact all the same: of an owner's rows in a bucket only the first
    `cap` can be taken, and among those no more than `limit` are taken and no more than `limit` passed over, as each of these belongs to an owner of whom `cap` were taken.
    """
    if cap < 1 or limit < 1:
        raise ValueError("limit and cap must be positive")
    drawn = rows.withColumn("__draw", draw(seed, *key))
    able = ranked(drawn, [bucket, owner], ["__draw", *key], "__nth").filter(F.col("__nth") <= cap).drop("__nth")
    first = [able.filter(F.col(bucket) == b).orderBy("__draw", *key).limit(2 * limit).withColumn("__b", F.lit(i)) for i, b in enumerate(order)]
    seen = stored(ranked(reduce(DataFrame.unionByName, first), ["__b"], ["__draw", *key], "__n"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        queues = [iter(list(q.sort_values("__n")[["__n", "__owner"]].itertuples(index=False, name=None))) for q in (pdf[pdf["__b"] == i] for i in range(len(order)))]
        taken, found, idle, turn = Counter(), [], 0, 0
        while len(found) < limit and idle < len(queues):
            b = turn % len(queues)
            n, who = next(((n, who) for n, who in queues[b] if taken[who] < cap), (None, None))
            if n is None:
                idle += 1
            else:
                idle = 0
                taken[who] += 1
                found.append((b, n, len(found) + 1))
            turn += 1
        return pd.DataFrame(found, columns=["__b", "__n", "at"])

    turns = seen.select("__b", "__n", F.col(owner).cast("string").alias("__owner")).groupBy().applyInPandas(walk, "__b int, __n int, at int")
    return seen.join(F.broadcast(turns), ["__b", "__n"]).drop("__b", "__n", "__draw")


def unique_questions(rows: DataFrame, source: str, question: Column, sources: list[str], key: list[str], n: int, seed: int) -> DataFrame:
    """Exactly n rows of each source by a seeded draw, no two of a source with one question; empty and null questions never count.
    A source with fewer questions is an error."""
    asked = rows.filter(F.col(source).isin(sources)).withColumn("__q", question).filter("__q <> ''").withColumn("__draw", draw(seed, *key))
    once = first_per_key(asked, [source, "__q"], ["__draw", *key]).drop("__q")
    picked = ranked(once, [source], ["__draw", *key], "__nth").filter(F.col("__nth") <= n).drop("__nth", "__draw")
    return require_counts(picked, source, dict.fromkeys(sources, n))


def shuffled_sample(rows: DataFrame, group: str, key: list[str], n: int, seed: int, into: str = "place") -> DataFrame:
    """min(n, size) rows of each group, and their places from one in a seeded order of all."""
    picked = sample_per_group(rows, group, key, n, seed).withColumn("__draw", draw(seed + 1, *key))
    return global_rank(picked, [], "__draw", key, into).drop("__draw")
