"""Group-relative advantages: a statistic of each group, given back to its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-6


def grpo(score: Column, *group: str) -> Column:
    """(x - mean) / (sample deviation + eps); a group of one passes its score through with deviation one."""
    w = Window.partitionBy(*group)
    n = F.count(score).over(w)
    return F.when(n > 1, (score - F.avg(score).over(w)) / (F.stddev_samp(score).over(w) + EPS)).when(n == 1, score / (1 + EPS))


def grpo_per_token(score: Column, *group: str) -> Column:
    """As grpo(), but a group of one gives zero: its mean is its value."""
    return F.when(F.count(score).over(Window.partitionBy(*group)) == 1, F.lit(0.0)).otherwise(grpo(score, *group))


def rloo(score: Column, *group: str) -> Column:
    """Score against the mean of the others; a group of one passes its score through."""
    w = Window.partitionBy(*group)
    n = F.count(score).over(w)
    return F.when(n > 1, score * n / (n - 1) - F.avg(score).over(w) * n / (n - 1)).otherwise(score)


def advantages(rows: DataFrame, kind: str, uid: str = "uid", tree: str = "tree_uid", score: str = "score", into: str = "advantage", credit: str | None = None, coefficient: float = 0.5) -> DataFrame:
    """rows with the advantage of the named estimator."""
    x = F.col(score)
    simple = {
        "grpo": lambda: grpo(x, uid),
        "rloo": lambda: rloo(x, uid),
        "tree": lambda: grpo(x, uid) + grpo(x, tree),
        "tree_inner": lambda: grpo(x, tree),
        "tree_per_token": lambda: grpo_per_token(x, uid) + grpo_per_token(x, tree),
        "no_estimator": lambda: x,
    }
    if kind in simple:
        return rows.withColumn(into, simple[kind]())
    if kind == "tree_2norm":
        return rows.withColumn("__once", grpo(x, uid)).withColumn(into, grpo(F.col("__once"), tree)).drop("__once")
    if kind == "branch_credit":
        if credit not in rows.columns:
            raise ValueError("branch_credit needs a credit column")
        return rows.withColumn(into, grpo(x, uid) + coefficient * F.coalesce(F.col(credit), F.lit(0.0)))
    raise ValueError(f"unknown estimator {kind}")


def group_classes(rows: DataFrame, uid: str = "uid", score: str = "score", threshold: float = 0.8, size: int | None = None) -> DataFrame:
    """uid, n, n_correct and class of each group; with `size`, any other group size is an error."""
    got = rows.groupBy(uid).agg(F.count("*").alias("n"), F.count_if(F.col(score) >= threshold).alias("n_correct"))
    if size is not None:
        got = got.withColumn("n", F.when(F.col("n") == size, F.col("n")).otherwise(F.raise_error(F.lit("group size differs")).cast("long")))
    return got.withColumn("class", F.when(F.col("n_correct") == 0, "all_wrong").when(F.col("n_correct") == F.col("n"), "all_correct").otherwise("mixed"))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """1 - C(n-c, k) / C(n, k) as a product; one where fewer than k are wrong."""
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda s, i: s * F.greatest(n - c - i, F.lit(0)) / F.greatest(n - i, F.lit(1)))
    return F.when(n - c < k, F.lit(1.0)).otherwise(1 - miss)
