"""Which tree nodes are expanded next, and what there is to learn at a node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .curate import draw
from .trees import KEY, depth_preference, leaves, paths, uncertainty

#: Calibrated rates of mixed outcomes by where a node was expanded.
PRIORS = {"root": 0.23255813953488372, "pre_search": 0.17880794701986755, "after_search_depth1": 0.20754716981132076, "after_search_depth2": 0.11363636363636363, "after_search_depth3plus": 0.09090909090909091}
FLOOR, LARGEST = 1e-6, 1e300


def outcome_prior(is_root: Column, searches: Column, priors: dict[str, float] = PRIORS) -> Column:
    """The prior of a node, by the valid searches on its path."""
    after = F.when(searches == 1, priors["after_search_depth1"]).when(searches == 2, priors["after_search_depth2"]).otherwise(priors["after_search_depth3plus"])
    return F.when(is_root, priors["root"]).when(searches < 1, priors["pre_search"]).otherwise(after)


def candidates(nodes: DataFrame, searches: Column) -> DataFrame:
    """Nodes that may be expanded (all but leaves) with uncertainty, after_search, children, preference and prior. searches: valid searches on the path."""
    kids = nodes.filter("parent_node_uid is not null").groupBy("tree_uid", F.col("parent_node_uid").alias("node_uid")).agg(F.count("*").alias("children"))
    got = nodes.withColumn("searches", searches).join(kids, list(KEY)).join(uncertainty(nodes), list(KEY))
    deepest = F.max("depth").over(Window.partitionBy("tree_uid"))
    return got.withColumns({"after_search": F.col("searches") >= 1, "preference": depth_preference(F.col("depth"), deepest), "prior": outcome_prior(F.col("parent_node_uid").isNull(), F.col("searches"))})


def weight(mode: str, of_uncertainty: float = 1.0, of_search: float = 1.0, of_children: float = 1.0, of_depth: float = 1.0, power: float = 2.0) -> Column:
    """Selection weight of candidates(): equal, a sum of preferences, or the prior to a power, with a small floor."""
    if mode in ("random", "grouped_random"):
        return F.lit(1.0)
    if mode == "outcome_prior":
        return FLOOR + F.pow("prior", F.lit(power))
    if mode != "uncertainty_balanced":
        raise ValueError(f"unknown mode {mode!r}")
    total = FLOOR + of_uncertainty * F.col("uncertainty") + of_search * F.col("after_search").cast("double") + of_children / (1.0 + F.col("children")) + of_depth * F.col("preference")
    return F.when(F.isnan(total) | (total > LARGEST), LARGEST).otherwise(total)


def _uniform(seed: int, *key: str) -> Column:
    return (F.conv(draw(seed, *key), 16, 10).cast("double") + 0.5) / float(16**13)


def with_replacement(weighted: DataFrame, n: int, seed: int, first: int = 0) -> DataFrame:
    """n draws for each tree, numbered from `first`, with probability by `weight`: a draw falls into one node's share of the cumulated weights."""
    order = Window.partitionBy("tree_uid").orderBy("node_uid")
    upto = F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0))
    shares = weighted.withColumn("__hi", upto).withColumn("__lo", F.col("__hi") - F.col("weight")).withColumn("__all", F.sum("weight").over(Window.partitionBy("tree_uid")))
    draws = weighted.select("tree_uid").distinct().withColumn("draw", F.explode(F.sequence(F.lit(first), F.lit(first + n - 1)))).withColumn("__u", _uniform(seed, "tree_uid", "draw"))
    met = shares.join(draws, "tree_uid").filter((F.col("__u") * F.col("__all") >= F.col("__lo")) & (F.col("__u") * F.col("__all") < F.col("__hi")))
    return met.drop("__hi", "__lo", "__all", "__u")


def select(found: DataFrame, mode: str, n: int, seed: int, **weights: float) -> DataFrame:
    """n draws of candidates() for each tree, with `draw` and `weight`. `random` and `outcome_prior` draw with replacement, `grouped_random` spends all
    draws on one node, `uncertainty_balanced` draws without replacement and, where there are fewer candidates than draws, the rest with it."""
    weighted = found.withColumn("weight", weight(mode, **weights))
    if mode == "grouped_random":
        return with_replacement(weighted, 1, seed).drop("draw").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if mode != "uncertainty_balanced":
        return with_replacement(weighted, n, seed)
    race = weighted.withColumn("__race", -F.log(_uniform(seed, "tree_uid", "node_uid")) / F.col("weight"))
    by = Window.partitionBy("tree_uid")
    ranked = race.withColumn("draw", F.row_number().over(by.orderBy("__race", "node_uid")) - 1).withColumn("__n", F.count("*").over(by)).drop("__race")
    rest = with_replacement(weighted, n, seed + 1).join(ranked.select("tree_uid", "__n").distinct(), "tree_uid").filter(F.col("draw") >= F.col("__n"))
    return ranked.filter(F.col("draw") < n).unionByName(rest).drop("__n")


def selection_stats(draws: DataFrame) -> DataFrame:
    """By tree: draws, draws of a node drawn before, mean depth, uncertainty and prior, and the share after a search."""
    got = draws.groupBy("tree_uid").agg(F.count("*").alias("selected"), F.countDistinct("node_uid").alias("__d"), F.avg("depth").alias("mean_depth"), F.avg(F.col("after_search").cast("double")).alias("after_search"), F.avg("uncertainty").alias("mean_uncertainty"), F.avg("prior").alias("mean_prior"))
    return got.withColumn("duplicates", F.col("selected") - F.col("__d")).drop("__d")


def sample_leaves(nodes: DataFrame, k: int, seed: int) -> DataFrame:
    """k leaves of each tree, or all of them, by a seeded draw: (tree_uid, node_uid)."""
    return drawn_leaves(leaves(nodes).select(*KEY).distinct(), k, seed)


def drawn_leaves(ends: DataFrame, k: int, seed: int) -> DataFrame:
    """k rows of each tree, or all of them, by a seeded draw. ends: leaves, once each. Draws are made behind the shuffle, which so carries none."""
    at = F.row_number().over(Window.partitionBy("tree_uid").orderBy("__d", "node_uid"))
    return ends.repartition("tree_uid").withColumn("__d", draw(seed, *KEY)).withColumn("__at", at).filter(F.col("__at") <= k).drop("__d", "__at")


def sibling_events(kids: DataFrame, least_gap: float, least_advantage: float = 0.0) -> DataFrame:
    """One row for each parent of kids (tree_uid, parent_node_uid, node_uid, node_value, leaf_count, place): its best child (the first of equals by
    place), value_gap, raw_advantage over the leaf-weighted mean of the others, siblings, and outcome: `event` or what it falls short of."""
    n = F.greatest(F.lit(1), F.coalesce("leaf_count", F.lit(1)))
    v = F.coalesce("node_value", F.lit(0.0))
    got = kids.groupBy("tree_uid", "parent_node_uid").agg(F.count("*").alias("siblings"), F.max(v).alias("top"), F.min(v).alias("low"), F.max(F.struct(v.alias("v"), (-F.col("place")).alias("p"), "node_uid", n.alias("n"))).alias("b"), F.sum(n).alias("__n"), F.sum(n * v).alias("__s"))
    got = got.withColumn("value_gap", F.col("top") - F.col("low")).withColumn("raw_advantage", F.col("top") - F.try_divide(F.col("__s") - F.col("b.n") * F.col("top"), F.col("__n") - F.col("b.n")))
    outcome = F.when(F.col("siblings") < 2, "below_two_queries").when(F.isnan("value_gap") | (F.col("value_gap") < least_gap), "below_gap").when(F.coalesce(F.col("raw_advantage") <= least_advantage, F.lit(True)), "below_advantage").otherwise("event")
    return got.select("tree_uid", "parent_node_uid", F.col("b.node_uid").alias("target"), "siblings", F.col("top").alias("target_value"), "value_gap", "raw_advantage", outcome.alias("outcome"))


def path_events(nodes: DataFrame, events: DataFrame, most: int, largest: float = 1.0) -> DataFrame:
    """The last `most` events on the path from the root to each leaf, in order from the root, with weights min(largest, advantage / deviation),
    shared among the leaves below the event's parent. events: (tree_uid, node_uid, raw_advantage, deviation, leaf_count)."""
    rest = [c for c in events.columns if c not in KEY]
    found = events.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("events"))
    ends = paths(nodes, beside=found, along=("events",)).filter("leaf")
    way = F.concat(F.array(F.struct("node_uid", "events")), F.zip_with("path", "along", lambda p, a: F.struct(p["uid"].alias("node_uid"), a["events"].alias("events"))))
    met = F.flatten(F.transform(way, lambda x, i: F.transform(F.coalesce(x["events"], F.array().cast(found.schema["events"].dataType)), lambda e: F.struct(x["node_uid"].alias("node_uid"), i.alias("steps"), e.alias("event")))))
    last = ends.select("tree_uid", F.col("node_uid").alias("leaf"), F.explode(F.slice(met, 1, most)).alias("e")).select("tree_uid", "e.node_uid", "leaf", "e.steps", "e.event.*")
    strength = F.least(F.lit(largest), F.col("raw_advantage") / F.greatest(F.col("deviation"), F.lit(1e-6)))
    return last.withColumn("weight", strength / F.greatest(F.col("leaf_count"), F.lit(1)))


def anchored_prefix(prompt: Column, state: Column, budget: Column) -> Column:
    """Struct of tokens, truncated and prompt_retained: the prompt, and what the state adds to it, from its end, as far as the budget allows.
    A prompt over the budget keeps its own end; without a budget nothing is kept."""
    n = F.size(prompt)
    recent = F.when((n > 0) & (F.slice(state, F.lit(1), F.greatest(n, F.lit(1))) == prompt), F.slice(state, n + 1, F.greatest(F.size(state) - n, F.lit(0)))).otherwise(state)
    tail = lambda xs, k: F.slice(xs, F.size(xs) - F.least(k, F.size(xs)) + 1, F.least(k, F.size(xs)))
    none = F.slice(prompt, 1, 0)
    tokens = F.when(budget <= 0, none).when(n >= budget, tail(prompt, budget)).otherwise(F.concat(prompt, tail(recent, budget - n)))
    kept = F.when(budget <= 0, 0.0).when(n >= budget, budget / F.greatest(n, F.lit(1))).when(n > 0, 1.0).otherwise(0.0)
    return F.struct(tokens.alias("tokens"), (F.when(budget <= 0, True).otherwise(n + F.size(recent) > budget)).alias("truncated"), kept.cast("double").alias("prompt_retained"))


def token_span(tokens: Column, part: Column) -> Column:
    """Where part begins first in tokens (from zero); null if it does not. Both are arrays of ids."""
    n = F.size(part)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(tokens) - n, F.lit(0))), lambda i: F.slice(tokens, i + 1, n) == part)
    return F.when((n > 0) & (n <= F.size(tokens)), F.try_element_at(starts, F.lit(1)))


def replaced(batch: DataFrame, rescued: DataFrame, columns: list[str], cleared: list[str]) -> DataFrame:
    """batch with the columns of rescued (row_idx and some of the columns) where it has a row: a null there keeps the old value, `cleared`
    columns become zero, and kd tells which rows were rescued."""
    new = rescued.select("row_idx", *[F.col(c).alias(f"__n_{c}") for c in columns if c in rescued.columns], F.lit(True).alias("__new"))
    got = batch.join(new, "row_idx", "left").withColumn("kd", F.coalesce("__new", F.lit(False)))
    for c in columns:
        if f"__n_{c}" in got.columns:
            got = got.withColumn(c, F.coalesce(F.col(f"__n_{c}"), F.col(c)))
    for c in cleared:
        got = got.withColumn(c, F.when(F.col("kd"), F.lit(0).cast(batch.schema[c].dataType)).otherwise(F.col(c)))
    return got.drop("__new", *[f"__n_{c}" for c in columns])


def leaf_kd_mask(length: Column, first: Column, second: Column, through_second: Column) -> Column:
    """Per token of a leaf, whether a teacher wrote it: the first hop's pattern at the start, and the second hop's behind it where the path goes
    through its node; nothing beyond."""
    taught = F.when(through_second, F.concat(first, second)).otherwise(first)
    return F.transform(F.sequence(F.lit(1), length), lambda i: F.coalesce(F.try_element_at(taught, i), F.lit(False)))


def on_first_row(rows: DataFrame, group: str, order: list[str], stat: str) -> DataFrame:
    """rows with the statistic on the first row of its group and zero on the others, so that sums count it once."""
    at = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn(stat, F.when(at == 1, F.col(stat)).otherwise(F.lit(0).cast(rows.schema[stat].dataType)))


def path_intervals(nodes: DataFrame, lengths: Column) -> DataFrame:
    """(tree_uid, leaf, node_uid, start, stop) of each edge on each root-to-leaf path, in tokens of the leaf's response: an edge has as many as its
    lower node adds, and the root has no edge. lengths: tokens that a node adds (if rows of one uid differ, the most)."""
    ends = paths(nodes, {"tokens": F.max(lengths)}, along=("tokens",)).filter("leaf")
    way = F.concat(F.array(F.struct("node_uid", "tokens")), F.zip_with("path", "along", lambda p, a: F.struct(p["uid"].alias("node_uid"), a["tokens"].alias("tokens"))))
    # What a way ends at is a root or has no row: no edge.
    edges = ends.select("tree_uid", F.col("node_uid").alias("leaf"), F.slice(way, F.lit(1), F.size(way) - 1).alias("edges"))
    upto = F.aggregate(F.slice("edges", F.col("i") + 1, F.size("edges")), F.lit(0).cast("long"), lambda n, e: n + F.coalesce(e["tokens"], F.lit(0)))
    got = edges.select("*", F.posexplode("edges").alias("i", "e")).withColumn("stop", upto)
    return got.select("tree_uid", "leaf", "e.node_uid", (F.col("stop") - F.col("e.tokens")).alias("start"), "stop")
