"""What a teacher may teach on the way from a tree's root to its leaves: spans of tokens on edges, and events by four modes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rounds import stored
from .trees import KEY, paths

MODES = ("contrast", "dense", "paper", "global_failure")


@dataclass(frozen=True)
class Marks:
    """Token ids of the control tags."""

    think: tuple[tuple[int, ...], tuple[int, ...]]
    search: tuple[tuple[int, ...], tuple[int, ...]]


def first(hits: np.ndarray, width: int, begins: np.ndarray, ends: np.ndarray, start: np.ndarray) -> np.ndarray:
    """First place (from zero) at or behind start where a part of `width` tokens stands in each row; -1 if nowhere. hits: its places in all rows' tokens, joined."""
    at = np.searchsorted(hits, begins + start)
    place = np.append(hits, np.iinfo(np.int64).max - width)[at]
    return np.where(place + width <= ends, place - begins, -1)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all arrays, joined (nulls as a number no tag has), and where each row begins and ends. A null array is empty."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    return pc.fill_null(column.flatten().cast(pa.int64()), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), ends - sizes, ends


def places(values: np.ndarray, part: tuple[int, ...]) -> np.ndarray:
    """Where part stands in values, across rows too."""
    n = max(0, len(values) - len(part) + 1)
    met = np.ones(n, bool)
    for i, token in enumerate(part):
        met &= values[i : i + n] == token
    return np.flatnonzero(met)


def spans(tokens: pa.Array, info: pa.Array | None, marks: Marks, most_query: int, most_action: int) -> pa.StructArray:
    """The spans of with_spans() for a batch of edges; a tag is looked for in all of them at once."""
    values, begins, ends = flat(tokens)
    (think, thought), (search, searched) = marks.think, marks.search
    find = lambda part, start: first(places(values, part), len(part), begins, ends, start)
    zero = np.zeros(len(begins), np.int64)
    s = find(search, zero)
    q = s + len(search)
    e = np.where(s >= 0, find(searched, q), -1)
    k = find(think, zero)
    inside = (k >= 0) & (k < s)
    b = np.where(inside, k + len(think), 0)
    d = find(thought, b)
    crossed = (d < b) | (d > s)
    begin, end = np.where(crossed, 0, b), np.where(crossed, s, d)
    seen = np.zeros(len(begins), bool)
    if info is not None:
        given, a, z = flat(info)
        outside = np.concatenate(([0], np.cumsum(given == 0)))
        among = lambda x, y: outside[np.clip(a + np.maximum(x, y), a, z)] - outside[np.clip(a + x, a, z)]
        seen = (e > q) & (among(begin, end) + among(q, e) > 0)
    reasons = [(ends == begins) | (s < 0), e <= q, e - q > most_query, (end - begin) + (e - q) > most_action, seen]
    reason = np.select(reasons, ["no_search", "empty_query", "query_too_long", "action_too_long", "observed_tokens"], "")
    found = [q, e, begin, end, np.where(inside, k, 0)]
    names = ["reason", "query_start", "query_stop", "think_start", "think_stop", "action_start"]
    return pa.StructArray.from_arrays([pa.array(reason, pa.string(), mask=reason == ""), *[pa.array(x, pa.int32()) for x in found]], names=names)


def with_spans(edges: DataFrame, marks: Marks, tokens: str = "tokens", info: str | None = "info", most_query: int = 64, most_action: int = 256) -> DataFrame:
    """edges with `span`: why there is none (reason), or where the query and the thought before it stand on the edge's own tokens: query_start, query_stop,
    think_start, think_stop, action_start. The states are passed in order: search tag, its end, thinking tag before it, its end; text before the search is the
    thought where tags of thinking lack or are crossed. A token from outside (info 0) in what is taught refuses the edge. An edge without tokens has no search."""
    kind = "struct<reason:string,query_start:int,query_stop:int,think_start:int,think_stop:int,action_start:int>"

    @F.arrow_udf(kind)
    def spanned(t: pa.Array, i: pa.Array) -> pa.Array:
        return spans(t, i if info else None, marks, most_query, most_action)

    # Marked so that later filters on the span do not make Spark look for it again.
    return edges.withColumn("span", spanned.asNondeterministic()(F.col(tokens), F.col(info or tokens)))


def selected_positions(span: Column) -> Column:
    """Places of the taught tokens on the edge: the thought's, then the query's."""
    run = lambda a, b: F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))
    return F.concat(run(span["think_start"], span["think_stop"]), run(span["query_start"], span["query_stop"]))


def judged(nodes: DataFrame, mode: str, least_gap: float = 0.25, least_advantage: float = 0.0, largest: float = 3.0) -> DataFrame:
    """nodes (KEY, parent_node_uid, place, node_value, leaf_count, span, and instruction: tokens of what the teacher is told, null if nothing) with
    outcome (`event` or what it falls short of), weight, raw_advantage, value_gap and siblings (with a span). In the mode `contrast` the best of at least two
    siblings is an event, the first of equals by place; in the others every node with a span is."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    v = F.coalesce("node_value", F.lit(0.0))
    n = F.greatest(F.lit(1), F.coalesce("leaf_count", F.lit(1)))
    fit = F.col("span.reason").isNull() & F.col("parent_node_uid").isNotNull()
    kids = nodes.filter(fit).groupBy("tree_uid", "parent_node_uid").agg(
        F.count("*").alias("siblings"), (F.max(v) - F.min(v)).alias("value_gap"), F.stddev_pop(v).alias("__std"), F.max(F.struct(v.alias("v"), (-F.col("place")).alias("p"), "node_uid", n.alias("n"))).alias("__best"), F.sum(n).alias("__n"), F.sum(n * v).alias("__s")
    )
    got = nodes.join(kids, ["tree_uid", "parent_node_uid"], "left")
    advantage = F.col("__best.v") - F.try_divide(F.col("__s") - F.col("__best.n") * F.col("__best.v"), F.col("__n") - F.col("__best.n"))
    got = got.withColumn("raw_advantage", advantage if mode == "contrast" else F.lit(0.0))
    common = F.when(F.col("parent_node_uid").isNull(), "root").when(F.col("span.reason").isNotNull(), F.col("span.reason"))
    if mode == "contrast":
        gap, adv = F.col("value_gap"), F.col("raw_advantage")
        common = common.when(F.col("siblings") < 2, "below_two_queries").when(F.isnan(gap) | (gap < least_gap), "below_gap").when(F.col("__best.node_uid") != F.col("node_uid"), "not_the_best").when(F.coalesce(F.isnan(adv) | (adv <= least_advantage), F.lit(True)), "below_advantage")
    outcome = common.when(F.col("instruction").isNull(), "no_instruction").otherwise("event")
    weight = F.least(F.lit(largest), F.col("raw_advantage") / F.greatest(F.col("__std"), F.lit(1e-6))) / n if mode == "contrast" else F.lit(1.0)
    return got.withColumn("outcome", outcome).withColumn("weight", F.when(F.col("outcome") == "event", weight)).drop("__std", "__best", "__n", "__s")


def candidate_steps(nodes: DataFrame, least_gap: float = 0.25) -> DataFrame:
    """(KEY, candidate): whether the siblings of a node with a span, two of them at least, lie so far apart that its step may get a skill of its own."""
    w = Window.partitionBy("tree_uid", "parent_node_uid")
    v = F.when(F.col("span.reason").isNull(), F.coalesce("node_value", F.lit(0.0)))
    return nodes.filter("parent_node_uid is not null").select(*KEY, ((F.count(v).over(w) >= 2) & (F.max(v).over(w) - F.min(v).over(w) >= least_gap)).alias("candidate"))


def events(nodes: DataFrame, mode: str, most: int, budget: int, success: float = 0.8, **limits: float) -> tuple[DataFrame, DataFrame]:
    """(events, counters). Events are rows (tree_uid, leaf, at, node_uid, weight, teacher_length, target_start, ...): on each root-to-leaf path the last `most`
    events in order from the root. An event whose instruction and action alone exceed the budget is `over_budget`; the rest of the budget is the state
    before it, from its end (see selection.anchored_prefix). In the mode `global_failure` paths whose leaf reached `success` teach nothing. Counters are (outcome, n) over
    the nodes of all paths, `dropped_early` those that gave way to later ones."""
    # Written down without the tokens, as all that follows reads it several times.
    kept = ("parent_node_uid", "place", "node_value", "leaf_count", "span", "instruction")
    nodes = stored(nodes.select(*KEY, *kept))
    told = judged(nodes, mode, **limits)
    action = F.col("span.query_stop") - F.col("span.action_start")
    required = F.size("instruction") + action
    told = told.withColumn("outcome", F.when((F.col("outcome") == "event") & (required > budget), "over_budget").otherwise(F.col("outcome")))
    way = paths(nodes.select(*KEY, "parent_node_uid", "node_value"), {"leaf_value": F.max("node_value")}).filter("leaf")
    steps = way.select("tree_uid", F.col("node_uid").alias("leaf"), "leaf_value", F.posexplode(F.reverse(F.concat(F.array("node_uid"), F.col("path.uid")))).alias("depth_on_path", "node_uid"))
    met = steps.join(told, list(KEY))
    if mode == "global_failure":
        met = met.withColumn("outcome", F.when(F.coalesce("leaf_value", F.lit(0.0)) >= success, "succeeded").otherwise(F.col("outcome")))
    # A path is as long as the tree is deep: it is folded in one row.
    item = F.struct("depth_on_path", "node_uid", "outcome", "weight", "raw_advantage", "value_gap", "siblings", F.col("span.query_start").alias("query_start"), (F.size("instruction") + action).alias("required"), F.size("instruction").alias("told"), selected_positions(F.col("span")).alias("positions"))
    folded = met.groupBy("tree_uid", "leaf").agg(F.sort_array(F.collect_list(item)).alias("path"))
    folded = folded.withColumn("met", F.filter("path", lambda x: x["outcome"] == "event"))
    kept = folded.select("tree_uid", "leaf", F.posexplode(F.slice("met", F.greatest(F.lit(1), F.size("met") - most + 1), F.lit(most))).alias("at", "e"))
    rows = kept.select("tree_uid", "leaf", "at", F.col("e.node_uid").alias("node_uid"), "e.weight", "e.raw_advantage", "e.value_gap", "e.siblings", "e.positions", "e.required", (F.lit(budget) - F.col("e.required")).alias("state_budget"), F.col("e.told").alias("target_offset"))
    # One pass for all counters, and no path is folded for them; outcomes are few.
    ways = met.groupBy("tree_uid", "leaf", "outcome").agg(F.count("*").alias("c"))
    late = F.when(F.col("outcome") == "event", F.greatest(F.lit(0), F.col("c") - most))
    total = ways.groupBy("outcome").agg(F.sum("c").alias("n"), F.sum(late).alias("late")).agg(F.collect_list(F.struct("outcome", "n")).alias("o"), F.coalesce(F.sum("late"), F.lit(0)).alias("late"))
    counters = total.select(F.inline(F.concat("o", F.array(F.struct(F.lit("dropped_early").alias("outcome"), F.col("late").alias("n"))))))
    return rows, counters
