"""Trees of any depth against a plain recursion."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from branchlight.operators import selection, trees

SCHEMA = "tree_uid string, node_uid string, parent_node_uid string, depth int, score double"


def test_a_chain_of_forty(spark):
    n = spark.createDataFrame([("t", f"n{i}", f"n{i - 1}" if i else None, i, float(i)) for i in range(41)], SCHEMA)
    pairs = trees.closure(n)
    assert pairs.count() == 41 * 42 // 2 and pairs.agg(F.max("steps")).first()[0] == 40
    assert {(r["leaf_count"], r["node_value"]) for r in trees.node_values(n).collect()} == {(1, 40.0)}
    assert trees.prune(n, n.filter("node_uid = 'n39'")).count() == 40
    ends = selection.path_intervals(n, F.lit(2)).agg(F.max("stop"), F.count("*")).first()
    assert tuple(ends) == (80, 40)


def test_random_trees(spark):
    rnd = random.Random(1)
    rows = [(t, f"n{i}", f"n{rnd.randrange(i)}" if i else None, 0, rnd.choice([None, rnd.random()])) for t in "abc" for i in range(30)]
    n = spark.createDataFrame(rows, SCHEMA)
    score = {r[:2]: r[4] or 0.0 for r in rows}

    def below(t, x):
        kids = [r[1] for r in rows if r[0] == t and r[2] == x]
        return [s for k in kids for s in below(t, k)] if kids else [score[t, x]]

    got = {(r["tree_uid"], r["node_uid"]): r for r in trees.node_values(n, also={"right": 0.5}).collect()}
    assert len(got) == len(rows)
    for t, x, parent, *_ in rows:
        want, r = below(t, x), got[t, x]
        assert (r["leaf_count"], r["parent_node_uid"]) == (len(want), parent)
        assert r["node_value"] == pytest.approx(sum(want) / len(want)) and r["right"] == pytest.approx(sum(s >= 0.5 for s in want) / len(want))


def test_cycles_and_two_parents_are_errors(spark):
    with pytest.raises(ValueError, match="3 nodes are their own ancestors"):
        trees.paths(spark.createDataFrame([("t", *p, 0, 1.0) for p in (("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"))], SCHEMA))
    with pytest.raises(Exception, match="two parents"):
        trees.paths(spark.createDataFrame([("t", "a", "b", 0, 1.0), ("t", "a", "c", 0, 1.0)], SCHEMA))


def test_small_and_empty(spark):
    assert trees.closure(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in trees.node_values(spark.createDataFrame([("t", "r", None, 0, None)], SCHEMA)).collect()] == [("t", "r", None, None, 1, 0.0, 0.0)]


def test_leaves_stay_out_of_the_rounds_and_paths_need_no_window(spark, monkeypatch):
    """Only parents are written down round by round, and what a path holds is not joined to it anew."""
    edges = [("r", None), *[(f"a{i}", "r") for i in range(3)], *[(f"b{i}-{j}", f"a{i}") for i in range(3) for j in range(5)]]
    n = spark.createDataFrame([("t", u, p, 0, 1.0) for u, p in edges], SCHEMA)
    kept, stored = [], trees.stored
    monkeypatch.setattr(trees, "stored", lambda df: kept.append(stored(df)) or kept[-1])
    assert sorted(len(r["path"]) for r in trees.paths(n).collect()) == [0, 1, 1, 1, *[2] * 15]
    assert [k.count() for k in kept][0] == 19 and all(k.count() == 4 for k in kept[1:])
    events = n.filter("parent_node_uid = 'r'").selectExpr("tree_uid", "node_uid", "0.5D AS raw_advantage", "1.0D AS deviation", "2 AS leaf_count")
    for got in (selection.path_intervals(n, F.length("node_uid")), selection.path_events(n, events, 1)):
        assert "Window" not in got._jdf.queryExecution().executedPlan().toString() and got.count() == (30 if "stop" in got.columns else 15)


def _odd(spark):
    """Repeated rows of leaves and of parents, parents without a row, a lone root, leaves beside parents, a null score."""
    rows = [("t", "r", None), ("t", "a", "r"), ("t", "a", "r"), ("t", "b", "r"), ("t", "x", "a"), ("t", "x", "a"), ("t", "y", "a"), ("t", "z", "y"), ("u", "m", "gone"), ("u", "n", "m"), ("u", "k", "gone"), ("v", "lone", None)]
    return spark.createDataFrame([(*r, 0, None if r[1] == "k" else i / 16) for i, r in enumerate(rows)], SCHEMA)


def test_leaves_are_added_up_by_their_parent_and_not_sorted_before_the_shuffle(spark, monkeypatch):
    n = _odd(spark)
    ends = trees.leaves(n).select("tree_uid", "node_uid", F.coalesce("score", F.lit(0.0)).alias("s"))
    want = trees.closure(n).join(ends, ["tree_uid", "node_uid"]).groupBy("tree_uid", F.col("ancestor").alias("node_uid")).agg(F.count("*").alias("n"), F.sum("s").alias("s"), F.avg("s").alias("v"))
    kept, stored = [], trees.stored
    monkeypatch.setattr(trees, "stored", lambda df: kept.append(df) or stored(df))
    got = trees.node_values(n)
    assert sorted(map(tuple, got.select("tree_uid", "node_uid", "leaf_count", "leaf_sum", "node_value").collect())) == sorted(map(tuple, want.collect()))
    parents = {r[:2]: r[2:] for r in got.select("tree_uid", "node_uid", "parent_node_uid", "rows").collect()}
    assert parents["t", "a"] == ("r", 2) and parents["t", "x"] == ("a", 2) and parents["u", "gone"] == (None, None) and parents["v", "lone"] == (None, None)
    plan = kept[0]._jdf.queryExecution().executedPlan().toString()
    last = plan[plan.rindex("SortAggregate") :]
    assert "partial_max(parent_node_uid" in last and "REPARTITION_BY_COL" in last


def test_tree_diff_adds_up_the_tree_once(spark):
    """The values of parents are written down, not made again for either side of the join."""
    got = trees.tree_diff(_odd(spark).filter("tree_uid <> 'u'"))
    assert "posexplode" not in got._jdf.queryExecution().executedPlan().toString()
    values = {(r["tree_uid"], r["node_uid"]): r for r in trees.node_values(_odd(spark)).collect()}
    rows = got.collect()
    assert sorted(r["node_uid"] for r in rows) == sorted(["a", "a", "b", "x", "x", "y", "z"])
    for r in rows:
        v = values[r["tree_uid"], r["node_uid"]]
        up = values[r["tree_uid"], v["parent_node_uid"]]["node_value"]
        assert r["diff"] == pytest.approx((max(v["node_value"] - up, 0) + v["node_value"]) / v["leaf_count"] ** 0.5)


def test_sampled_leaves_and_what_is_above_them(spark, sf_dir):
    """As prune() of the sample, from nodes read once; the query goes back to no table behind them."""
    for k in (1, 2, 9):
        every = trees.known(_odd(spark))
        drawn = selection.drawn_leaves(every.filter("leaf").select("tree_uid", "node_uid", "parent_node_uid"), k, 24)
        want = trees.prune(_odd(spark), selection.sample_leaves(_odd(spark), k, 24)).select("tree_uid", "node_uid").distinct()
        assert sorted(map(tuple, trees.above_leaves(every, drawn).collect())) == sorted(map(tuple, want.collect()))
    from branchlight.plans import selection as plans

    assert "lineitem" not in plans.leaf_sample_prune(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_a_snapshot_is_one_shuffle_and_children_meet_their_parent_without_a_join(spark):
    n = _odd(spark).unionByName(spark.createDataFrame([(None, "p", None, 0, 1.0), (None, "q", "p", 1, 1.0), ("w", None, "s", 1, 1.0), ("w", "s", None, 0, 1.0)], SCHEMA))
    got = trees.snapshot(n, ["score"])
    rows = got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.index("== Final Plan ==") : plan.index("== Initial Plan ==")] if "== Final Plan ==" in plan else plan
    assert "Join" not in plan and plan.count("hashpartitioning(") == 1
    every = [tuple(r) for r in n.collect()]
    kids = lambda t, u: sorted(r[1] for r in every if t is not None and u is not None and r[:1] == (t,) and r[2] == u and r[1] is not None)
    for t in {r[0] for r in every}:
        tree = next(r for r in rows if r["tree_uid"] == t)
        mine = [(r[3], r[1], r[2], kids(t, r[1]), r[2] is None, not kids(t, r[1]), r[4]) for r in every if r[0] == t]
        assert tree["n_nodes"] == len(mine) and sorted(map(repr, map(tuple, tree["nodes"]))) == sorted(map(repr, mine))
        assert tree["root_node_uid"] == max((r[1] for r in mine if r[2] is None), default=None)
    assert len(rows) == len({r[0] for r in every})


def test_nodes_are_shuffled_once_before_they_are_written_down(spark, monkeypatch):
    """A parent without a row is no node, a tree that has no uid has no parents."""
    kept, stored = [], trees.stored
    monkeypatch.setattr(trees, "stored", lambda df: kept.append(df) or stored(df))
    n = _odd(spark).unionByName(spark.createDataFrame([(None, "p", None, 0, 1.0), (None, "q", "p", 1, 1.0)], SCHEMA))
    beside = spark.createDataFrame([("t", "a", 7), ("u", "gone", 8)], "tree_uid string, node_uid string, more int")
    for more in (None, beside):
        got = trees.known(n, {"n": F.count("*"), "s": F.sum(F.lit(1))}, more)
        want = {("t", "r"): (None, 1, False), ("t", "a"): ("r", 2, False), ("t", "b"): ("r", 1, True), ("t", "x"): ("a", 2, True), ("t", "y"): ("a", 1, False), ("t", "z"): ("y", 1, True)}
        want |= {("u", "m"): ("gone", 1, False), ("u", "n"): ("m", 1, True), ("u", "k"): ("gone", 1, True), ("v", "lone"): (None, 1, True), (None, "p"): (None, 1, True), (None, "q"): ("p", 1, True)}
        rows = got.collect()
        assert {(r["tree_uid"], r["node_uid"]): (r["parent_node_uid"], r["rows"], r["leaf"]) for r in rows} == want and len(rows) == len(want)
        assert all(r["n"] == r["s"] == r["rows"] for r in rows) and (more is None or {r["node_uid"] for r in rows if r["more"] == 7} == {"a"})
    plan = kept[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(") == 1 and "Join" not in plan


def test_credit_along_paths_reads_nodes_once(spark, monkeypatch):
    from branchlight.plans import trees as plans

    calls, known = [], trees.known
    monkeypatch.setattr(trees, "known", lambda *a, **k: calls.append(a) or known(*a, **k))
    monkeypatch.setattr(plans, "tree_nodes", lambda *_: _odd(spark))
    got = plans.path_token_intervals(spark, "").collect()
    assert len(calls) == 1
    at = (F.round("credit", 4) + F.lit(0.0)).alias("credit")
    credit = trees.sibling_credit(trees.edges(trees.node_values(_odd(spark)))).select("tree_uid", F.col("node_uid").alias("ancestor"), at)
    want = trees.closure(_odd(spark)).join(trees.leaves(_odd(spark)).select("tree_uid", "node_uid"), ["tree_uid", "node_uid"]).join(credit, ["tree_uid", "ancestor"]).select("node_uid", "ancestor", "credit", "steps")
    assert sorted((r["leaf"], r["node_uid"], r["credit"]) for r in got) == sorted(tuple(r)[:3] for r in want.collect())
    for leaf in {r["leaf"] for r in got}:
        mine = sorted((r["start"], r["stop"], r["node_uid"]) for r in got if r["leaf"] == leaf)
        assert [r[:2] for r in mine] == [(10 * i, 10 * i + 10) for i in range(len(mine))] and mine[-1][2] == leaf


def test_contrasts_take_parents_from_the_values(spark, sf_dir):
    n = _odd(spark)
    values = trees.node_values(n)
    for gap in (0.0, 0.1, 0.3):
        got, want = (sorted(map(tuple, df.select("tree_uid", "parent_node_uid", "worst", "best", "children").collect())) for df in (trees.value_contrasts(values, gap), trees.contrasts(n, values, gap)))
        assert got == want and (got or gap)
    from branchlight.plans import trees as plans

    assert "lineitem" not in plans.sibling_contrasts(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
