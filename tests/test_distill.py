"""Spans, distillation events, spliced rows and seeded trees against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from branchlight.functions import forms, gates, leaks, prompts
from branchlight.operators import audit, batch, curate, distill, rescue, tokenizing

MARKS = distill.Marks(((1, 1), (2,)), ((3,), (4, 4)))


def place(values, part, start=0):
    return next((i for i in range(start, len(values) - len(part) + 1) if values[i : i + len(part)] == list(part)), -1)


def span_by_hand(t, info, most_query, most_action):
    s = place(t, (3,))
    if not t or s < 0:
        return "no_search", None
    q = s + 1
    e = place(t, (4, 4), q)
    if e <= q:
        return "empty_query", None
    k = place(t, (1, 1))
    begin = k + 2 if 0 <= k < s else 0
    end = place(t, (2,), begin)
    if end < begin or end > s:
        begin, end = 0, s
    chosen = [*range(begin, end), *range(q, e)]
    if e - q > most_query:
        return "query_too_long", None
    if len(chosen) > most_action:
        return "action_too_long", None
    if any(info[i] == 0 for i in chosen):
        return "observed_tokens", None
    return None, chosen


def test_spans(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(300):
        t = [rnd.choice([1, 2, 3, 4, 5]) for _ in range(rnd.randrange(0, 14))]
        if i % 3 == 0:
            t = [1, 1, *[5] * rnd.randrange(5), 2, 3, *[6] * rnd.randrange(5), 4, 4, 7]
        rows.append((i, t, [int(rnd.random() > 0.1) for _ in t]))
    df = spark.createDataFrame(rows, "i int, tokens array<int>, info array<int>")
    got = {r["i"]: r for r in distill.with_spans(df, MARKS, most_query=3, most_action=6).withColumn("p", distill.selected_positions(F.col("span"))).collect()}
    seen = set()
    for i, t, info in rows:
        reason, chosen = span_by_hand(t, info, 3, 6)
        seen.add(reason)
        assert got[i]["span"]["reason"] == reason, (t, info)
        assert reason or got[i]["p"] == chosen, (t, got[i])
    assert len(seen) == 6
    assert distill.with_spans(spark.createDataFrame([(None,)], "tokens array<int>"), MARKS, info=None).first()["span"]["reason"] == "no_search"


def nodes(spark):
    t = [1, 1, 5, 2, 3, 6, 4, 4]
    rows = [("t", "r", None, 0, 0.0, 3, []), ("t", "a", "r", 1, 1.0, 1, t), ("t", "b", "r", 2, 0.2, 2, t), ("t", "c", "a", 3, 0.9, 1, t), ("t", "d", "a", 4, 0.9, 1, t), ("t", "e", "b", 5, 0.2, 1, [9])]
    df = spark.createDataFrame(rows, "tree_uid string, node_uid string, parent_node_uid string, place int, node_value double, leaf_count int, tokens array<int>")
    return distill.with_spans(df.withColumn("info", F.transform("tokens", lambda _: F.lit(1))), MARKS).withColumn("instruction", F.array(F.lit(7), F.lit(8)))


def test_event_modes(spark):
    n = nodes(spark)
    tell = lambda mode, most=3, **how: {(r["leaf"], r["at"], r["node_uid"]): round(r["weight"], 6) for r in distill.events(n, mode, most, 50, **how)[0].collect()}
    assert tell("contrast") == {("c", 0, "a"): 2.0, ("d", 0, "a"): 2.0}
    assert tell("dense") == {(leaf, i, x): 1.0 for leaf, path in (("c", "ac"), ("d", "ad"), ("e", "b")) for i, x in enumerate(path)}
    assert tell("dense", 1) == {("c", 0, "c"): 1.0, ("d", 0, "d"): 1.0, ("e", 0, "b"): 1.0}
    assert tell("global_failure") == {("e", 0, "b"): 1.0}
    assert distill.events(n, "dense", 3, 7)[0].count() == 0
    counters = {r["outcome"]: r["n"] for r in distill.events(n, "contrast", 3, 50)[1].collect()}
    assert counters == {"root": 3, "event": 2, "below_gap": 2, "not_the_best": 1, "no_search": 1, "dropped_early": 0}
    assert {r["node_uid"]: r["candidate"] for r in distill.candidate_steps(n).collect()} == {"a": True, "b": True, "c": False, "d": False, "e": False}
    with pytest.raises(ValueError, match="unknown mode"):
        distill.judged(n, "other")


def test_forked_and_whole_trees_agree(spark):
    def piece(uid, k):
        n = (F.conv(F.substring(F.sha2(uid.cast("binary"), 256), 1, 2), 16, 10).cast("int") % 3 + 1).cast("int")
        return F.struct(F.array_repeat(k, n).alias("tokens"), F.array_repeat(F.lit(False), n).alias("kd"))

    seeds = rescue.seeded(spark.range(3).withColumnRenamed("id", "tree_uid"), *[F.struct(F.array(F.lit(i)).alias("tokens"), F.array(F.lit(True)).alias("kd")) for i in (5, 6)])
    whole = rescue.grown(seeds, 2, 3, piece)
    part = rescue.grown(seeds, 2, 1, piece)
    front = part.join(part.select(F.col("parent_node_uid").alias("node_uid")).distinct(), "node_uid", "left_anti").filter("length(node_uid) = 16")
    again = part.unionByName(rescue.grown(front, 2, 2, piece)).distinct()
    assert sorted(map(str, whole.distinct().collect())) == sorted(map(str, again.select(whole.columns).collect())) and whole.count() == 3 * 2 * 15


def test_splicing(spark):
    batch_rows = [(0, [9], [1, 2, 3], [1, 1, 1, 1], [0.0, 0.0, 1.0], [1, 1, 1], [1.0, 1.0, 1.0]), (1, [8], [4, 5, 0], [1, 1, 1, 0], [0.0, 1.0, 0.0], [1, 1, 0], [1.0, 1.0, 0.0])]
    df = spark.createDataFrame(batch_rows, "row_idx int, prompts array<int>, responses array<int>, info_mask array<int>, token_level_scores array<double>, turns_mask array<int>, branch_advantages array<double>")
    new = spark.createDataFrame([(1, [7, 7, 7, 7], [7, 7, 0, 7], [1, 1, 1, 1], [True, True, False, False], 0.5)], "row_idx int, response array<int>, info array<int>, turns array<int>, kd array<boolean>, score double")
    got = {r["row_idx"]: r for r in rescue.spliced(df, new, 0).collect()}
    a, b = got[0], got[1]
    assert (a["responses"], a["token_level_scores"], a["kd"], a["attention_mask"], a["position_ids"]) == ([1, 2, 3, 0], [0.0, 0.0, 1.0, 0.0], [False] * 4, [1, 1, 1, 1, 0], [0, 1, 2, 3, 0])
    assert (b["responses"], b["token_level_scores"], b["kd"], b["info_mask"], b["branch_advantages"], b["input_ids"], b["position_ids"]) == ([7] * 4, [0.0, 0.0, 0.0, 0.5], [True, True, False, False], [1, 1, 1, 0, 1], [0.0] * 4, [8, 7, 7, 7, 7], [0, 1, 2, 3, 4])
    with pytest.raises(Exception, match="mask length"):
        rescue.spliced(df, new.withColumn("info", F.array(F.lit(1))), 0).collect()


def test_tokenizers(spark):
    from tokenizers import Tokenizer

    path = "/opt/tokenizers/byte_bpe_50k.json"
    texts = ["Hello wörld", "", None, "x" * 50_000, "<|endoftext|>"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("ids", tokenizing.encoded(F.col("t"), path))
    got = [(r["ids"], r["back"]) for r in rows.withColumn("back", tokenizing.decoded(F.col("ids"), path)).orderBy("i").collect()]
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    assert got == [(None if t is None else plain.encode(t, add_special_tokens=False).ids, t) for t in texts]
    one = spark.range(1).select(tokenizing.training_row(F.sequence(F.lit(1), F.lit(20)), F.array(F.lit(90), F.lit(91)), 12, 4, 3).alias("r")).first()["r"]
    assert one["input_ids"] == [1, 2, 3, 14, 15, 16, 17, 18, 19, 20, 90, 91] and one["labels"] == [-100] * 10 + [90, 91]
    for bad in (lambda: tokenizing.training_row(F.array(F.lit(1)), F.sequence(F.lit(1), F.lit(10)), 12, 4), lambda: tokenizing.fitted(F.array(F.lit(1), F.lit(2)), 1, 0, cut="error")):
        with pytest.raises(Exception, match="too (long|many)"):
            spark.range(1).select(bad()).collect()


def test_contracts_and_controls(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], i) for i in range(21)], "id int, s string, v int")
    moved = curate.derangement(rows, ["id"], "id", 3, "other").collect()
    assert all(r["id"] != r["other"] for r in moved) and {r["other"] for r in moved} == set(range(21))
    assert curate.require_counts(rows, "s", {"a": 11, "b": 10}) is rows
    with pytest.raises(ValueError, match="'a': \\(11, 12\\)"):
        curate.require_counts(rows, "s", {"a": 12, "b": 10})
    with pytest.raises(ValueError, match="found and required"):
        curate.mixture(rows, "s", ["id"], {"a": 0.5, "b": 0.5}, 30, 1)
    assert curate.mixture(rows, "s", ["id"], {"a": 0.5, "b": 0.5}, 15, 1).groupBy("s").count().orderBy("s").collect() == [("a", 7), ("b", 8)]
    with pytest.raises(ValueError, match="raw_response"):
        gates.require_columns(["prompt", "raw_response"])
    with pytest.raises(Exception, match="unequal length"):
        batch.rows_of_lists(spark.createDataFrame([([1, 2], [1])], "a array<int>, b array<int>")).collect()
    m = lambda *turns: F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in turns])
    tell = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert tell(forms.normalized_messages(m((" user ", "a "), ("assistant", " b")))) == [("user", "a"), ("assistant", "b")]
    assert [tell(forms.normalized_messages(x)) for x in (m(("user", "a")), m(("user", None), ("assistant", "b")), m(("", "a"), ("assistant", "b")), m(("assistant", " ")))] == [None] * 4
    faults = leaks.skill_faults({"a": F.lit("x"), "b": F.lit("y")}, F.array().cast("array<string>"), F.lit(""), F.lit(""), F.array().cast("array<string>"), F.array(F.lit("b")))
    assert tell(faults) == ["length", "schema"]
    assert tell(prompts.hindsight(F.lit(None).cast("string"), F.lit(0.5), F.lit(0.25), F.array(F.lit(0.125)))).count("0.1250") == 1
    gate = audit.strict_gate(spark.createDataFrame([("hit", "x", 5, 0.3, 0.1, 0.5), ("mrr", "x", 5, 0.1, 0.0, 0.2)], "metric string, baseline string, n int, mean double, low double, high double"), 0.9, 0.0, 0.2, ["x"])
    assert gate.first()["gate_pass"] is True
    assert np.isclose(tell(audit.retrieval_overlap(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)))["jaccard"]), 1 / 3)


def test_spans_of_a_batch_are_those_of_each_edge(spark):
    """Tags of several tokens, across rows, in null and empty rows, and info that is short or has nulls; a tag is looked for once a batch, not once for each use."""
    marks = distill.Marks(((1, 1), (2,)), ((3, 4), (5,)))
    rows = [([1, 1, 7, 2, 3, 4, 8, 5], [1] * 8), (None, None), ([], []), ([7, 1], [1, 1]), ([1, 7, 3], [1] * 3), ([4, 8, 5], [1] * 3), ([1, 1, 7, 2, 3, 4, 8, 5], [1, 1, 0]), ([3, 4, 8, None, 5], [1, 1, None, 0, 1]), ([3, 4, 5], None), ([3, 4, 6, 6], None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, tokens array<int>, info array<int>").coalesce(1)
    plan = distill.with_spans(df, marks)
    got = [tuple(r["span"]) for r in plan.orderBy("i").collect()]
    none = ("no_search", 1, -1, 0, -1, 0)
    assert got[0] == (None, 6, 7, 2, 3, 0) and got[3:6] == [none] * 3 and got[1][0] == got[2][0] == "no_search"
    assert [g[0] for g in got[6:]] == ["observed_tokens", "observed_tokens", "empty_query", "empty_query"]
    assert got[7][1:] == (2, 4, 0, 0, 0)
    assert plan.filter("span.reason is null")._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_what_grows_from_a_small_table_grows_in_more_tasks(spark):
    from branchlight.operators import rescue

    for n in (0, 1000, 6000):
        rows = rescue.spread(spark.range(n).coalesce(1), "id", 500)
        assert rows.rdd.getNumPartitions() == max(1, n // 500) and rows.count() == n
        assert max([0, *rows.rdd.glom().map(len).collect()]) < 700
