"""Semantics of the engine's functions and operators on small hand-built cases."""

from __future__ import annotations

import importlib
import pkgutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import branchlight
from branchlight.functions import text as T
from branchlight.functions import tokens as K
from branchlight.operators import answers, audit, balance, curate, groups, retrieval, trees
from branchlight.sources import io
from branchlight.streaming import metrics, replay


def one(spark, column, **values):
    cols = [F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols).select(column.alias("x")).first()["x"]


def test_advantages(spark):
    rows = spark.createDataFrame([("a", 0.7), ("b", 1.0), ("b", 1.0), ("b", 1.0), ("c", 0.0), ("c", 1.0)], "uid string, score double")
    of = lambda c: {k: sorted(x["v"] for x in rows.withColumn("v", c).collect() if x["uid"] == k) for k in "abc"}
    grpo, token, rloo = of(groups.grpo(F.col("score"), "uid")), of(groups.grpo_per_token(F.col("score"), "uid")), of(groups.rloo(F.col("score"), "uid"))
    assert grpo["a"] == [pytest.approx(0.7 / (1 + 1e-6))] and grpo["b"] == [0, 0, 0]
    assert grpo["c"] == pytest.approx([-0.5 / (0.5**0.5 + 1e-6), 0.5 / (0.5**0.5 + 1e-6)])
    assert token["a"] == [0] and rloo["a"] == [0.7] and rloo["c"] == pytest.approx([-1, 1])
    with pytest.raises(ValueError, match="credit"):
        groups.advantages(rows.withColumn("tree_uid", F.lit(1)), "branch_credit")


def test_group_classes(spark):
    rows = spark.createDataFrame([("a", 0.8), ("a", 0.0), ("b", 0.79), ("c", 1.0)], "uid string, score double")
    assert {r["uid"]: r["class"] for r in groups.group_classes(rows).collect()} == {"a": "mixed", "b": "all_wrong", "c": "all_correct"}
    with pytest.raises(Exception, match="group size"):
        groups.group_classes(rows, size=2).collect()


def test_pass_at_k(spark):
    assert one(spark, groups.pass_at_k(F.col("n"), F.col("c"), 4), n=6, c=2) == pytest.approx(14 / 15)
    assert one(spark, groups.pass_at_k(F.col("n"), F.col("c"), 4), n=3, c=0) == 1


def credit(spark, rows):
    df = spark.createDataFrame([("t", "p", *r) for r in rows], "tree_uid string, parent_node_uid string, node_uid string, node_value double, leaf_count long")
    return {r["node_uid"]: r for r in trees.sibling_credit(df).collect()}


def test_sibling_credit(spark):
    got = credit(spark, [("x", 1.0, 1), ("y", 0.5, 2)])
    assert (got["x"]["baseline"], got["y"]["baseline"]) == (0.5, 1.0) and got["x"]["credit_raw"] == 0.5
    assert got["x"]["credit"] == pytest.approx(2, abs=1e-4) and got["y"]["credit"] == pytest.approx(-2, abs=1e-4)
    assert credit(spark, [("x", 0.3, 1)])["x"]["credit"] == 0 and credit(spark, [("x", 0.3, 1)])["x"]["baseline"] == 0.3
    assert {r["credit"] for r in credit(spark, [("x", 0.3, 1), ("y", 0.3, 4)]).values()} == {0}


def nodes(spark):
    rows = [("t", "r", None, 0, None), ("t", "a", "r", 1, 0.1), ("t", "b", "r", 1, 0.79), ("t", "c", "a", 2, 0.8), ("t", "d", "a", 2, 0.79)]
    return spark.createDataFrame(rows, "tree_uid string, node_uid string, parent_node_uid string, depth int, score double")


def test_tree_values_and_pruning(spark):
    n = nodes(spark)
    assert {r["node_uid"]: r["node_value"] for r in trees.node_values(n, 0.8).collect()} == {"r": pytest.approx(1 / 3), "a": 0.5, "b": 0.0, "c": 1.0, "d": 0.0}
    assert {r["node_uid"] for r in trees.leaves(n).collect()} == {"b", "c", "d"}
    assert {r["node_uid"] for r in trees.prune(n, n.filter("node_uid = 'd'")).collect()} == {"r", "a", "d"}
    assert trees.closure(n).count() == 5 + 4 + 2


@pytest.mark.parametrize(
    ("text", "expected"),
    [("The U.S. Constitution", "us constitution"), ("An apple, a pear!", "apple pear"), ("  Mixed CASE -- text  ", "mixed case text"), ("C++ and Python", "c and python"), ("the answer", "answer")],
)
def test_normalize_answer(spark, text, expected):
    assert one(spark, T.normalize_answer(F.col("s")), s=text) == expected


def test_answer_scoring(spark):
    assert one(spark, T.em_check(F.col("p"), F.col("g")), p="The Paris", g=["Paris"]) and not one(spark, T.em_check(F.col("p"), F.col("g")), p="London", g=["Paris"])
    assert not one(spark, T.answer_em(F.col("p"), F.col("g")), p="", g=[""])
    assert one(spark, T.token_f1(F.col("p"), F.col("g")), p="a b b c", g="b b d") == pytest.approx(2 / 3)
    assert one(spark, T.token_f1(F.col("p"), F.col("g")), p="yes", g="yes it is") == 0
    assert one(spark, T.extract_solution(F.col("s")), s="<answer>x</answer>") is None
    assert one(spark, T.extract_solution(F.col("s")), s="<answer>x</answer><answer> y </answer>") == "y"
    assert one(spark, T.question_key(F.col("s")), s=" New   Question ") == "new question"
    assert one(spark, T.cut_at_action(F.col("s")), s="a</answer>b</search>c") == "a</answer>b</search>"
    assert one(spark, T.redact(F.col("s"), F.col("a")), s="Al met Alan, al.", a=["Al", "Alan", ""]) == "[REDACTED] met [REDACTED], [REDACTED]."


@pytest.mark.parametrize(
    ("text", "valid"),
    [("<think>a</think><answer>b</answer>", True), ("<think>a</think>\n<search>q</search><information>i</information><think></think><answer>b</answer>\n", True), ("<think>a</think> x <answer>b</answer>", False), ("<think>a</think><search>q</search><answer>b</answer>", False), ("<answer>b</answer>", False), ("", False), ("<think>a</think><answer>b", False)],
)
def test_valid_sequence(spark, text, valid):
    assert one(spark, T.valid_sequence(F.col("s")), s=text) is valid


def test_token_math(spark):
    got = one(spark, K.gae(F.col("r"), F.col("v"), 0.9, 0.95), r=[0.0, 0.0, 1.0], v=[0.1, 0.2, 0.3])
    assert got == pytest.approx([0.6515675, 0.6685, 0.7])
    assert one(spark, K.score_at_last(F.lit(1.0), F.lit(5))) == [0, 0, 0, 0, 1]
    assert one(spark, K.pad(F.col("x"), 3, 0, True), x=[1, 2]) == [0, 1, 2] and one(spark, K.pad(F.col("x"), 3, 0), x=[1, 2, 3, 4]) == [1, 2, 3]
    assert one(spark, K.jsd(F.col("p"), F.col("p")), p=[0.5, 0.5]) == 0
    assert one(spark, F.concat(*[F.array(x) for x in audit.wilson(F.lit(0), F.lit(0))])) == [0, 0]
    assert one(spark, F.array(F.aggregate(K.kl_penalty(F.array(F.lit(-60.0)), F.array(F.lit(0.0)), "low_var_kl"), F.lit(0.0), lambda s, x: s + x))) == [10]


def test_curation(spark):
    rows = spark.createDataFrame([(i, i % 40, "s%d" % (i % 3)) for i in range(120)], "id long, g long, s string")
    split = curate.split_by_group(rows, "g", 0.1, 1)
    assert split.groupBy("g").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    assert split.filter("split = 'val'").select("g").distinct().count() == 4
    assert curate.stratified_split(rows, "s", ["id"], 0.1, 1).filter("split = 'val'").count() == 12
    assert curate.sample_per_group(rows, "s", ["id"], 5, 1).count() == 15
    with pytest.raises(ValueError, match="leak"):
        curate.require_empty(rows, "leak")
    with pytest.raises(Exception, match="conflict"):
        curate.union_checked(rows, rows.withColumn("s", F.lit("z")), "id").collect()


def test_balance():
    parts = balance.differencing([8, 7, 6, 5, 4], 2)
    assert sorted(i for p in parts for i in p) == list(range(5)) and sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in parts) == [14, 16]
    assert sorted(map(len, balance.differencing([9, 1, 1, 1, 5, 5], 3, True))) == [2, 2, 2]
    assert balance.greedy([5, 1, 1, 1], 2) == [[0], [1, 2, 3]]


def test_answers(spark):
    assert answers.arithmetic("(1 + 2) * 3") == 9 and answers.arithmetic("__import__('os')") is None and answers.arithmetic("1/0") is None
    assert answers.countdown_score("3*4", [3, 4], 12) == 1 and answers.countdown_score("3*4", [3, 5], 12) == 0.1 and answers.countdown_score(None, [], 1) == 0
    assert answers.last_boxed(r"a \boxed{x} \boxed{\frac{1}{2}}") == r"\frac{1}{2}" and answers.last_boxed(r"\boxed{x") is None
    assert answers.first_json_object('x {bad} {"a": {"b": 1}} y') == {"a": {"b": 1}} and answers.first_json_object("{") is None
    short = answers.compress_to_budget("BEGIN-" + "x" * 4000 + "-END", 800, len)
    assert len(short) <= 800 and short.startswith("BEGIN-") and short.endswith("-END")
    with pytest.raises(ValueError, match="budget"):
        answers.compress_to_budget("x" * 100, 3, len)
    assert one(spark, answers.gsm8k_answer(F.col("s")), s="so #### 1,234") == "1234" and one(spark, answers.gsm8k_answer(F.col("s"), False), s="1 2 .") == "2"


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red dog"), (3, "blue")], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "Red fox!"), (1, "none")], "query_id long, text string")
    got = retrieval.bm25(asked, docs, 2).collect()
    assert [(r["query_id"], r["rank"], r["doc_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 1), (0, 2, 2)]
    assert one(spark, retrieval.unit(F.col("v")), v=[3.0, 4.0]) == pytest.approx([0.6, 0.8])


def test_metric_stream(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "a.log").write_text("step:1 - loss:2.0 - lr:nan\nnoise\n\x1b[31mstep:2 - loss:1.5\x1b[0m\nstep:1 - loss:9\n")
    q = metrics.follow(spark, str(folder)).writeStream.format("memory").queryName("points").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    (folder / "b.log").write_text("step:2 - loss:7\nstep:3 - loss:1.0\n")
    q.processAllAvailable()
    q.stop()
    assert sorted((r["step"], r["value"], r["change"]) for r in spark.table("points").collect() if r["step"] > 1) == [(2, 1.5, -0.5), (3, 1.0, -0.5)]


def test_replay():
    call = lambda t, i: {"event_type": "api_response", "turn_index": t, "tool_call_id": i}
    seen = lambda t, i: {"event_type": "retrieval_observation", "turn_index": t, "tool_call_id": i}
    assert replay.fold([call(0, "a"), seen(0, "x"), seen(0, "y"), call(1, "b"), call(1, "c"), seen(1, "z"), seen(1, "b")]) == {"matched": 1, "sole": 1, "orphans": 2, "pending": 1}


def test_sources(spark, tmp_path):
    path = tmp_path / "step_000007_chunk_02_trees.jsonl"
    path.write_text('{"a": 1}\n\n{"a": 2}\n')
    got = io.read_jsonl(spark, str(path), schema="a INT", provenance=True).collect()
    assert sorted((r["a"], r["_source_line"]) for r in got) == [(1, 1), (2, 3)]
    assert {(r["step"], r["chunk"]) for r in io.read_tree_dumps(spark, str(tmp_path), "a INT").collect()} == {(7, 2)}
    path.write_text('{"a": 1}\nnot json\n')
    with pytest.raises(Exception):
        io.read_jsonl(spark, str(path), schema="a INT").collect()
    left, right = (spark.createDataFrame(x, "key string, value string") for x in ([("a", "1"), ("b", "1")], [("b", "2"), ("c", "2")]))
    assert {tuple(r) for r in io.merge_cache(left, right).collect()} == {("a", "1"), ("b", "2"), ("c", "2")}
    with pytest.raises(Exception):
        io.write_new(left, str(tmp_path))


def test_nothing_outside_imports_the_training_data_operators():
    names = [m.name for m in pkgutil.walk_packages(branchlight.__path__, "branchlight.") if not m.name.startswith("branchlight.llm")]
    code = f"import sys\nfor n in {names!r}: __import__(n)\nassert not [m for m in sys.modules if m.startswith('branchlight.llm')]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=importlib.import_module("os").path.dirname(branchlight.__path__[0]))


def test_trajectories(spark):
    from branchlight.functions import trajectory as R

    search, final = "<think>a</think><search>q</search>", "<think>a</think> <answer>b</answer>"
    turns = lambda *t: [(i, raw, info, False) for i, (raw, info) in enumerate(t)]
    cases = [
        (turns((search, "i"), (final, None)), []),
        (turns(*[(search, "i")] * 3, (final, None)), []),
        (turns((final, None)), ["requires_at_least_one_search_round"]),
        (turns(*[(search, "i")] * 4, (final, None)), ["too_many_search_rounds"]),
        (turns((search, None), (final, None)), ["missing_information_after_search"]),
        (turns((search, "<think>"), (final, None)), ["control_tag_inside_information"]),
        ([], ["no_generation_turn"]),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], f"i int, t array<{R.TURN}>")
    got = {r["i"]: r["x"] for r in df.select("i", R.validate_trajectory(F.col("t"), F.lit(True)).alias("x")).collect()}
    assert [got[i] for i in range(len(cases))] == [c for _, c in cases]
    extra = spark.createDataFrame([(turns((search + "<search>r</search>", "i"), (final, None)),)], f"t array<{R.TURN}>")
    assert "unexpected_tag_count_<search>" in extra.select(R.validate_trajectory(F.col("t"), F.lit(True))).first()[0]
    parse = lambda s: one(spark, R.parse_turn(F.col("s")), s=s)
    assert parse("<think>unfinished")["action"] == "failure" and parse("<think>a</think><answer> </answer>")["action"] == "failure"
    assert parse(search)["query"] == "q" and parse(final)["strict"] and not parse("x" + final)["strict"]
    assert one(spark, F.array(*R.normalize_thinking(F.col("s"))[:1]), s=" <THINKING>a</thinking > ") == ["<think>a</think>"]
    assert one(spark, R.clip_observation(F.col("t"), 4, F.array(F.lit(9))), t=[1, 2, 3, 4, 5]) == [1, 2, 3, 9]
    assert one(spark, R.keep_head_and_tail(F.col("t"), 1, 3), t=[1, 2, 3, 4, 5]) == [1, 4, 5]
