"""What the queries over tables do not reach: errors, files, streams, small cases by hand."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from branchlight.functions import forms, gates, leaks, rewards
from branchlight.operators import batch, curate, selection
from branchlight.sources import io
from branchlight.streaming import services


def test_dataset_folders_fall_back(spark, tmp_path):
    (tmp_path / "dev.json").write_text('[{"id": "a"}, {"id": "b"}]')
    (tmp_path / "train.jsonl").write_text('{"id": "c"}\n')
    got = io.read_dataset(spark, str(tmp_path), "id STRING").collect()
    assert sorted((r["id"], r["split"]) for r in got) == [("a", "dev"), ("b", "dev")]
    assert [tuple(r) for r in io.read_dataset(spark, str(tmp_path), "id STRING", "train").collect()] == [("c", "train")]
    with pytest.raises(FileNotFoundError):
        io.split_path(spark, str(tmp_path / "none"))


def test_line_numbers_count_blank_lines_and_splits(spark, tmp_path):
    lines = {"a.jsonl": ['{"n": 1}', "", '{"n": 3}'], "b.jsonl": [json.dumps({"n": i, "pad": "x" * 50}) for i in range(1, 400)]}
    for name, rows in lines.items():
        (tmp_path / name).write_text("\n".join(rows) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = io.read_jsonl(spark, str(tmp_path), schema="n INT", provenance=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 401 and all(r["n"] == r["_source_line"] for r in got)


def test_cache_generations(spark, tmp_path):
    make = lambda **kv: spark.createDataFrame(list(kv.items()), "key string, value string")
    path = str(tmp_path / "cache")
    assert io.newest(spark, path) is None
    io.save_cache(make(a="1", b="1"), path)
    last = io.save_cache(make(b="2", c="2"), path)
    assert io.newest(spark, path).endswith("generation=00000001") and dict(map(tuple, spark.read.parquet(last).collect())) == {"a": "1", "b": "2", "c": "2"}


def test_file_system(spark, tmp_path):
    io.make_folder(spark, str(tmp_path / "x" / "y"))
    assert io.exists(spark, str(tmp_path / "x" / "y")) and not io.exists(spark, str(tmp_path / "z"))
    (tmp_path / "x" / "f").write_text("hi")
    io.copy(spark, str(tmp_path / "x"), str(tmp_path / "z"))
    assert (tmp_path / "z" / "f").read_text() == "hi"


def test_wide_form(spark, tmp_path):
    row = {c: F.lit(1) for c in io.WIDE} | {"messages": F.array(F.struct(F.lit("user").alias("role"), F.lit("é").alias("content"))), "trajectory": F.lit("t"), "original_trajectory": F.lit("o")}
    rows = spark.range(1).select(*[c.alias(n) for n, c in row.items()])
    io.write_wide(rows, str(tmp_path / "w"))
    got = spark.read.parquet(str(tmp_path / "w")).first()
    assert got["messages"] == '[{"content":"é","role":"user"}]' and len(got["trajectory_sha256"]) == 64
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        io.write_wide(rows, str(tmp_path / "w"))


def test_errors_of_contracts(spark):
    rows = spark.createDataFrame([(i % 5, i) for i in range(10)], "k int, v int")
    one = rows.dropDuplicates(["k"])
    ids = lambda *ks: spark.createDataFrame(list(enumerate(ks)), "at int, k int")
    assert [r["k"] for r in curate.fetch(one, "k", ids(3, 0)).orderBy("at").collect()] == [3, 0]
    for bad, why in ((ids(3, 9), "not found"), (ids(3, 3), "listed twice")):
        with pytest.raises(Exception, match=why):
            curate.fetch(one, "k", bad).collect()
    with pytest.raises(Exception, match="found twice"):
        curate.fetch(rows, "k", ids(1)).collect()
    with pytest.raises(Exception, match="in no split"):
        curate.route(rows, "k", one.filter("k < 3"), one.filter("k = 3"), "error").collect()
    with pytest.raises(Exception, match="in both splits"):
        curate.route(rows, "k", one, one.filter("k = 3")).collect()
    with pytest.raises(ValueError, match="sensitive"):
        gates.require_columns(["id", "answers"])
    numbered = rows.select(F.col("v").cast("long").alias("row_idx"), "k")
    with pytest.raises(ValueError, match="equal chunks"):
        batch.chunk(numbered, 3, 10)
    with pytest.raises(ValueError, match="columns differ"):
        batch.concat([(numbered, 10), (numbered.drop("k"), 10)])
    with pytest.raises(Exception, match="unequal length"):
        batch.from_columns([numbered, numbered.filter("row_idx < 9").select("row_idx")]).collect()


def test_padding_longer_than_the_batch(spark):
    rows = spark.createDataFrame([(i, f"r{i}") for i in range(3)], "row_idx long, x string")
    got, pad = batch.pad_to_divisor(rows, 8, 3)
    assert pad == 5 and [r["x"] for r in got.orderBy("row_idx").collect()] == ["r0", "r1", "r2"] * 2 + ["r0", "r1"]
    assert batch.unpad(got, 8, 5).count() == 3 and len(list(batch.each(batch.mini_batches(rows, 2, 1)))) == 2
    assert batch.lists(rows).first()["x"] == ["r0", "r1", "r2"]


def test_budget_split_keeps_groups(spark):
    rows = spark.createDataFrame([(g, i) for g in range(20) for i in range(g % 4 + 1)], "g long, i int")
    got = curate.split_by_budget(rows, "g", 0.2, 1).collect()
    sides = {s: {r["g"] for r in got if r["split"] == s} for s in ("train", "val")}
    assert not sides["train"] & sides["val"] and 0 < sum(r["split"] == "val" for r in got) <= 10 and len(got) == rows.count()


def test_selection_without_replacement_runs_out(spark):
    found = spark.createDataFrame([("t", f"n{i}", 1, 0.5, True, 1, 0.5, 0.2) for i in range(3)], "tree_uid string, node_uid string, depth int, uncertainty double, after_search boolean, children int, preference double, prior double")
    got = selection.select(found, "uncertainty_balanced", 5, 3).collect()
    assert sorted(r["draw"] for r in got) == [0, 1, 2, 3, 4] and len({r["node_uid"] for r in got if r["draw"] < 3}) == 3
    stats = selection.selection_stats(selection.select(found, "grouped_random", 4, 3)).first()
    assert (stats["selected"], stats["duplicates"]) == (4, 3)
    with pytest.raises(ValueError, match="unknown mode"):
        selection.weight("best")


def test_judge_failures_count_as_no(spark):
    rows = spark.createDataFrame([(i,) for i in range(10)], "x int")

    def judge(items):
        if any(x == 7 for (x,) in items):
            raise TimeoutError
        return [x % 2 == 0 for (x,) in items]

    got = {r["x"]: r["equivalent"] for r in rewards.judged(rows.coalesce(1), judge, ["x"], batch=5).collect()}
    assert got == {i: i in (0, 2, 4) for i in range(10)}


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("\\frac12", "\\frac{1}{2}", True), ("0.5", "1/2", True), (".5", "0.5", True), ("\\sqrt3", "\\sqrt{3}", True), ("x=7", "7", True), ("abc=7", "7", False), ("5\\text{ cm}", "5", True), ("90^\\circ", "90", True), ("\\frac1{72}", "\\frac{1}{72}", True), ("1/02", "\\frac{1}{2}", False), ("50\\%", "50", True), ("\\sqrt", "\\sqrt", True), (None, None, True), ("1", None, False)],
)
def test_latex_answers(a, b, same):
    assert rewards.same_answer(a, b) is same


def test_boxes():
    assert rewards.boxed("\\boxed{1} then \\boxed{a{b}c}") == "a{b}c" and rewards.boxed("\\boxed 7$ x") == "7" and rewards.boxed("none") is None


def test_trajectory_faults(spark):
    block = "<think>a</think><search>{q}</search><information>i</information>"
    cases = {
        block.format(q="q") + "<think>b</think><answer>c</answer>": None,
        block.format(q=" ") + "<think>b</think><answer>c</answer>": "empty_query",
        block.format(q="q") + "<think>b</think><answer> </answer>": "empty_answer",
        block.format(q="q") * 4 + "<think>b</think><answer>c</answer>": "number_of_searches",
        block.format(q="<think>q</think>") + "<think>b</think><answer>c</answer>": "malformed",
        block.format(q="q"): "malformed",
        "": "malformed",
    }
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", forms.parts(F.col("t"))["fault"].alias("f")).collect()
    assert {r["t"]: r["f"] for r in got} == cases


def test_visible_answers_may_be_asked_for_but_not_claimed(spark):
    cases = [("find Paris", "Paris", "Is it Paris?", False), ("find Paris", "Paris", "Which?", True), ("the answer is Paris", "Paris", "Is it Paris?", True), ("parish", "Paris", "Which?", False)]
    got = spark.createDataFrame(cases, "t string, a string, v string, w boolean").select("w", leaks.leaks_answer(F.col("t"), F.col("a"), F.col("v")).alias("g")).collect()
    assert all(r["w"] == r["g"] for r in got)


def test_streams_flush_and_report(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"key": "k", "value": "1", "step": 3}\n')
    stream = spark.readStream.schema("key string, value string, step long").json(str(tmp_path / "in"))
    q = services.flush_cache(stream.select("key", "value"), str(tmp_path / "cache"), str(tmp_path / "c1"), "0 seconds")
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.read.parquet(io.newest(spark, str(tmp_path / "cache"))).collect()] == [("k", "1")]
    seen = []
    q = services.metric_sink(stream.select("key", "step", F.col("value").cast("double").alias("value")), [lambda step, m: seen.append((step, dict(m)))], str(tmp_path / "c2"), "0 seconds")
    q.processAllAvailable()
    q.stop()
    assert seen == [(3, {"k": 1.0})]
    with pytest.raises(RuntimeError, match="http_401"):
        services.stop_on_systemic(spark.createDataFrame([("http_401",), (None,)], "systemic_failure string"))
