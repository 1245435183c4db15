"""Batches, replay, resamples, splits, caches and calls: small cases, brute force and bad luck."""

from __future__ import annotations

import os
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from branchlight.operators import audit, batching, curate, fetching
from branchlight.sources import io
from branchlight.streaming import replay


def test_no_batch_passes_the_budget(spark):
    rng = np.random.default_rng(3)
    rows = [(f"q{i % 3}", i, int(n)) for i, n in enumerate([500, *rng.integers(1, 90, 300)])]
    df = spark.createDataFrame(rows, "request string, at long, n long")
    for by_length in (False, True):
        plan = batching.pack(df, "request", ["at"], "n", 200, by_length).cache()
        batches = plan.groupBy("request", "batch").agg(F.count("*").alias("k"), F.max("n").alias("w"), F.max("width").alias("width")).collect()
        assert all((b["k"] * b["w"] <= 200 or b["k"] == 1) and b["w"] == b["width"] for b in batches) and any(b["w"] == 500 for b in batches)
        back = batching.restore(plan.select("request", "place", F.col("at").alias("answer")), plan, ["request"]).orderBy("request", "row_idx").collect()
        want = [r[1] for q in ("q0", "q1", "q2") for r in rows if r[0] == q]
        assert [r["answer"] for r in back] == want
        with pytest.raises(Exception, match="results of a place"):
            batching.restore(plan.filter("place > 0").select("request", "place"), plan, ["request"]).collect()
    assert len(batches) < df.count() / 2
    cut = batching.pack(df, "request", ["at"], "n", 200, chunk=10)
    assert cut.select("request", "piece").distinct().count() == 31 and cut.agg(F.max("place")).first()[0] == 9
    with pytest.raises(Exception, match="positive"):
        batching.pack(df.withColumn("n", F.lit(0)), "request", ["at"], "n", 200).collect()


def test_batches_of_a_sequence_and_windows(spark):
    df = spark.createDataFrame([("a", i, n, p) for i, (n, p) in enumerate([(4, [1, 3]), (6, []), (5, [0]), (9, [8])])], "request string, at int, n int, p array<int>")
    plan = batching.kept_tail(batching.pack(df, "request", ["at"], "n", 18), ["request"], "p", "n")
    got = plan.withColumn("w", batching.window_positions(F.col("p"), F.col("n"), F.col("width"), F.col("keep"))).orderBy("at").collect()
    assert [(r["batch"], r["slot"], r["width"], r["keep"], r["w"]) for r in got] == [(0, 0, 6, 5, [2, 4]), (0, 1, 6, 5, []), (0, 2, 6, 5, [0]), (1, 0, 9, 1, [0])]


def log(spark, events):
    return spark.createDataFrame([(c, i, k, t, x) for i, (c, k, t, x) in enumerate(events)], "candidate_id string, row_idx long, event_type string, turn_index int, tool_call_id string")


EVENTS = [("a", "c", 0, "x"), ("a", "o", 0, "y"), ("a", "o", 0, "y"), ("b", "c", 1, "p"), ("b", "c", 1, "q"), ("b", "o", 1, "z"), ("b", "o", 1, "q"), ("a", "c", 2, "m"), ("a", "o", 2, "m")]
FULL = [(c, {"c": replay.CALL, "o": replay.ANSWER}[k], t, x) for c, k, t, x in EVENTS]


def test_replay_as_batch_and_stream(spark, tmp_path):
    want = {"a": (1, 1, 1, 0), "b": (1, 0, 1, 1)}
    got = {r["candidate_id"]: tuple(r)[1:] for r in replay.replay(log(spark, FULL)).collect()}
    assert got == want
    assert replay.replay(log(spark, FULL).limit(0)).count() == 0
    source = tmp_path / "in"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        seen: dict = {}

        def keep(batch, _):
            seen.update({r["candidate_id"]: tuple(r)[1:5] for r in batch.collect()})

        full = log(spark, FULL)
        for cut in ((0, 4), (4, 7), (7, 9)):
            full.filter(F.col("row_idx").between(cut[0], cut[1] - 1)).coalesce(1).write.mode("append").json(str(source))
            stream = spark.readStream.schema(full.schema).json(str(source))
            q = replay.follow(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(keep).start()
            q.awaitTermination(180)
        assert seen == want
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_bootstrap_is_the_same_however_rows_lie(spark):
    rng = np.random.default_rng(5)
    rows = [("g", float(v)) for v in rng.normal(2, 1, 400)] + [("h", 1.0)] * 50 + [("h", 0.0)] * 50 + [("one", 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    tell = lambda d: sorted((r["g"], round(r["mean"], 12), r["low"], r["high"], r["n"]) for r in audit.bootstrap(d, "g", "v", 1000, 7, 8).collect())
    first = tell(df.repartition(1))
    assert first == tell(df.repartition(7).union(df.limit(0)))
    by = {r[0]: r for r in first}
    assert by["one"][1:] == (3.0, 3.0, 3.0, 1)
    values = np.array([v for g, v in rows if g == "g"])
    plain = np.quantile(np.random.default_rng(1).choice(values, (4000, 400)).mean(axis=1), [0.025, 0.975])
    assert by["g"][1] == pytest.approx(values.mean()) and by["g"][2:4] == pytest.approx(plain, abs=0.02)
    assert by["h"][2:4] == pytest.approx((0.4, 0.6), abs=0.02)


def walked(sizes, budget):
    taken, chosen = 0, []
    for g, n in sizes:
        if taken < budget and taken + n <= budget or not chosen:
            chosen.append(g)
            taken += n
    return set(chosen)


def test_budget_split_is_the_greedy_walk(spark):
    rng = np.random.default_rng(11)
    rows = [(f"g{g}", i) for g in range(60) for i in range(int(rng.pareto(1.2) * 4) + 1)]
    df = spark.createDataFrame(rows, "g string, i int")
    drawn = df.groupBy("g").count().withColumn("d", curate.draw(3, "g")).orderBy("d").collect()
    for ratio in (0.05, 0.3, 0.9):
        got = {r["g"] for r in curate.split_by_budget(df, "g", ratio, 3).filter("split = 'val'").collect()}
        assert got == walked([(r["g"], r["count"]) for r in drawn], max(1, int(len(rows) * ratio)))
    assert curate.split_by_budget(df, "g", 0.0, 3).filter("split = 'val'").count() == 0
    assert curate.split_by_budget(df.limit(0), "g", 0.5, 3).count() == 0


def test_two_writers_lose_no_key(spark, tmp_path):
    path = str(tmp_path / "cache")
    failed = []

    def write(k):
        try:
            io.save_cache(spark.createDataFrame([(f"{k}-{i}", str(i)) for i in range(3)] + [("shared", str(k))], "key string, value string"), path)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = dict(map(tuple, spark.read.parquet(io.newest(spark, path)).collect()))
    assert not failed and len(got) == 13 and sorted(os.listdir(f"{path}/_commits"))[-1].endswith("00000003")
    assert not io.create_once(spark, f"{path}/_commits/00000003", "late")
    os.rename(f"{path}/generation=00000003", f"{path}/_writing/" + open(f"{path}/_commits/00000003").read())  # lost between commit and move
    assert spark.read.parquet(io.newest(spark, path)).count() == 13
    assert io.warm_cache(spark.createDataFrame([("shared", "old"), ("new", "1")], "key string, value string"), spark, path).endswith("00000004")
    warm = dict(map(tuple, spark.read.parquet(io.newest(spark, path)).collect()))
    assert warm["shared"] == got["shared"] and warm["new"] == "1"
    assert io.warm_cache(spark.createDataFrame([("new", "2")], "key string, value string"), spark, path) is None


def test_copy_by_content(spark, tmp_path):
    (tmp_path / "model").mkdir()
    (tmp_path / "model" / "w").write_text("1")
    first = io.copy_by_content(spark, str(tmp_path / "model"), str(tmp_path / "local"))
    assert open(f"{first}/w").read() == "1" and io.copy_by_content(spark, str(tmp_path / "model"), str(tmp_path / "local")) == first
    (tmp_path / "model" / "w").write_text("22")
    assert io.copy_by_content(spark, str(tmp_path / "model"), str(tmp_path / "local")) != first


def test_fetching(spark, tmp_path):
    folder = str(tmp_path)

    def fetcher(key):
        with open(f"{folder}/{key}", "a") as f:
            f.write("x")
        calls = os.path.getsize(f"{folder}/{key}")
        if key == "hangs":
            time.sleep(60)
        if key == "down" or key == "twice" and calls <= 2:
            raise OSError("503")
        return f"got {key}"

    asked = spark.createDataFrame([(k,) for k in ("ok", "ok", "twice", "hangs", "down", "cached", None)], "key string")
    cache = spark.createDataFrame([("cached", "old")], "key string, value string")
    start = time.time()
    answers, new = fetching.through_cache(asked, cache, fetcher, limits=fetching.Limits(attempts=3, timeout=2, first_wait=0.01), tasks=2)
    got = {r["key"]: (r["value"], r["error"]) for r in answers.collect()}
    assert got == {"ok": ("got ok", None), "twice": ("got twice", None), "hangs": (None, "timeout after 2 s"), "down": (None, "OSError: 503"), "cached": ("old", None), None: (None, None)}
    assert answers.count() == 7 and {r["key"] for r in new.collect()} == {"ok", "twice"} and time.time() - start < 60
    assert {k: os.path.getsize(f"{folder}/{k}") for k in ("ok", "twice", "down", "hangs")} == {"ok": 1, "twice": 3, "down": 3, "hangs": 3}


def test_a_service_that_is_down_is_not_called_again_and_again():
    limits = fetching.Limits(parallel=4, attempts=5, timeout=1, first_wait=0.0, retries=3, retry_share=0.0)
    calls = []

    def fetcher(key):
        calls.append(key)
        raise OSError("down")

    found = fetching.together(fetcher, [str(i) for i in range(20)], limits, fetching._Budget(limits))
    assert len(calls) == 23 and all(f[1] == "OSError: down" for f in found)


def test_bm25_of_odd_rows_and_little_shuffle(spark, monkeypatch):
    """Repeated and null ids, null and empty texts, ties beyond k: as counted by hand, whether terms are broadcast or shuffled. No row for each query and document is sorted."""
    from math import log

    from branchlight.operators import retrieval

    texts = [(1, "a b b"), (1, "a c d"), (2, "b"), (None, "a b"), (None, "a b"), (3, None), (4, ""), (5, "x y"), (5, "a x"), *[(i, "c q") for i in range(10, 30)]]
    asked = [(1, "a b"), (2, "C c"), (3, "none"), (4, "x q")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    queries = spark.createDataFrame(asked, "query_id long, text string")
    tf: dict = {}
    sizes = [len(t.split()) for _, t in texts if t is not None]
    for i, t in texts:
        for w in (t or "").split():
            tf[i, len(t.split()), w] = tf.get((i, len(t.split()), w), 0) + 1
    want: dict = {}
    for q, text in asked:
        for w in set(text.lower().split()):
            df = sum(x == w for *_, x in tf)
            for (i, n, x), c in tf.items():
                if x == w:
                    want[q, i] = want.get((q, i), 0.0) + log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * c / (c + 0.9 * (0.6 + 0.4 * n / (sum(sizes) / len(sizes))))
    for most in (retrieval.MOST_TERMS, 1):
        monkeypatch.setattr(retrieval, "MOST_TERMS", most)
        got = {(r["query_id"], r["doc_id"]): r["score"] for r in retrieval.bm25_scores(queries, docs).collect()}
        assert got == {k: pytest.approx(v, abs=2e-6) for k, v in want.items()}
        best = [(r["query_id"], r["doc_id"]) for r in retrieval.bm25(queries, docs, 3).orderBy("query_id", "rank").collect()]
        assert best == [k for q in (1, 2, 4) for k in sorted((k for k in want if k[0] == q), key=lambda k: (-round(want[k], 6), k[1] is not None, k[1]))[:3]]
    monkeypatch.undo()
    plain = docs.filter("doc_id > 5")
    assert retrieval.bm25_scores(queries, plain, k=3).count() < 3 * 4 * plain.rdd.getNumPartitions() + 1
    assert retrieval.bm25_scores(queries, docs.limit(0)).count() == retrieval.bm25_scores(queries.limit(0), docs).count() == 0


def test_balanced_rows_keep_their_columns_and_number(spark):
    """A repeated or null key and a null group make no row more or fewer, and parts are those of the lengths in order of the key."""
    from branchlight.operators import balance

    rows = [("g", 3, 8, "c"), ("g", 1, 7, "a"), ("g", 2, 6, "b"), ("g", 5, 4, "e"), ("g", 4, 5, "d"), ("h", 1, 2, "x"), ("h", 1, 2, "y"), ("h", None, 1, "z"), (None, 1, 9, "n")]
    df = spark.createDataFrame(rows, "group string, k int, n int, s string")
    for method in ("differencing", "greedy"):
        got = balance.balance(df, "group", "k", "n", 2, method)
        assert got.columns == ["group", "k", "n", "s", "part"]
        have = {(r["group"], r["s"]): r for r in got.collect()}
        assert got.count() == len(have) == len(rows) and {tuple(r)[:4] for r in have.values()} == set(rows)
        sizes = [7, 6, 8, 5, 4]
        want = balance.greedy(sizes, 2) if method == "greedy" else balance.differencing(sizes, 2)
        assert [have["g", s]["part"] for s in "abcde"] == [next(p for p, m in enumerate(want) if i in m) for i in range(5)]
