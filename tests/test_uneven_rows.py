"""Batches whose rows do not divide, nulls among them, by the queries and their SQL."""

from __future__ import annotations

import hashlib
from decimal import Decimal

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from branchlight.operators import audit, batch, tokenizing
from branchlight.plans import registry
from pyspark.sql import functions as F


@pytest.fixture(params=[9, 10, 17])
def uneven(spark, tmp_path, request):
    rows = [(i, None if i in (2, 4, 5, 6, 7) else "en", "web", f"t{i}", None if i in (3, 4, 5, 6, 7) else 10 * i) for i in range(request.param)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["batch_chunk", "batch_fold", "batch_unfold"])
def test_rows_left_over(spark, uneven, name):
    got = [tuple(r) for r in registry.QUERIES[name](spark, uneven).collect()]
    want = duckdb.sql(registry.ORACLES[name].replace("documents", f"'{uneven}/documents.parquet/*.parquet'")).fetchall()
    assert sorted(got, key=str) == sorted(want, key=str)


def test_uneven_folds_stay_errors_where_asked_for(spark):
    rows = spark.range(10).withColumnRenamed("id", "row_idx").selectExpr("row_idx", "row_idx * 2 AS x")
    with pytest.raises(ValueError, match="do not fold"):
        batch.fold(rows, 3, 10)
    assert sorted(map(tuple, batch.fold_by(rows, 4).collect())) == [(0, [0, 2, 4, 6]), (1, [8, 10, 12, 14]), (2, [16, 18])]


def test_sums_that_end_on_a_tie(spark):
    tie = spark.range(60000, numPartitions=7).select((F.when(F.col("id") < 41585, F.col("id") % 10 * 0.1 * 10).otherwise(0.0) / 10).alias("x"))
    orders = [tie, tie.orderBy("x"), tie.orderBy(F.desc("x")), tie.repartition(5, "x")]
    want = float(sum(Decimal(i % 10) / 10 for i in range(41585)))
    assert {df.agg(audit.exact_sum(F.col("x"))).first()[0] for df in orders} == {want}
    odd = spark.createDataFrame([(1.0,), (float("inf"),), (None,)], "x double")
    assert odd.agg(audit.exact_sum(F.col("x"))).first()[0] == float("inf")


def test_mean_score_at_a_tie_of_rounding(spark):
    """Over sf0.01 the mean score is 29951.1 / 60000 = 0.499185."""
    got = {r["m"]: r["mean"] for r in registry.QUERIES["training_metrics"](spark, "/root/testdata/sf0.01").collect()}
    assert got["score"] == 0.49919


def test_repeatable_resamples_by_brute_force(spark, monkeypatch):
    """Draws over several blocks and batches; a null value does not count where it is drawn, and a null group has no row."""
    monkeypatch.setattr(audit, "BLOCK_DRAWS", 12)
    monkeypatch.setattr(audit, "AT_ONCE", 7)
    rng = np.random.default_rng(5)
    rows = [(g, i, None if i % 9 == 4 else float(rng.normal())) for g, n in (("a", 53), ("b", 1), ("c", 17), (None, 3)) for i in range(n)]
    want = {}
    for g in ("a", "b", "c"):
        mine = sorted((hashlib.sha256(f"7:{i}".encode()).hexdigest()[:13], i, v) for h, i, v in rows if h == g)
        pick = lambda r, i, n, g=g: int(int(hashlib.sha256(f"7:{g}:{r}:{i}".encode()).hexdigest()[:13], 16) / 16**13 * n)
        taken = [[mine[pick(r, i, len(mine))][2] for i in range(len(mine))] for r in range(6)]
        means = [np.mean([v for v in t if v is not None]) for t in taken]
        want[g] = (np.mean([v for *_, v in mine if v is not None]), *np.quantile(means, [0.025, 0.975]), len(mine))
    got = audit.bootstrap_by_index(spark.createDataFrame(rows, "g string, k int, v double"), "g", ["k"], "v", 6, 7).collect()
    assert {r["g"] for r in got} == set(want)
    for r in got:
        assert tuple(r)[1:] == pytest.approx(want[r["g"]])


def test_vocabulary_gets_parts_of_a_batch(monkeypatch):
    monkeypatch.setattr(tokenizing, "PART", 10)
    seen = []
    got = tokenizing._in_parts(["a" * 6, None, "b" * 6, "", "c" * 30, None], lambda xs: seen.append(xs) or [[len(x)] for x in xs], pa.list_(pa.int32()))
    assert got.to_pylist() == [[6], None, [6], [0], [30], None] and [len(x) for x in seen] == [1, 2, 1]
    assert tokenizing._in_parts([], list, pa.string()).to_pylist() == []
