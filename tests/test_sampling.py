"""Samples that alternate between buckets, unique questions by source, shuffled samples and changes between summaries."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from branchlight.operators import audit
from branchlight.operators import curate as C


def drawn(seed, key):
    return hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:13], key


def alternating_brute(rows, order, limit, cap, seed):
    """Turn by turn over all rows."""
    queues = {b: sorted((r for r in rows if r[1] == b), key=lambda r: drawn(seed, r[0])) for b in order}
    taken, found = Counter(), []
    while len(found) < limit:
        before = len(found)
        for b in order:
            while queues[b] and len(found) < limit:
                row = queues[b].pop(0)
                if taken[row[2]] < cap:
                    taken[row[2]] += 1
                    found.append(row)
                    break
        if len(found) == before:
            break
    return [(k, b, who, at) for at, (k, b, who) in enumerate(found, 1)]


@pytest.mark.parametrize("limit, cap, owners", [(1, 1, 3), (12, 1, 40), (12, 3, 5), (30, 2, 9), (500, 2, 30)])
def test_alternating_sample(spark, limit, cap, owners):
    rng = random.Random(limit * 100 + cap)
    # One owner holds a third of all rows and nearly all of the low bucket.
    rows = [(i, rng.choice(["low", "mid", "mid", "high", "none", None]), rng.choice([0] * (owners // 2) + [None, *range(owners)])) for i in range(300)]
    rows = [(i, b, 0 if b == "low" and i % 9 else who) for i, b, who in rows]
    df = spark.createDataFrame(rows, "id long, bucket string, owner int").repartition(4)
    got = C.alternating_sample(df, ["id"], "bucket", ["low", "high", "mid"], "owner", limit, cap, 3)
    assert sorted(map(tuple, got.select("id", "bucket", "owner", "at").collect()), key=lambda r: r[3]) == alternating_brute(rows, ["low", "high", "mid"], limit, cap, 3)


def test_alternating_sample_of_nothing(spark):
    none = spark.createDataFrame([], "id long, bucket string, owner int")
    assert C.alternating_sample(none, ["id"], "bucket", ["a", "b"], "owner", 5, 1, 3).count() == 0
    with pytest.raises(ValueError):
        C.alternating_sample(none, ["id"], "bucket", ["a"], "owner", 5, 0, 3)


def test_unique_questions(spark):
    rows = [(i, "ab"[i % 2], None if i % 10 == 0 else f"q {i % 14}") for i in range(80)]
    df = spark.createDataFrame(rows, "id long, source string, question string")
    got = C.unique_questions(df, "source", F.col("question"), ["a", "b"], ["id"], 6, 1).collect()
    assert Counter(r["source"] for r in got) == {"a": 6, "b": 6} and len({(r["source"], r["question"]) for r in got}) == 12 and None not in {r["question"] for r in got}
    with pytest.raises(ValueError, match="'b': \\(7, 8\\)"):
        C.unique_questions(df, "source", F.col("question"), ["a", "b"], ["id"], 8, 1)


def test_shuffled_sample(spark):
    got = C.shuffled_sample(spark.range(50).withColumn("g", F.col("id") % 3), "g", ["id"], 10, 5).collect()
    assert Counter(r["g"] for r in got) == {0: 10, 1: 10, 2: 10} and sorted(r["place"] for r in got) == list(range(1, 31))
    assert [r["id"] for r in sorted(got, key=lambda r: r["place"])] == sorted((r["id"] for r in got), key=lambda k: drawn(6, k))


def test_absolute_changes_with_nulls(spark):
    old, new = (spark.createDataFrame([r], "a double, b double") for r in [(0.25, None), (0.75, 1.0)])
    assert [tuple(r) for r in audit.absolute_changes(old, new, ["a", "b"], ["a", "b"]).collect()] == [(0.5, None, True, None)]
    assert audit.absolute_changes(new, old, ["a"], ["a"]).collect()[0]["a_improved"] is False
