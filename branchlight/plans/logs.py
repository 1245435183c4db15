"""Metric logs and event replay, in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import metrics, replay
from .registry import query
from .relations import table


@query("metric_log_parse", "WITH p AS (SELECT event_id AS step, 'loss/' || event_type AS key, round(value, 3) AS value FROM events) SELECT key, step, value, round(value - lag(value) OVER (PARTITION BY key ORDER BY step), 3) + 0.0 AS change FROM p")
def metric_log_parse(spark, sf_dir):
    """Events written as coloured log lines, parsed again, with the change per key."""
    e = table(spark, sf_dir, "events")
    line = metrics.encode(F.col("event_id"), F.create_map(F.concat(F.lit("loss/"), "event_type"), F.round("value", 3)))
    lines = e.select(F.concat(F.lit("\x1b[32m"), line, F.lit("\x1b[0m - bad:nan - note")).alias("value"))
    got = metrics.with_change(metrics.parse(lines))
    return got.select("key", "step", "value", (F.round("change", 3) + F.lit(0.0)).alias("change"))


@query("metric_mean", "SELECT event_type, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY event_type")
def metric_mean(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


@query(
    "event_replay",
    """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS c, event_id % 2 = 0 AS call, event_id // 2 AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
w AS (
  SELECT c, i, CASE WHEN call THEN [id] ELSE [] END AS open, 0 AS matched, 0 AS sole, CASE WHEN call THEN 0 ELSE 1 END AS orphans FROM e WHERE i = 1
  UNION ALL
  SELECT e.c, e.i, CASE WHEN call THEN list_append(list_filter(open, lambda x: x <> id), id) WHEN list_contains(open, id) THEN list_filter(open, lambda x: x <> id) WHEN len(open) = 1 THEN [] ELSE open END,
    matched + CASE WHEN NOT call AND list_contains(open, id) THEN 1 ELSE 0 END, sole + CASE WHEN NOT call AND NOT list_contains(open, id) AND len(open) = 1 THEN 1 ELSE 0 END, orphans + CASE WHEN NOT call AND NOT list_contains(open, id) AND len(open) <> 1 THEN 1 ELSE 0 END
  FROM w JOIN e ON e.c = w.c AND e.i = w.i + 1)
SELECT c AS candidate_id, matched::BIGINT AS matched, sole::BIGINT AS sole, orphans::BIGINT AS orphans, len(open) AS pending FROM w WHERE i = (SELECT max(i) FROM e WHERE e.c = w.c)""",
)
def event_replay(spark, sf_dir):
    """Events of each user as calls and observations, replayed in order."""
    e = table(spark, sf_dir, "events")
    log = e.select(F.col("user_id").cast("string").alias("candidate_id"), F.struct("ts", "event_id").alias("o"), F.when(F.col("event_id") % 2 == 0, "api_response").otherwise("retrieval_observation").alias("event_type"), F.lit(0).alias("turn_index"), (F.col("event_id") / 2).cast("long").cast("string").alias("tool_call_id"))
    return replay.replay(log.select("candidate_id", F.col("o.event_id").alias("row_idx"), "event_type", "turn_index", "tool_call_id"))


@query("stop_when_enough", "WITH c AS (SELECT o_orderdate::DATE AS day, count(*) FILTER (o_totalprice > 200000) AS n FROM orders GROUP BY 1), r AS (SELECT day, n, sum(n) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c) SELECT CAST(day AS VARCHAR) AS day, n FROM r WHERE coalesce(before, 0) < 200")
def stop_when_enough(spark, sf_dir):
    """Chunks (days) in order until enough effective groups are in."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count_if(F.col("o_totalprice") > 200000).alias("n"))
    # As many rows as there are chunks, which come to one driver in order anyway.
    before = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    return c.withColumn("before", F.coalesce(before, F.lit(0))).filter("before < 200").select(F.col("day").cast("string").alias("day"), "n")
