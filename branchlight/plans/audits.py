"""Evaluation statistics: funnels, paired arms, intervals, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit
from .registry import query
from .relations import ROLLOUTS, r6, rollouts, table

_RIGHT = "CAST(score >= CAST(0.8 AS DOUBLE) AS INT)"


@query("data_metrics", f"WITH {ROLLOUTS} SELECT round(min(score), 6) AS score_min, round(avg(score), 6) AS score_mean, round(max(score), 6) AS score_max, round(avg(tokens), 6) AS tokens_mean, max(tokens) AS tokens_max, count(*) AS n FROM rollouts")
def data_metrics(spark, sf_dir):
    return rollouts(spark, sf_dir).agg(r6(F.min("score"), "score_min"), r6(F.avg("score"), "score_mean"), r6(F.max("score"), "score_max"), r6(F.avg("tokens"), "tokens_mean"), F.max("tokens").alias("tokens_max"), F.count("*").alias("n"))


@query("explained_variance", "SELECT l_returnflag, round(1 - var_samp(l_extendedprice - l_quantity * 1000) / (var_samp(l_extendedprice) + 1e-5), 6) AS explained FROM lineitem GROUP BY l_returnflag")
def explained_variance(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", (F.col("l_quantity") * 1000).alias("guess"))
    return rows.groupBy("l_returnflag").agg(r6(audit.explained_variance("guess", "l_extendedprice"), "explained"))


@query("environment_stats", "SELECT o_orderpriority, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS finished, round(coalesce(sum(CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END) / nullif(count(*), 0), 0), 6) AS valid FROM orders GROUP BY ALL")
def environment_stats(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(r6(F.avg((F.col("o_orderstatus") == "F").cast("double")), "finished"), r6(F.coalesce(F.try_divide(F.count_if(F.col("o_totalprice") > 200000), F.count("*")), F.lit(0.0)), "valid"))


@query("timing_metrics", "SELECT event_type, round(sum(value) * 1000 / sum(length(props)), 6) AS ms_per_token, count(*) AS n FROM events GROUP BY event_type")
def timing_metrics(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(r6(F.sum("value") * 1000 / F.sum(F.length("props")), "ms_per_token"), F.count("*").alias("n"))


@query("rate_calibration", f"WITH {ROLLOUTS}, b AS (SELECT unnest(['root', 'pre_search', 'depth1', 'depth2', 'depth3plus']) AS bucket), r AS (SELECT CASE WHEN line = 1 THEN 'root' WHEN line = 2 THEN 'depth1' WHEN line = 3 THEN 'depth2' WHEN line < 0 THEN 'pre_search' ELSE 'depth3plus' END AS bucket, {_RIGHT} AS ok FROM rollouts), a AS (SELECT bucket, avg(ok) AS rate, count(*) AS n FROM r GROUP BY bucket) SELECT bucket, coalesce(n, 0) AS n, round(coalesce(rate, (SELECT avg(ok) FROM r)), 6) AS rate FROM b LEFT JOIN a USING (bucket)")
def rate_calibration(spark, sf_dir):
    """Effective rate of each bucket, the global rate where a bucket is empty."""
    line = F.col("line")
    bucket = F.when(line == 1, "root").when(line == 2, "depth1").when(line == 3, "depth2").when(line < 0, "pre_search").otherwise("depth3plus")
    rows = rollouts(spark, sf_dir).select(bucket.alias("bucket"), (F.col("score") >= 0.8).cast("double").alias("ok"))
    sums = rows.groupBy("bucket").agg(F.sum("ok").alias("k"), F.count("*").alias("n"))
    overall = sums.agg((F.sum("k") / F.sum("n")).alias("overall"))
    names = spark.range(1).select(F.explode(F.array(*map(F.lit, ("root", "pre_search", "depth1", "depth2", "depth3plus")))).alias("bucket"))
    got = names.join(sums, "bucket", "left").crossJoin(F.broadcast(overall))
    return got.select("bucket", F.coalesce("n", F.lit(0)).alias("n"), r6(F.coalesce(F.col("k") / F.col("n"), F.col("overall")), "rate"))


_WILSON = "round(CASE WHEN n > 0 THEN greatest(0, least(1, (k / n + 3.8416 / (2 * n) {s} 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n))) ELSE 0 END, 6)"


@query("rescue_rate", f"WITH {ROLLOUTS}, g AS (SELECT data_source, uid, max({_RIGHT}) AS rescued FROM rollouts GROUP BY ALL), s AS (SELECT coalesce(data_source, 'total') AS data_source, CAST(sum(rescued) AS BIGINT) AS k, count(*) AS n FROM g GROUP BY GROUPING SETS ((data_source), ())) SELECT data_source, k, n, {_WILSON.format(s='-')} AS low, {_WILSON.format(s='+')} AS high FROM s")
def rescue_rate(spark, sf_dir):
    """Share of groups with at least one right answer, by source and in total, with its Wilson interval."""
    g = rollouts(spark, sf_dir).groupBy("data_source", "uid").agg(F.bool_or(F.col("score") >= 0.8).alias("rescued"))
    s = g.rollup("data_source").agg(F.count_if("rescued").alias("k"), F.count("*").alias("n")).withColumn("data_source", F.coalesce("data_source", F.lit("total")))
    low, high = audit.wilson(F.col("k"), F.col("n"))
    return s.select("data_source", "k", "n", r6(low, "low"), r6(high, "high"))


@query("generation_funnel", "SELECT o_orderpriority AS source, count(*) AS attempted, count(*) FILTER (o_orderstatus <> 'P') AS effective, count(DISTINCT o_custkey) AS questions, count(DISTINCT CASE WHEN o_totalprice > 250000 THEN o_custkey END) AS eligible_questions, least(count(*) FILTER (o_totalprice > 250000), 100) AS accepted FROM orders GROUP BY 1")
def generation_funnel(spark, sf_dir):
    rich = F.col("o_totalprice") > 250000
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("source")).agg(F.count("*").alias("attempted"), F.count_if(F.col("o_orderstatus") != "P").alias("effective"), F.countDistinct("o_custkey").alias("questions"), F.countDistinct(F.when(rich, F.col("o_custkey"))).alias("eligible_questions"), F.least(F.count_if(rich), F.lit(100)).alias("accepted"))


@query("trajectory_metrics", "WITH r AS (SELECT user_id, event_type, value > 50 AS ok FROM events), q AS (SELECT user_id, bool_or(ok) AS any_ok FROM r GROUP BY 1) SELECT (SELECT count(*) FROM r) AS n, (SELECT count(*) FILTER (ok) FROM r) AS n_ok, (SELECT count(*) FROM q) AS questions, (SELECT count(*) FILTER (any_ok) FROM q) AS questions_ok")
def trajectory_metrics(spark, sf_dir):
    """Rates of trajectories and, one level up, of questions with any success."""
    q = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("k"))
    return q.agg(F.sum("n").alias("n"), F.sum("k").alias("n_ok"), F.count("*").alias("questions"), F.count_if(F.col("k") > 0).alias("questions_ok"))


@query("reason_histogram", "SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN l_discount > 0.08 THEN 'discount' END, CASE WHEN l_tax > 0.06 THEN 'tax' END, CASE WHEN l_quantity > 40 THEN 'quantity' END], lambda x: x IS NOT NULL)) AS reason FROM lineitem) GROUP BY reason")
def reason_histogram(spark, sf_dir):
    reasons = F.array(F.when(F.col("l_discount") > 0.08, "discount"), F.when(F.col("l_tax") > 0.06, "tax"), F.when(F.col("l_quantity") > 40, "quantity"))
    return table(spark, sf_dir, "lineitem").select(F.explode(F.array_compact(reasons)).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("numeric_totals", "SELECT k, round(sum(v), 4) AS total, count(*) AS n FROM (SELECT 'value' AS k, value AS v FROM events UNION ALL SELECT 'user_id', user_id FROM events UNION ALL SELECT 'hour', hour(ts) FROM events) GROUP BY k")
def numeric_totals(spark, sf_dir):
    """Sums per key of a map of numbers."""
    pairs = F.map_from_arrays(F.array(*map(F.lit, ("value", "user_id", "hour"))), F.array(F.col("value"), F.col("user_id").cast("double"), F.hour("ts").cast("double")))
    return table(spark, sf_dir, "events").select(F.explode(pairs).alias("k", "v")).groupBy("k").agg(F.round(F.sum("v"), 4).alias("total"), F.count("*").alias("n"))


@query("compression_stats", "SELECT count(*) AS n, count(*) FILTER (length(text) > 2000) AS compressed, CAST(sum(greatest(length(text) - 2000, 0)) AS BIGINT) AS removed, round(avg(greatest(length(text) - 2000, 0)), 4) AS mean_removed FROM documents")
def compression_stats(spark, sf_dir):
    cut = F.greatest(F.length("text") - 2000, F.lit(0))
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.count_if(cut > 0).alias("compressed"), F.sum(cut).alias("removed"), F.round(F.avg(cut), 4).alias("mean_removed"))


@query("role_counts", "SELECT role, count(*) AS n, min(length(text)) AS least, round(avg(length(text)), 4) AS mean, max(length(text)) AS most FROM conversations GROUP BY role")
def role_counts(spark, sf_dir):
    n = F.length("text").cast("long")
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.min(n).alias("least"), F.round(F.avg(n), 4).alias("mean"), F.max(n).alias("most"))


@query("paired_comparison", f"WITH {ROLLOUTS}, p AS (SELECT data_source, uid, max(CASE WHEN line % 2 = 0 THEN {_RIGHT} ELSE 0 END) AS a, max(CASE WHEN line % 2 = 1 THEN {_RIGHT} ELSE 0 END) AS b FROM rollouts GROUP BY ALL) SELECT coalesce(data_source, 'total') AS data_source, count(*) AS n, CAST(sum(a) AS BIGINT) AS baseline, CAST(sum(b) AS BIGINT) AS treated, count(*) FILTER (a = 0 AND b = 1) AS rescued, count(*) FILTER (a = 1 AND b = 0) AS harmed, round(avg(b - a), 6) + 0.0 AS lift FROM p GROUP BY GROUPING SETS ((data_source), ())")
def paired_comparison(spark, sf_dir):
    """Baseline against treated arm of each uid: rescued, harmed and mean lift."""
    ok = (F.col("score") >= 0.8).cast("int")
    p = rollouts(spark, sf_dir).groupBy("data_source", "uid").agg(F.max(F.when(F.col("line") % 2 == 0, ok).otherwise(0)).alias("a"), F.max(F.when(F.col("line") % 2 == 1, ok).otherwise(0)).alias("b"))
    got = p.rollup("data_source").agg(F.count("*").alias("n"), F.sum("a").alias("baseline"), F.sum("b").alias("treated"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("rescued"), F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("harmed"), r6(F.avg(F.col("b") - F.col("a")), "lift"))
    return got.withColumn("data_source", F.coalesce("data_source", F.lit("total")))


@query("stratified_lift", f"WITH {ROLLOUTS} SELECT data_source, CAST(line AS BIGINT) AS stratum, count(*) AS n, round(avg(score - 0.5), 6) + 0.0 AS lift FROM rollouts GROUP BY ALL")
def stratified_lift(spark, sf_dir):
    return rollouts(spark, sf_dir).groupBy("data_source", F.col("line").cast("long").alias("stratum")).agg(F.count("*").alias("n"), r6(F.avg(F.col("score") - 0.5), "lift"))


@query("gate_verdict", f"WITH {ROLLOUTS}, a AS (SELECT avg({_RIGHT}) AS em, avg(score) AS mean, count(DISTINCT uid) AS uids FROM rollouts) SELECT em > CAST(0.1 AS DOUBLE) AS em_ok, mean > CAST(0.4 AS DOUBLE) AS mean_ok, uids >= 100 AS enough, em > CAST(0.1 AS DOUBLE) AND mean > CAST(0.4 AS DOUBLE) AND uids >= 100 AS pass FROM a")
def gate_verdict(spark, sf_dir):
    a = rollouts(spark, sf_dir).agg(F.avg((F.col("score") >= 0.8).cast("double")).alias("em"), F.avg("score").alias("mean"), F.countDistinct("uid").alias("uids"))
    parts = {"em_ok": F.col("em") > 0.1, "mean_ok": F.col("mean") > 0.4, "enough": F.col("uids") >= 100}
    return a.select(*[c.alias(k) for k, c in parts.items()], (parts["em_ok"] & parts["mean_ok"] & parts["enough"]).alias("pass"))


@query("bootstrap_interval")
def bootstrap_interval(spark, sf_dir):
    return audit.bootstrap(rollouts(spark, sf_dir), "data_source", "score", samples=2000)


@query(
    "paired_interval",
    f"""WITH {ROLLOUTS}, p AS (SELECT data_source, uid, max(CASE WHEN line % 2 = 1 THEN {_RIGHT} ELSE 0 END) - max(CASE WHEN line % 2 = 0 THEN {_RIGHT} ELSE 0 END) AS delta, avg(score) AS s FROM rollouts GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY data_source ORDER BY substr(sha256('47:' || uid), 1, 13), uid) - 1 AS place, count(*) OVER (PARTITION BY data_source) AS n FROM p),
d AS (SELECT data_source, r, floor(CAST('0x' || substr(sha256('47:' || data_source || ':' || r || ':' || i), 1, 13) AS UBIGINT) / CAST(4503599627370496 AS DOUBLE) * n) AS place FROM (SELECT data_source, n, place AS i FROM o), range(40) AS t(r)),
m AS (SELECT data_source, r, avg(delta) AS m FROM d JOIN o USING (data_source, place) GROUP BY ALL),
b AS (SELECT data_source, quantile_cont(m, [0.025, 0.975]) AS q FROM m GROUP BY 1)
SELECT data_source, n, round(mean, 6) + 0.0 AS mean, round(q[1], 6) + 0.0 AS low, round(q[2], 6) + 0.0 AS high FROM b JOIN (SELECT data_source, count(*) AS n, avg(delta) AS mean FROM p GROUP BY 1) USING (data_source)""",
)
def paired_interval(spark, sf_dir):
    """Mean lift of the treated arm by source with its bootstrap interval, from draws that SQL repeats."""
    ok = (F.col("score") >= 0.8).cast("int")
    arm = lambda k: F.max(F.when(F.col("line") % 2 == k, ok).otherwise(0))
    p = rollouts(spark, sf_dir).groupBy("data_source", "uid").agg((arm(1) - arm(0)).alias("delta"))
    got = audit.bootstrap_by_index(p, "data_source", ["uid"], "delta", 40, 47)
    return got.select("data_source", "n", r6(F.col("mean"), "mean"), r6(F.col("low"), "low"), r6(F.col("high"), "high"))


@query("efficiency_totals", f"WITH {ROLLOUTS} SELECT data_source, count(*) AS n, round(sum(tokens), 2) AS tokens, round(sum(score) / nullif(sum(tokens), 0), 8) AS reward_per_token, round(sum(CASE WHEN line > 99 THEN score END) / nullif(sum(CASE WHEN line > 99 THEN tokens ELSE 0 END), 0), 6) AS empty_ratio FROM rollouts GROUP BY data_source")
def efficiency_totals(spark, sf_dir):
    late = F.when(F.col("line") > 99, F.col("tokens")).otherwise(0.0)
    return rollouts(spark, sf_dir).groupBy("data_source").agg(F.count("*").alias("n"), F.round(F.sum("tokens"), 2).alias("tokens"), F.round(F.try_divide(F.sum("score"), F.sum("tokens")), 8).alias("reward_per_token"), F.round(F.try_divide(F.sum(F.when(F.col("line") > 99, F.col("score"))), F.sum(late)), 6).alias("empty_ratio"))


@query("weighted_mean_loss", f"WITH {ROLLOUTS} SELECT data_source, round(sum(score * tokens) / greatest(sum(tokens), 1), 6) AS loss FROM rollouts GROUP BY data_source")
def weighted_mean_loss(spark, sf_dir):
    return rollouts(spark, sf_dir).groupBy("data_source").agg(r6(F.sum(F.col("score") * F.col("tokens")) / F.greatest(F.sum("tokens"), F.lit(1.0)), "loss"))


@query("score_retrieval", "WITH d AS (SELECT l_orderkey AS q, l_suppkey % 20 AS title, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rank FROM lineitem), h AS (SELECT q, min(CASE WHEN title = o_custkey % 20 OR title = o_orderkey % 20 THEN rank END) AS first, count(DISTINCT CASE WHEN title = o_custkey % 20 OR title = o_orderkey % 20 THEN title END) AS found, max(CASE WHEN o_custkey % 20 = o_orderkey % 20 THEN 1 ELSE 2 END) AS golds FROM d JOIN orders ON q = o_orderkey GROUP BY q) SELECT q, first IS NOT NULL AS hit, round(coalesce(1.0 / first, 0), 6) AS mrr, round(found / golds, 6) AS recall FROM h")
def score_retrieval(spark, sf_dir):
    """Hit, reciprocal rank and recall of gold titles in each result list."""
    lists = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("q")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("r"))
    rows = lists.select("q", F.transform("r.l_suppkey", lambda x: x % 20).alias("titles")).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q"), F.array_distinct(F.array(F.col("o_custkey") % 20, F.col("o_orderkey") % 20)).alias("gold")), "q")
    ranks = F.filter(F.transform("gold", lambda g: F.array_position("titles", g)), lambda p: p > 0)
    return rows.select("q", (F.size(ranks) > 0).alias("hit"), r6(F.coalesce(1.0 / F.array_min(ranks), F.lit(0.0)), "mrr"), r6(F.size(ranks) / F.size("gold"), "recall"))


@query("explode_arms", "SELECT arm, count(*) AS total, count(*) FILTER (q <> '') AS valid, count(*) FILTER (hit) AS hits FROM (SELECT 'old' AS arm, p_name AS q, p_size > 25 AS hit FROM part UNION ALL SELECT 'new', CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END, p_size > 20 FROM part) GROUP BY arm")
def explode_arms(spark, sf_dir):
    arm = lambda name, q, hit: F.struct(F.lit(name).alias("arm"), q.alias("q"), hit.alias("hit"))
    arms = F.array(arm("old", F.col("p_name"), F.col("p_size") > 25), arm("new", F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(""), F.col("p_size") > 20))
    return table(spark, sf_dir, "part").select(F.explode(arms).alias("a")).select("a.*").groupBy("arm").agg(F.count("*").alias("total"), F.count_if(F.col("q") != "").alias("valid"), F.count_if("hit").alias("hits"))


@query(
    "absolute_changes",
    f"""WITH {ROLLOUTS}, g AS (SELECT line % 2 AS arm, data_source, uid, max(score) - min(score) AS spread, max(score) AS best FROM rollouts GROUP BY ALL),
s AS (SELECT arm, avg(CAST(spread > 0 AND best >= CAST(0.8 AS DOUBLE) AS INT)) AS effective_parent_rate, avg(CAST(spread > 0 AS INT)) AS nonzero_sibling_edge_rate, avg(CAST(spread = 0 AS INT)) AS zero_variance_parent_rate FROM g GROUP BY arm)
SELECT round(n.effective_parent_rate - o.effective_parent_rate, 6) + 0.0 AS effective_parent_rate_absolute_change, round(n.nonzero_sibling_edge_rate - o.nonzero_sibling_edge_rate, 6) + 0.0 AS nonzero_sibling_edge_rate_absolute_change,
  round(n.zero_variance_parent_rate - o.zero_variance_parent_rate, 6) + 0.0 AS zero_variance_parent_rate_absolute_change, n.effective_parent_rate - o.effective_parent_rate > 0 AS effective_parent_rate_improved, n.nonzero_sibling_edge_rate - o.nonzero_sibling_edge_rate > 0 AS nonzero_sibling_edge_rate_improved
FROM s o, s n WHERE o.arm = 0 AND n.arm = 1""",
)
def absolute_changes(spark, sf_dir):
    """Groups of the lines with odd numbers against those with even ones: how often scores differ, and do so with one that is right."""
    names = ["effective_parent_rate", "nonzero_sibling_edge_rate", "zero_variance_parent_rate"]

    def summary(arm: int):
        g = rollouts(spark, sf_dir).filter(F.col("line") % 2 == arm).groupBy("data_source", "uid").agg((F.max("score") - F.min("score")).alias("spread"), F.max("score").alias("best"))
        kinds = [(F.col("spread") > 0) & (F.col("best") >= 0.8), F.col("spread") > 0, F.col("spread") == 0]
        return g.agg(*[F.avg(k.cast("int")).alias(m) for m, k in zip(names, kinds, strict=True)])

    got = audit.absolute_changes(summary(0), summary(1), names, names[:2])
    return got.select(*[r6(F.col(c), c) if c.endswith("change") else F.col(c) for c in got.columns])
