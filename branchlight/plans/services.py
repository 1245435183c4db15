"""Resuming, caching, manifests and the reports that go with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import forms as P
from ..operators import curate as C
from ..operators import retrieval as R
from ..sources import io
from .registry import query
from .relations import r6, table


@query("resume_pending", "WITH l AS (SELECT l_orderkey, max_by(l_returnflag, struct_pack(a := l_linenumber, b := l_partkey, c := l_suppkey, d := l_extendedprice)) AS last FROM lineitem GROUP BY 1) SELECT o_orderkey FROM orders LEFT JOIN l ON l_orderkey = o_orderkey WHERE last IS NULL OR last = 'R'")
def resume_pending(spark, sf_dir):
    """What is left to do: orders without an attempt, or whose latest attempt may be tried again (flag R)."""
    latest = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_returnflag", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("last"))
    done = latest.filter("last <> 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("cached_answers", "SELECT p_partkey, CASE WHEN p_brand < 'Brand#3' THEN 'cached ' || p_brand ELSE 'fetched ' || p_brand END AS value FROM part")
def cached_answers(spark, sf_dir):
    """Answers from a cache; distinct keys that it lacks are fetched once."""
    asked = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("key"))
    cache = asked.select("key").distinct().filter("key < 'Brand#3'").withColumn("value", F.concat(F.lit("cached "), "key"))

    def fetch(missing):
        def ask(frames):
            for f in frames:
                yield f.assign(value="fetched " + f["key"])

        return missing.mapInPandas(ask, "key string, value string")

    return R.cached(asked, cache, fetch)[0].select("p_partkey", "value")


@query("prefixed_texts", "SELECT item_id, 'query: ' || text AS e5_query, 'passage: ' || text AS e5_passage, 'Represent this sentence for searching relevant passages: ' || text AS bge_query, text AS bge_passage FROM benchmark")
def prefixed_texts(spark, sf_dir):
    forms = {f"{kind}_{'query' if q else 'passage'}": R.prefixed(F.col("text"), kind, q) for kind in ("e5", "bge") for q in (True, False)}
    return table(spark, sf_dir, "benchmark").select("item_id", *[c.alias(n) for n, c in forms.items()])


@query("retrieval_by_method", "SELECT count(*) AS n, count(DISTINCT query_id) AS queries, max(rank) AS ranks FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0)) WHERE rank <= 3")
def retrieval_by_method(spark, sf_dir):
    docs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    got = R.retriever("dense")(docs.filter("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"), docs, 3)
    return got.agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("queries"), F.max("rank").alias("ranks"))


@query("row_manifest", "SELECT doc_id, sha256(text) AS text_sha256, sha256(lang) AS lang_sha256, sha256(doc_id || ':' || coalesce(sha256(text), '') || ':' || coalesce(sha256(lang), '')) AS row_sha256 FROM documents")
def row_manifest(spark, sf_dir):
    return io.manifest(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id", ["text", "lang"])


@query("canonical_json", """SELECT p_partkey, '[{"content":"' || p_name || '","role":"user"},{"content":"' || p_brand || '","role":"assistant"}]' AS messages FROM part""")
def canonical_json(spark, sf_dir):
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return table(spark, sf_dir, "part").select("p_partkey", io.canonical_messages(F.array(turn("user", "p_name"), turn("assistant", "p_brand"))).alias("messages"))


@query("qa_targets", "SELECT p_partkey, 'Answer the question. Question: ' || CASE WHEN p_partkey % 2 = 0 THEN p_name || '?' ELSE 'who?' END AS content, 'rule' AS style, p_brand || '|' || p_type AS target, 'test' AS split, 'part:' || p_partkey AS idx, p_partkey AS raw_index FROM part")
def qa_targets(spark, sf_dir):
    """Questions in the nested training form: template, targets and index, as text and as a bare number."""
    asked = F.trim(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), "p_name")).otherwise("who? "))
    asked = F.when(F.endswith(asked, F.lit("?")), asked).otherwise(F.concat(asked, F.lit("?")))
    row = F.struct(
        F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("Answer the question. Question: "), asked).alias("content"))).alias("prompt"),
        F.struct(F.lit("rule").alias("style"), F.struct(F.array("p_brand", "p_type").alias("target")).alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit("test").alias("split"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("index")).alias("extra_info"),
    )
    got = table(spark, sf_dir, "part").select("p_partkey", row.alias("r"))
    return got.select("p_partkey", F.col("r.prompt")[0]["content"].alias("content"), "r.reward_model.style", F.array_join("r.reward_model.ground_truth.target", "|").alias("target"), "r.extra_info.split", F.col("r.extra_info.index").alias("idx"), F.col("p_partkey").alias("raw_index"))


@query("usage_totals", "SELECT o_orderpriority AS source, count(DISTINCT o_orderkey) AS trajectories, count(*) AS turns, sum(l_quantity)::DOUBLE AS prompt_tokens, sum(l_linenumber)::BIGINT AS completion_tokens, round(avg(l_tax), 6) AS mean_latency, round(max(l_tax), 6) AS worst_latency FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def usage_totals(spark, sf_dir):
    """Tokens and latency over the turns of trajectories, nested and exploded again."""
    turns = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_quantity").alias("prompt"), F.col("l_linenumber").alias("completion"), F.col("l_tax").alias("latency"))).alias("turns"))
    rows = turns.join(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("source")), F.col("l_orderkey") == F.col("o_orderkey"))
    got = rows.groupBy("source").agg(F.count("*").alias("trajectories"))
    each = rows.select("source", F.explode("turns").alias("t")).groupBy("source").agg(F.count("*").alias("turns"), F.sum("t.prompt").cast("double").alias("prompt_tokens"), F.sum("t.completion").cast("long").alias("completion_tokens"), F.round(F.avg("t.latency"), 6).alias("mean_latency"), F.round(F.max("t.latency"), 6).alias("worst_latency"))
    return got.join(each, "source")


_PAIRED = "WITH a AS (SELECT o_custkey AS uid, bool_or(o_totalprice > 300000) AS hit, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS answered FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS uid, bool_or(o_totalprice > 250000) AS hit, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS answered FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)"


@query("paired_report", f"{_PAIRED} SELECT count(*) AS paired, count(*) FILTER (a.hit) AS baseline, count(*) FILTER (b.hit) AS treated, count(*) FILTER (b.hit AND NOT a.hit) AS rescued, count(*) FILTER (a.hit AND NOT b.hit) AS harmed, round(avg(a.answered / a.n), 6) AS answered_baseline, round(avg(b.answered / b.n), 6) AS answered_treated FROM a JOIN b USING (uid)")
def paired_report(spark, sf_dir):
    """Two arms over the uids that are in both: any success, what one rescues and harms, share answered."""
    orders = table(spark, sf_dir, "orders")

    def arm(rest, least, name):
        return orders.filter(F.col("o_orderkey") % 2 == rest).groupBy(F.col("o_custkey").alias("uid")).agg(F.bool_or(F.col("o_totalprice") > least).alias(f"hit_{name}"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias(f"answered_{name}"))

    a, b = F.col("hit_baseline"), F.col("hit_treated")
    both = arm(0, 300000, "baseline").join(arm(1, 250000, "treated"), "uid")
    return both.agg(F.count("*").alias("paired"), F.count_if(a).alias("baseline"), F.count_if(b).alias("treated"), F.count_if(b & ~a).alias("rescued"), F.count_if(a & ~b).alias("harmed"), r6(F.avg("answered_baseline"), "answered_baseline"), r6(F.avg("answered_treated"), "answered_treated"))


@query("skill_gate", f"{_PAIRED}, d AS (SELECT count(*) AS n, avg(CAST(b.hit AS INT) - CAST(a.hit AS INT)) AS lift, stddev_samp(CAST(b.hit AS INT) - CAST(a.hit AS INT)) AS s FROM a JOIN b USING (uid)) SELECT round(lift, 6) AS lift, round(lift - 1.96 * s / sqrt(n), 6) AS low, lift >= 0.05 AND lift - 1.96 * s / sqrt(n) >= 0 AS passed FROM d")
def skill_gate(spark, sf_dir):
    """Whether the treated arm lies high enough above the baseline, and surely so."""
    orders = table(spark, sf_dir, "orders")
    arm = lambda rest, least, n: orders.filter(F.col("o_orderkey") % 2 == rest).groupBy("o_custkey").agg(F.bool_or(F.col("o_totalprice") > least).cast("int").alias(n))
    d = arm(0, 300000, "a").join(arm(1, 250000, "b"), "o_custkey").select((F.col("b") - F.col("a")).alias("d"))
    got = d.agg(F.avg("d").alias("lift"), (F.avg("d") - 1.96 * F.stddev_samp("d") / F.sqrt(F.count("*"))).alias("low"))
    return got.select(r6(F.col("lift"), "lift"), r6(F.col("low"), "low"), ((F.col("lift") >= 0.05) & (F.col("low") >= 0)).alias("passed"))


@query("acceptance_summary", "WITH r AS (SELECT o_orderpriority AS source, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN ['length', 'leak'] WHEN o_orderkey % 5 = 0 THEN ['leak'] ELSE [] END AS reasons FROM orders) SELECT source, reason, count(*) AS n, round(count(*) / any_value(total), 6) AS rate, any_value(accepted) AS accepted FROM (SELECT source, unnest(reasons) AS reason, count(*) OVER (PARTITION BY source) AS x, total, accepted FROM r JOIN (SELECT source, count(*) AS total, count(*) FILTER (len(reasons) = 0) AS accepted FROM r GROUP BY 1) USING (source)) GROUP BY ALL")
def acceptance_summary(spark, sf_dir):
    """Reasons of rejection by source with their rates, and how many rows have none."""
    none = F.array().cast("array<string>")
    reasons = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("length"), F.lit("leak"))).when(F.col("o_orderkey") % 5 == 0, F.array(F.lit("leak"))).otherwise(none)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), reasons.alias("reasons"))
    total = rows.groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.size("reasons") == 0).alias("accepted"))
    each = rows.select("source", F.explode("reasons").alias("reason")).groupBy("source", "reason").agg(F.count("*").alias("n"))
    return each.join(total, "source").select("source", "reason", "n", r6(F.col("n") / F.col("total"), "rate"), "accepted")


@query("compression_report", "WITH k AS (SELECT lang, length(text) AS n, CASE WHEN length(text) > 400 THEN 400 ELSE length(text) END AS kept, length(text) > 400 AS cut FROM documents) SELECT lang, count(*) AS rows, count(*) FILTER (cut) AS compressed, sum(n - kept)::BIGINT AS removed, round(avg(CASE WHEN cut THEN 1.0 ELSE 0.0 END), 6) AS share FROM k GROUP BY 1")
def compression_report(spark, sf_dir):
    """Texts cut to four hundred characters around a marker, and what that removed."""
    marker = "[... cut ...]"
    rows = table(spark, sf_dir, "documents").select("lang", "text", P.kept_ends(F.col("text"), F.lit(400), marker).alias("kept"))
    cut = F.col("kept") != F.col("text")
    gone = F.when(cut, F.length("text") - (F.length("kept") - len(marker) - 2)).otherwise(0)
    return rows.groupBy("lang").agg(F.count("*").alias("rows"), F.count_if(cut).alias("compressed"), F.sum(gone).cast("long").alias("removed"), r6(F.avg(cut.cast("double")), "share"))


@query("best_skill", "SELECT l_orderkey, max_by(l_suppkey, struct_pack(s := l_quantity, i := l_suppkey)) AS skill FROM lineitem GROUP BY 1")
def best_skill(spark, sf_dir):
    """The skill of each tree with the largest score, and of those the largest id."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_suppkey", F.struct("l_quantity", "l_suppkey")).alias("skill"))


@query(
    "hop_trace",
    "WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), g AS (SELECT user_id, list(event_type ORDER BY i) AS seen FROM e GROUP BY 1) SELECT user_id, len(seen) AS steps, array_to_string([CASE WHEN list_contains(['click', 'view'], seen[k]) AND NOT list_contains(seen[1 : k - 1], seen[k]) THEN '1' ELSE '0' END for k in range(1, len(seen) + 1)], '') AS hits FROM g",
)
def hop_trace(spark, sf_dir):
    """Step by step, whether an event brings a gold type that is still open: gold less what the steps before brought."""
    got = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("e")).select("user_id", F.col("e.event_type").alias("seen"))
    start = F.struct(F.array(F.lit("click"), F.lit("view")).alias("open"), F.lit("").alias("hits"))
    step = lambda s, x: F.struct(F.array_remove(s["open"], x).alias("open"), F.concat(s["hits"], F.array_contains(s["open"], x).cast("int").cast("string")).alias("hits"))
    return got.select("user_id", F.size("seen").cast("long").alias("steps"), F.aggregate("seen", start, step, lambda s: s["hits"]).alias("hits"))
