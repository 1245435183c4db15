"""Candidates, consumers and training rows at their gates. A line stands for a candidate, its order for the question."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import gates as G
from ..functions import leaks as L
from ..operators import curate as C
from .registry import query
from .relations import r6, table

_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_K = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def candidates(spark, sf_dir):
    part = F.col("l_partkey") % 4
    empty = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "lineitem").select(*_ID, "l_quantity")
    rows = rows.join(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("source")), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        *_ID,
        "source",
        "l_quantity",
        F.array_repeat(F.lit("t"), (F.col("l_linenumber") % 3).cast("int")).alias("turns"),
        F.when(F.col("l_partkey") % 5 == 0, "x").otherwise("").alias("trajectory"),
        F.when(F.col("l_suppkey") % 7 == 0, "a").alias("answer"),
        F.when(F.col("l_partkey") % 11 == 0, True).alias("flag"),
        F.when(F.col("l_partkey") % 13 == 0, 429).alias("stated"),
        F.when(part == 0, F.array(F.lit("deepseek_api_failed: DeepSeek HTTP 401"))).when(part == 1, F.array(F.lit("format"), F.lit("deepseek_api_failed : deepseek http 503"))).when(part == 2, F.array(F.lit("bad"))).otherwise(empty).alias("reasons"),
    )


_FLAGS = """c AS (SELECT *, l_linenumber % 3 > 0 OR l_partkey % 5 = 0 OR l_suppkey % 7 = 0 AS wrote, l_partkey % 11 = 0 OR l_partkey % 4 < 2 AS failed,
  CAST(CASE WHEN l_partkey % 13 = 0 THEN 429 WHEN l_partkey % 4 = 0 THEN 401 WHEN l_partkey % 4 = 1 THEN 503 END AS INT) AS status FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def annotated(spark, sf_dir):
    return candidates(spark, sf_dir).withColumns(G.annotations(*map(F.col, ("turns", "trajectory", "answer", "flag", "stated", "reasons"))))


@query(
    "candidate_flags",
    f"WITH {_FLAGS} SELECT {_K}, wrote AS actual_generation, failed AS api_failure, failed AND NOT wrote AS retryable_api_failure, status AS api_failure_status_code, NOT (failed AND NOT wrote) AS effective, CASE WHEN failed AND NOT wrote AND status BETWEEN 400 AND 404 THEN 'http_' || status END AS systemic_failure FROM c",
)
def candidate_flags(spark, sf_dir):
    return annotated(spark, sf_dir).select(*_ID, "actual_generation", "api_failure", "retryable_api_failure", "api_failure_status_code", "effective", "systemic_failure")


@query(
    "candidate_funnel",
    f"WITH {_FLAGS} SELECT o_orderpriority AS source, count(*) AS audit_rows, count(*) FILTER (NOT failed OR wrote) AS effective, count(*) FILTER (wrote) AS generated, count(*) FILTER (failed) AS failed, count(*) FILTER (l_quantity > 25 AND (NOT failed OR wrote)) AS eligible, count(DISTINCT CASE WHEN NOT failed OR wrote THEN l_orderkey END) AS questions, count(DISTINCT CASE WHEN l_quantity > 25 AND (NOT failed OR wrote) THEN l_orderkey END) AS questions_eligible FROM c GROUP BY 1",
)
def candidate_funnel(spark, sf_dir):
    """The funnel of each source over annotated candidates; a quantity above 25 makes one eligible."""
    good = F.col("effective") & (F.col("l_quantity") > 25)
    # Questions first, so that no source's questions meet in one task.
    asked = annotated(spark, sf_dir).groupBy("source", "l_orderkey").agg(
        F.count("*").alias("n"), F.count_if("effective").alias("e"), F.count_if("actual_generation").alias("g"), F.count_if("api_failure").alias("f"), F.count_if(good).alias("k")
    )
    total = lambda c, name: F.sum(c).cast("long").alias(name)
    return asked.groupBy("source").agg(total("n", "audit_rows"), total("e", "effective"), total("g", "generated"), total("f", "failed"), total("k", "eligible"), F.count_if(F.col("e") > 0).alias("questions"), F.count_if(F.col("k") > 0).alias("questions_eligible"))


@query("candidate_contract", "SELECT o_orderkey AS question, s AS sample, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' ELSE 'unexpected' END AS fault FROM (SELECT o_orderkey, unnest([1, 2]) AS s FROM orders) e FULL JOIN (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL) c ON o_orderkey = l_orderkey AND s = l_linenumber WHERE n IS NULL OR n > 1 OR o_orderkey IS NULL")
def candidate_contract(spark, sf_dir):
    """What breaks the contract of exactly two samples for each question."""
    expected = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question"), F.explode(F.array(F.lit(1), F.lit(2))).alias("sample"))
    have = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 2").groupBy(F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("s")).agg(F.count("*").alias("n"))
    met = expected.join(have, (F.col("question") == F.col("q")) & (F.col("sample") == F.col("s")), "full")
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("question").isNull(), "unexpected").when(F.col("n") > 1, "repeated")
    return met.withColumn("fault", fault).filter("fault is not null").select(F.coalesce("question", "q").alias("question"), F.coalesce("sample", "s").alias("sample"), "fault")


@query(
    "quota_batch",
    f"""WITH {_FLAGS}, used AS (SELECT o_orderpriority AS source, count(*) FILTER (NOT failed OR wrote) AS n FROM c GROUP BY 1),
p AS (SELECT o_orderpriority AS source, o_orderkey AS question, s AS sample FROM (SELECT *, unnest([8, 9]) AS s FROM orders)),
q AS (SELECT p.*, row_number() OVER (PARTITION BY p.source ORDER BY question, sample) AS place, dense_rank() OVER (PARTITION BY p.source ORDER BY question) AS asked, (SELECT max(n) FROM used) + 15 - used.n AS room FROM p JOIN used USING (source))
SELECT source, question, sample FROM q WHERE place <= room AND asked <= 10""",
)
def quota_batch(spark, sf_dir):
    """The next specifications of each source: within what its budget leaves after its effective candidates, and from ten questions at most."""
    flagged = annotated(spark, sf_dir)
    used = flagged.groupBy("source").agg(F.count_if("effective").alias("n"))
    most = used.agg((F.max("n") + 15).alias("budget"))  # one row
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), F.col("o_orderkey").alias("question"))
    # No more than the first ten questions of a source can be taken, so the rest never meets in a task.
    first = C.ranked(orders, ["source"], ["question"], "asked").filter("asked <= 10")
    specs = first.select("source", "question", F.explode(F.array(F.lit(8), F.lit(9))).alias("sample"))
    room = used.crossJoin(F.broadcast(most)).select("source", (F.col("budget") - F.col("n")).alias("room"))
    return C.ranked(specs, ["source"], ["question", "sample"], "place").join(F.broadcast(room), "source").filter("place <= room").select("source", "question", "sample")


def _responses(spark, sf_dir):
    kind = F.col("p_partkey") % 5
    think = F.concat(F.lit("<think>"), "p_name", F.lit("</think>"))
    search = F.concat(F.lit("<search>"), "p_brand", F.lit("</search>"))
    text = F.when(kind == 0, F.concat(think, F.lit("\n"), search)).when(kind == 1, F.concat(think, search)).when(kind == 2, F.concat(think, F.lit("\n"), search, F.lit("!"))).when(kind == 3, F.concat(F.lit("<think>[Redacted]</think>\n"), search)).otherwise(F.concat(think, F.lit("\n<search>a<b</search>")))
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", ((F.col("p_partkey") % 40) / 100).alias("gap"), text.alias("response"), F.when(F.col("p_partkey") % 3 > 0, F.struct(F.lit("x").alias("s"))).alias("skill"))


@query("consumer_gate", "SELECT p_partkey, (p_partkey % 40) / 100 >= 0.1 AND p_partkey % 5 = 0 AND p_partkey % 3 > 0 AS eligible, (p_partkey % 40) / 100 >= 0.25 AND p_partkey % 5 = 0 AS strict FROM part")
def consumer_gate(spark, sf_dir):
    rows = _responses(spark, sf_dir)
    return rows.select("p_partkey", G.valid_consumer(F.col("gap"), F.col("response"), F.col("skill")).alias("eligible"), G.strict_consumer(F.col("gap"), F.col("response")).alias("strict"))


@query("input_gate", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'not_accepted' WHEN p_size % 5 = 0 THEN 'has_rejection_reasons' WHEN p_size % 3 = 0 THEN 'invalid_response_schema' END AS fault FROM part")
def input_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    G.require_columns(rows.columns)
    reasons = F.when(F.col("p_size") % 5 == 0, F.array(F.lit("r"))).otherwise(F.array().cast("array<string>"))
    response = F.when(F.col("p_size") % 3 == 0, '{"episode_skill": 1}').otherwise(F.to_json(F.struct(F.col("p_name").alias("episode_summary"), F.col("p_type").alias("episode_skill"))))
    return rows.select("p_partkey", G.accepted_input(F.col("p_size") % 4 != 0, reasons, response).alias("fault"))


@query("task_rows", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN CASE WHEN p_partkey % 5 = 3 THEN 'redacted_target' WHEN p_partkey % 5 > 0 THEN 'invalid_action' END WHEN 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 'invalid_response' END WHEN 2 THEN CASE WHEN p_partkey % 3 = 0 THEN 'empty_field' WHEN p_partkey % 3 = 1 THEN 'redacted_target' END ELSE 'unknown_task_type' END AS fault FROM part")
def task_rows(spark, sf_dir):
    """Training rows of four task types, some of which do not fit."""
    kind = F.col("p_size") % 4
    analysis = F.when(F.col("p_partkey") % 2 == 0, '{"episode_summary": "a"}').otherwise('{"episode_summary": "a", "episode_skill": "b"}')
    field = F.when(F.col("p_partkey") % 3 == 0, " ").when(F.col("p_partkey") % 3 == 1, "a [REDACTED] b").otherwise("fine")
    skill = F.to_json(F.struct(F.lit("a").alias("failure_type"), field.alias("missing_relation"), F.lit("b").alias("next_operation"), F.lit("c").alias("stop_condition")))
    rows = _responses(spark, sf_dir)
    task = F.when(kind == 0, "action_replay").when(kind == 2, "node_skill_generation").when(kind == 3, "other")
    return rows.select("p_partkey", G.task_row(task, F.when(kind == 0, F.col("response")).when(kind == 1, analysis).otherwise(skill)).alias("fault"))


@query("plain_replay", "SELECT p_partkey, 'State ' || p_name || chr(10) || 'Choose the next action from the current visible state. Return exactly <think>...</think><search>...</search>; do not state a final answer.' || chr(10) || 'End' AS prompt FROM part")
def plain_replay(spark, sf_dir):
    prompt = F.concat(F.lit("State "), "p_name", F.lit("\n<analyzer_skill>\n"), "p_type", F.lit("\nmore\n</analyzer_skill>\nUse this answer-free procedural skill for "), "p_brand", F.lit(";\ndo not state a final answer.\nEnd"))
    return table(spark, sf_dir, "part").select("p_partkey", G.plain_replay(prompt).alias("prompt"))


@query("answer_agnostic", r"SELECT p_partkey, NOT regexp_matches(p_name || ' ' || p_brand || CASE WHEN p_partkey % 3 = 0 THEN ' 1999' ELSE '' END, '\b[0-9]{1,4}\b') AS agnostic FROM part")
def answer_agnostic(spark, sf_dir):
    text = F.concat("p_name", F.lit(" "), "p_brand", F.when(F.col("p_partkey") % 3 == 0, " 1999").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", G.answer_agnostic(text).alias("agnostic"))


@query("outcome_buckets", "SELECT CASE WHEN p_partkey % 9 = 0 THEN 'root' WHEN p_partkey % 2 = 0 THEN 'pre_search' WHEN p_size <= 1 THEN 'after_search_depth1' WHEN p_size = 2 THEN 'after_search_depth2' ELSE 'after_search_depth3plus' END AS bucket, count(*) AS n FROM part GROUP BY 1")
def outcome_buckets(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(G.outcome_bucket(F.col("p_partkey") % 9 == 0, F.col("p_partkey") % 2 == 1, F.col("p_size")).alias("bucket")).agg(F.count("*").alias("n"))


@query("forced_handoff", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_size % 3 > 0 THEN 'Look at ' || p_name || ' Before giving any answer, your next action must be exactly one search that verifies the remaining relation. Use this query: ' || p_type || '.' ELSE 'Look at ' || p_name END AS handoff FROM part")
def forced_handoff(spark, sf_dir):
    action = lambda ok, q: F.struct(ok.alias("valid"), q.alias("query"))
    two = F.array(action(F.lit(True), F.lit("first")), action(F.col("p_partkey") % 2 == 0, F.col("p_type")))
    actions = F.when(F.col("p_size") % 3 == 0, F.slice(two, 1, 1)).otherwise(two)
    return table(spark, sf_dir, "part").select("p_partkey", G.forced_handoff(F.concat(F.lit("Look at "), "p_name"), actions).alias("handoff"))


@query("answer_aliases", "SELECT p_partkey, array_to_string(list_filter([p_brand, p_type, trim(p_name)], lambda x: x <> ''), '|') AS aliases FROM part")
def answer_aliases(spark, sf_dir):
    got = L.aliases(F.array(F.concat(F.lit(" "), "p_brand"), F.lit("")), F.array("p_type", "p_brand"), F.array("p_name"), F.lit(None).cast("array<string>"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(got, "|").alias("aliases"))


@query("answer_leaks", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN false WHEN 1 THEN p_size % 2 = 0 WHEN 2 THEN true ELSE p_size % 2 = 0 END AS leaks FROM part")
def answer_leaks(spark, sf_dir):
    """Four texts: silent, naming the brand, claiming it, naming it in other case; the brand is visible for odd sizes."""
    kind = F.col("p_partkey") % 4
    text = F.when(kind == 0, "nothing is told").when(kind == 1, F.concat(F.lit("look at "), "p_brand", F.lit("!"))).when(kind == 2, F.concat(F.lit("So the final answer is: "), "p_brand")).otherwise(F.concat(F.lit("go "), F.upper("p_brand")))
    visible = F.when(F.col("p_size") % 2 == 1, F.concat(F.lit("Is it "), "p_brand", F.lit("?"))).otherwise("Which is it?")
    return table(spark, sf_dir, "part").select("p_partkey", L.leaks_answer(text, F.col("p_brand"), visible).alias("leaks"))


@query("query_faults", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'length' WHEN p_partkey % 5 = 1 THEN 'instruction_or_tag' WHEN p_partkey % 5 = 2 AND p_size % 2 = 0 THEN 'privileged_answer' ELSE '' END AS fault FROM part")
def query_faults(spark, sf_dir):
    kind = F.col("p_partkey") % 5
    asked = F.when(kind == 0, "two words").when(kind == 1, "look up the brand now").when(kind == 2, F.concat(F.lit("who makes the "), "p_brand")).otherwise("which brand makes this part")
    question = F.when(F.col("p_size") % 2 == 1, F.concat(F.lit("Is it "), F.lower("p_brand"))).otherwise("Which brand?")
    return table(spark, sf_dir, "part").select("p_partkey", L.query_fault(asked, question, F.array("p_brand")).alias("fault"))


@query("safe_handoffs", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE substr(p_name || ' ' || p_type, 1, 20) END AS handoff FROM part")
def safe_handoffs(spark, sf_dir):
    text = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.concat("p_brand", F.lit("\n"))).otherwise(" "), "p_name", F.lit("  "), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", L.safe_handoff(text, F.lit("which?"), F.array("p_brand"), 20).alias("handoff"))


@query("answer_hits", "SELECT l_orderkey, bool_or(p_partkey % 10 = o_custkey % 10 AND length(p_brand) > 2) AS hit FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def answer_hits(spark, sf_dir):
    """Whether any document of an order holds the key of its customer."""
    name = lambda c: F.concat(F.lit("Key"), (c % 10).cast("string"), F.lit(";"))
    docs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit("doc of "), name(F.col("l_partkey")))).alias("docs"))
    met = docs.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return met.select("l_orderkey", L.answer_hit(F.col("docs"), F.array(F.upper(name(F.col("o_custkey"))), F.lit("do"))).alias("hit"))


@query("gold_fields", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand || '|' || p_type WHEN 1 THEN p_name ELSE '' END AS titles, CASE WHEN p_partkey % 3 = 1 THEN 'q1|q2' ELSE '' END AS questions FROM part")
def gold_fields(spark, sf_dir):
    source = F.element_at(F.array(F.lit("hotpotqa"), F.lit("musique"), F.lit("nq")), (F.col("p_partkey") % 3 + 1).cast("int"))
    hop = lambda t, q: F.struct(t.alias("title"), F.lit(q).alias("question"))
    hops = F.array(hop(F.col("p_name"), "q1"), hop(F.lit(""), "q2"), hop(F.col("p_name"), ""))
    titles = F.array("p_brand", "p_type", "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(L.gold_titles(source, titles, hops), "|").alias("titles"), F.array_join(L.gold_questions(source, hops), "|").alias("questions"))


@query(
    "best_candidate",
    "WITH w AS (SELECT item_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')), lambda t: t NOT IN ('what', 'which', 'where', 'when', 'with', 'from', 'that', 'this', 'were', 'their')) AS t FROM benchmark), b AS (SELECT item_id // 4 AS question, item_id, t FROM w), q AS (SELECT question, min_by(t, item_id) AS t FROM b GROUP BY 1) SELECT question, min_by(b.item_id, struct_pack(r := -len(list_intersect(q.t, b.t)), i := b.item_id)) AS best, max(len(list_intersect(q.t, b.t)))::INT AS relevance FROM b JOIN q USING (question) WHERE b.item_id % 4 > 0 GROUP BY 1",
)
def best_candidate(spark, sf_dir):
    """Of the items that follow each fourth, the one with most of its words; the first of equals."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text", F.floor(F.col("item_id") / 4).alias("question"))
    asked = items.filter("item_id % 4 = 0").select("question", F.col("text").alias("asked"))
    scored = items.filter("item_id % 4 > 0").join(asked, "question").withColumn("r", L.relevance(F.col("asked"), F.array("text")))
    best = scored.groupBy("question").agg(F.min(F.struct((-F.col("r")).alias("r"), "item_id")).alias("b"))
    return best.select("question", F.col("b.item_id").alias("best"), (-F.col("b.r")).alias("relevance"))


@query(
    "skill_faults",
    "SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 3 = 0 THEN 'answer_leak' END, CASE WHEN p_partkey % 4 = 0 THEN 'empty' END, CASE WHEN p_size % 2 = 0 THEN 'length' END, CASE WHEN p_size % 3 = 0 THEN 'privileged_meta' END, CASE WHEN p_size % 5 = 0 THEN 'redaction_artifact' END], lambda x: x IS NOT NULL), ',') AS faults FROM part",
)
def skill_faults(spark, sf_dir):
    when = lambda c, x: F.when(c, F.lit(x)).otherwise("")
    long = F.when(F.col("p_size") % 2 == 0, "short one").otherwise("look for the relation that is missing and then compare both of the sides in turn")
    first = F.concat(long, when(F.col("p_size") % 3 == 0, " get reward"), when(F.col("p_size") % 5 == 0, " [REDACTED]"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" zz"), F.col("p_partkey").cast("string"), F.lit("zz"))).otherwise(""))
    fields = {"a": first, "b": F.when(F.col("p_partkey") % 4 == 0, " ").otherwise("stop")}
    answers = F.array(F.concat(F.lit("ZZ"), F.col("p_partkey").cast("string"), F.lit("zz")))
    got = L.skill_faults(fields, answers, F.lit("some other query here"), F.lit("two words"), F.array(F.lit("Title Of It")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(got, ",").alias("faults"))
