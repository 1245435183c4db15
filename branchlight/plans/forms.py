"""Trajectories in parts, as messages, and what is read out of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import forms as P
from .registry import query
from .relations import r6, table
from .texts import _ID, SEQUENCES, sequences

_K = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_FAULT = "CASE form WHEN 0 THEN NULL WHEN 1 THEN 'number_of_searches' ELSE 'malformed' END"


@query("trajectory_parts", f"WITH {SEQUENCES} SELECT {_K}, {_FAULT} AS fault, CASE WHEN form = 0 THEN 1 END AS n_rounds, CASE WHEN form = 0 THEN q END AS query, CASE WHEN form = 0 THEN doc END AS information, CASE WHEN form = 0 THEN 'two' END AS final_think, CASE WHEN form = 0 THEN said END AS answer FROM rolled")
def trajectory_parts(spark, sf_dir):
    rows = sequences(spark, sf_dir).withColumn("p", P.parts(F.col("response")))
    return rows.select(*_ID, "p.fault", F.when(F.col("p.fault").isNull(), F.size("p.rounds")).alias("n_rounds"), F.col("p.rounds")[0]["query"].alias("query"), F.col("p.rounds")[0]["information"].alias("information"), "p.final_think", "p.answer")


@query("message_round_trip", f"WITH {SEQUENCES} SELECT {_K}, 4 AS n, 'user,assistant,user,assistant' AS roles, response AS back FROM rolled WHERE form = 0")
def message_round_trip(spark, sf_dir):
    """Sound trajectories as chat messages, and these as trajectories again."""
    rows = sequences(spark, sf_dir).withColumn("p", P.parts(F.col("response"))).filter("p.fault is null")
    rows = rows.withColumn("m", P.messages(F.concat(F.lit("Question: "), "gold"), F.col("p")))
    return rows.select(*_ID, F.size("m").alias("n"), F.array_join("m.role", ",").alias("roles"), P.trajectory(F.col("m")).alias("back"))


@query("information_only", f"WITH {SEQUENCES} SELECT {_K}, l_suppkey % 3 > 0 AS sound FROM rolled WHERE form = 0")
def information_only(spark, sf_dir):
    """Whether an edit of the messages touched nothing but information; every third edit also touches the answer."""
    rows = sequences(spark, sf_dir).withColumn("p", P.parts(F.col("response"))).filter("p.fault is null")
    rows = rows.withColumn("m", P.messages(F.lit("ask"), F.col("p")))
    edited = F.transform("m", lambda m: F.struct(m["role"].alias("role"), F.when(m["role"] == "user", F.regexp_replace(m["content"], "<information>.", "<information>[cut] ")).when((F.col("l_suppkey") % 3 == 0), F.regexp_replace(m["content"], "</answer>", "!</answer>")).otherwise(m["content"]).alias("content")))
    return rows.select(*_ID, P.only_information_changed(F.col("m"), edited).alias("sound"))


@query("flat_faults", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'query_stage_not_exactly_think_then_search,tag_count_close_search' WHEN 2 THEN 'empty_final_answer' ELSE 'control_tag_inside_information' END AS faults FROM part")
def flat_faults(spark, sf_dir):
    kind = F.col("p_partkey") % 4
    ask = F.concat(F.lit("<think>a</think><search>"), "p_name", F.when(kind == 1, "").otherwise("</search>"))
    say = F.concat(F.lit("<think>b</think> <answer>"), F.when(kind == 2, " ").otherwise(F.col("p_brand")), F.lit("</answer>"))
    info = F.concat("p_type", F.when(kind == 3, "<think>").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(P.flat_faults(ask, info, say), ",").alias("faults"))


@query("assembled", r"SELECT conv_id, string_agg(CASE role WHEN 'user' THEN '<information>' || regexp_replace(text, '^ +| +$', '', 'g') || '</information>' ELSE regexp_replace(text, '^ +| +$', '', 'g') END, chr(10) || chr(10) ORDER BY turn) AS trajectory FROM conversations GROUP BY conv_id")
def assembled(spark, sf_dir):
    """Conversations as trajectories: what users say is the information."""
    user = F.col("role") == "user"
    turn = F.struct("turn", F.when(~user, F.col("text")).alias("raw_output"), F.when(user, F.col("text")).alias("information"))
    got = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return got.select("conv_id", P.assembled(F.col("turns")).alias("trajectory"))


@query("prompt_questions", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'is it ' || p_name || ' Question: or not' ELSE p_type END AS first_question, CASE WHEN p_partkey % 2 = 0 THEN 'or not' ELSE p_type END AS last_question FROM part")
def prompt_questions(spark, sf_dir):
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    asked = F.concat(F.lit("Answer it.\nQuestion: is it "), "p_name", F.lit(" Question: or not "))
    prompt = F.when(F.col("p_partkey") % 2 == 0, F.array(turn("system", F.lit("Question: no")), turn("user", asked))).otherwise(F.array(turn("system", F.concat(F.lit(" "), "p_type"))))
    return table(spark, sf_dir, "part").select("p_partkey", P.question(prompt).alias("first_question"), P.question(prompt, last=True).alias("last_question"))


@query("trajectory_finds", f"WITH {SEQUENCES} SELECT {_K}, CASE WHEN form IN (0, 4, 5) THEN q ELSE '' END AS queries, CASE WHEN form IN (0, 4) THEN gold || '|' || l_suppkey ELSE '' END AS titles FROM rolled")
def trajectory_finds(spark, sf_dir):
    """Queries and document titles of trajectories."""
    quote = F.concat(F.lit('Title: "'), "gold", F.lit("\"\n x title: '"), F.col("l_suppkey").cast("string"), F.lit("'\nTitle:\"  \""))
    text = F.regexp_replace(F.col("response"), F.lit("(?s)<information>.*?</information>"), F.concat(F.lit("<information>"), quote, F.lit("</information>")))
    rows = sequences(spark, sf_dir)
    return rows.select(*_ID, F.array_join(P.queries(text), "|").alias("queries"), F.array_join(P.titles(text), "|").alias("titles"))


@query("edge_parts", f"WITH {SEQUENCES} SELECT {_K}, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE length(response) END AS n_edge, CASE WHEN l_suppkey % 4 > 0 AND form IN (0, 4) THEN 'one/' || q END AS action, CASE WHEN l_suppkey % 4 > 0 AND form IN (0, 4) THEN substr(doc, 1, 9) WHEN l_suppkey % 4 > 0 THEN '' END AS evidence, CASE WHEN l_suppkey % 4 > 0 AND form IN (0, 4) THEN q END AS correction FROM rolled")
def edge_parts(spark, sf_dir):
    """What a node adds to its parent's text, with its action and evidence."""
    parent = F.when(F.col("l_suppkey") % 4 == 0, "other").otherwise("said before ")
    rows = sequences(spark, sf_dir).withColumn("e", P.edge(parent, F.concat(F.lit("said before "), "response")))
    rows = rows.withColumn("a", P.action_parts(F.col("e")))
    return rows.select(*_ID, F.length("e").alias("n_edge"), F.when(F.col("a").isNotNull(), F.concat_ws("/", "a.think", "a.search")).alias("action"), F.when(F.col("e").isNotNull(), P.evidence(F.col("e"), 9)).alias("evidence"), P.correction(F.col("e"))["search"].alias("correction"))


@query("hops", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN 'scout' WHEN 2 THEN p_brand END AS think, CASE WHEN p_partkey % 4 < 3 THEN 'who made ' || p_brand END AS query FROM part")
def hops(spark, sf_dir):
    """Hops read tolerantly: fenced, without a thought, with an answer in it, or too short."""
    kind = F.col("p_partkey") % 4
    ask = F.concat(F.lit("<search> \"who  made "), "p_brand", F.lit('"</search>'))
    think = lambda x: F.concat(F.lit("<think>\n"), x, F.lit("</think>"))
    text = F.when(kind == 0, F.concat(F.lit("```html\n"), think(F.col("p_type")), ask, F.lit("\n```"))).when(kind == 1, F.concat(F.lit("well, "), ask)).when(kind == 2, F.concat(think(F.concat("p_brand", F.lit(" <answer>no</answer>"))), ask, F.lit("<search>later one here</search>"))).otherwise("<search>two words</search>")
    got = table(spark, sf_dir, "part").select("p_partkey", P.hop(text, "scout").alias("h"))
    return got.select("p_partkey", "h.think", "h.query")


@query("kept_ends", "SELECT doc_id, CASE WHEN k >= length(text) THEN text ELSE array_to_string(list_filter([substr(text, 1, (k + 1) // 2), '[... cut ...]', CASE WHEN k // 2 > 0 THEN right(text, k // 2) ELSE '' END], lambda x: x <> ''), ' ') END AS kept FROM (SELECT doc_id, text, CAST(doc_id % 400 AS INT) AS k FROM documents)")
def kept_ends(spark, sf_dir):
    """Head and tail of each document around a marker, 0 to 399 characters of it."""
    return table(spark, sf_dir, "documents").select("doc_id", P.kept_ends(F.col("text"), F.col("doc_id") % 400, "[... cut ...]").alias("kept"))


@query("redact_nested", "SELECT event_id, 'Bearer [REDACTED_API_KEY]' AS header, 'api_key=[REDACTED_API_KEY], ok' AS note, event_type AS kind, '[REDACTED_API_KEY] x' AS named FROM events")
def redact_nested(spark, sf_dir):
    """Credentials in a struct of strings, arrays and maps, quotes and all."""
    e = F.col("event_id").cast("string")
    value = F.struct(F.create_map(F.lit("authorization"), F.concat(F.lit("Bearer t-"), e)).alias("headers"), F.array(F.concat(F.lit("api_key=\\k"), e, F.lit(", ok"))).alias("notes"), F.col("event_type").alias("kind"), F.struct(F.lit("s3cr\"et x").alias("named"), F.lit(1).alias("n")).alias("inner"))
    rows = table(spark, sf_dir, "events").select("event_id", value.alias("v"))
    clean = rows.select("event_id", P.redacted_value(F.col("v"), rows.schema["v"].dataType, 's3cr"et').alias("v"))
    return clean.select("event_id", F.col("v.headers")["authorization"].alias("header"), F.col("v.notes")[0].alias("note"), "v.kind", F.col("v.inner.named").alias("named"))


@query("prompts", "SELECT p_partkey, 'Question: ' || p_name || chr(10) || 'State: ' || p_type || chr(10) || CASE WHEN p_size % 2 = 0 THEN 'Hint: ' || p_brand || chr(10) ELSE '' END || 'Next action:' AS prompt FROM part")
def prompts(spark, sf_dir):
    """Prompts filled in from named parts; a part that is missing leaves its line out."""
    line = lambda name, c: F.coalesce(F.concat(F.lit(f"{name}: "), c, F.lit("\n")), F.lit(""))
    hint = F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(line("Question", F.col("p_name")), line("State", F.col("p_type")), line("Hint", hint), F.lit("Next action:")).alias("prompt"))


@query("likelihood_margins", "SELECT l_returnflag AS event, span, round(avg(CASE arm WHEN 'real' THEN x END) - avg(CASE arm WHEN 'student' THEN x END), 6) + 0.0 AS lift, round(avg(CASE arm WHEN 'real' THEN x END) - avg(CASE arm WHEN 'shuffle' THEN x END), 6) + 0.0 AS control_lift FROM (SELECT l_returnflag, CASE l_linenumber % 3 WHEN 0 THEN 'student' WHEN 1 THEN 'real' ELSE 'shuffle' END AS arm, unnest(['think', 'search']) AS span, unnest([l_tax, l_discount]) AS x FROM lineitem) GROUP BY ALL")
def likelihood_margins(spark, sf_dir):
    """Mean score of each arm and span, and how far the real arm lies above the student and above the shuffled control."""
    arm = F.element_at(F.array(*map(F.lit, ("student", "real", "shuffle"))), (F.col("l_linenumber") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("event"), arm.alias("arm"), F.col("l_tax").alias("think"), F.col("l_discount").alias("search"))
    long = rows.unpivot(["event", "arm"], ["think", "search"], "span", "x")
    wide = long.groupBy("event", "span").pivot("arm", ["student", "real", "shuffle"]).agg(F.avg("x"))
    return wide.select("event", "span", r6(F.col("real") - F.col("student"), "lift"), r6(F.col("real") - F.col("shuffle"), "control_lift"))
