"""Answer scoring, trajectory form, redaction and phrase tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import trajectory as R
from .registry import query
from .relations import r6, table

#: Written for str.format().
_PUNCT = r"[!-/:-@\[-`{{-~]"
#: normalize_answer() in SQL, without word boundaries: articles are whole words once punctuation is gone.
NORM = "array_to_string(list_filter(string_split_regex(regexp_replace(lower({x}), '" + _PUNCT + r"', '', 'g'), '\s+'), lambda t: t NOT IN ('a', 'an', 'the', '')), ' ')"
TOKENS = "list_filter(string_split_regex(regexp_replace(lower({x}), '" + _PUNCT + r"', '', 'g'), '\s+'), lambda t: t NOT IN ('a', 'an', 'the', ''))"
#: A user turn and the assistant's next turn.
PAIRS = "pairs AS (SELECT a.conv_id, a.turn, a.text AS gold, b.text AS prediction FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"


def pairs(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("gold"))
    said = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction"))
    return asked.join(said, ["conv_id", "turn"])


@query("normalize_answer", f"SELECT doc_id, {NORM.format(x='text')} AS normalized FROM documents")
def normalize_answer(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_answer(F.col("text")).alias("normalized"))


@query("answer_em", f"WITH {PAIRS} SELECT conv_id, turn, {NORM.format(x='gold')} = {NORM.format(x='prediction')} AS em, contains({NORM.format(x='prediction')}, {NORM.format(x='gold')}) AS subem, contains({NORM.format(x='gold || prediction')}, {NORM.format(x='prediction')}) AS sub_other FROM pairs")
def answer_em(spark, sf_dir):
    g, p = F.col("gold"), F.col("prediction")
    return pairs(spark, sf_dir).select("conv_id", "turn", T.em_check(p, F.array(g)).alias("em"), T.subem_check(p, F.array(g)).alias("subem"), T.subem_check(F.concat(g, p), F.array(p)).alias("sub_other"))


@query(
    "token_f1",
    f"""WITH {PAIRS}, t AS (SELECT conv_id, turn, {TOKENS.format(x='prediction')} AS a, {TOKENS.format(x='gold')} AS b FROM pairs),
s AS (SELECT *, list_sum(list_transform(list_distinct(a), lambda t: least(len(list_filter(a, lambda x: x = t)), len(list_filter(b, lambda x: x = t))))) AS same FROM t)
SELECT conv_id, turn, round(CASE WHEN coalesce(same, 0) = 0 THEN 0 ELSE 2 * (same / len(a)) * (same / len(b)) / (same / len(a) + same / len(b)) END, 6) AS f1 FROM s""",
)
def token_f1(spark, sf_dir):
    # Normalised once as columns, then cut once: expressions inside a lambda would be evaluated for every element.
    rows = pairs(spark, sf_dir).select("conv_id", "turn", *[T.normalize_answer(F.col(c)).alias(n) for c, n in (("prediction", "p"), ("gold", "g"))])
    rows = rows.withColumns({"a": T.tokens(F.col("p")), "b": T.tokens(F.col("g"))})
    return rows.select("conv_id", "turn", r6(T.f1_of(*map(F.col, "pgab")), "f1"))


@query("token_jaccard", f"WITH {PAIRS}, t AS (SELECT conv_id, turn, list_distinct({TOKENS.format(x='prediction')}) AS a, list_distinct({TOKENS.format(x='gold')}) AS b FROM pairs) SELECT conv_id, turn, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS jaccard FROM t")
def token_jaccard(spark, sf_dir):
    a, b = (T.tokens(T.normalize_answer(F.col(c))) for c in ("prediction", "gold"))
    return pairs(spark, sf_dir).select("conv_id", "turn", r6(T.jaccard(a, b), "jaccard"))


@query("question_key", r"SELECT question_key, count(*) AS n, min(conv_id) AS first_conv FROM (SELECT conv_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS question_key FROM conversations) GROUP BY question_key")
def question_key(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy(T.question_key(F.col("text")).alias("question_key")).agg(F.count("*").alias("n"), F.min("conv_id").alias("first_conv"))


#: A rollout in six forms, some of them broken, with a part's brand as gold answer.
SEQUENCES = """sequences AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_brand AS gold, p_type AS other, l_linenumber % 6 AS form,
    CASE WHEN (l_partkey + l_suppkey) % 3 = 0 THEN p_brand ELSE p_type END AS said, p_name AS q,
    CASE WHEN l_suppkey % 2 = 0 THEN 'Doc 1(Title: ' || p_brand || ') ' || p_name ELSE 'Doc 1(Title: x) none' END AS doc
  FROM lineitem JOIN part ON l_partkey = p_partkey),
rolled AS (SELECT *, CASE form
    WHEN 0 THEN '<think>one</think><search>' || q || '</search><information>' || doc || '</information><think>two</think><answer>' || said || '</answer>'
    WHEN 1 THEN '<think>one</think>' || chr(10) || '<answer>' || said || '</answer>' || chr(10)
    WHEN 2 THEN '<think>one</think><search>' || q || '<answer>' || said || '</answer>'
    WHEN 3 THEN '<think>one</think> stray <answer>' || said || '</answer>'
    WHEN 4 THEN '<think>one</think><search>' || q || '</search><information>' || doc || '</information>'
    ELSE '<search>' || q || '</search><answer>' || said || '</answer><answer> ' || gold || ' </answer>' END AS response FROM sequences)"""
_VALID = r"regexp_full_match(response, '\s*(<think>[^<]*</think>\s*<search>[^<]*</search>\s*<information>[^<]*</information>\s*)*<think>[^<]*</think>\s*<answer>[^<]*</answer>\s*')"
_ANSWERS = "regexp_extract_all(response, '<answer>([^<]*)</answer>', 1)"
_SCORED = f"scored AS (SELECT *, {_VALID} AS valid, trim({_ANSWERS}[-1]) AS prediction, len({_ANSWERS}) AS n_answers FROM rolled)"
_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def sequences(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*_ID)
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    got = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    said = F.when((F.col("l_partkey") + F.col("l_suppkey")) % 3 == 0, F.col("p_brand")).otherwise(F.col("p_type"))
    doc = F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("Doc 1(Title: "), "p_brand", F.lit(") "), "p_name")).otherwise("Doc 1(Title: x) none")
    got = got.select(*_ID, F.col("p_brand").alias("gold"), said.alias("said"), F.col("p_name").alias("q"), doc.alias("doc"))
    block = lambda tag, x: F.concat(F.lit(f"<{tag}>"), x if not isinstance(x, str) else F.lit(x), F.lit(f"</{tag}>"))
    think, search, info, answer = block("think", "one"), block("search", F.col("q")), block("information", F.col("doc")), block("answer", F.col("said"))
    forms = [
        F.concat(think, search, info, block("think", "two"), answer),
        F.concat(think, F.lit("\n"), answer, F.lit("\n")),
        F.concat(think, F.lit("<search>"), "q", answer),
        F.concat(think, F.lit(" stray "), answer),
        F.concat(think, search, info),
        F.concat(search, answer, block("answer", F.concat(F.lit(" "), "gold", F.lit(" ")))),
    ]
    form = F.col("l_linenumber") % 6
    response = F.coalesce(*[F.when(form == i, x) for i, x in enumerate(forms)])
    return got.withColumn("response", response)


@query("valid_sequence", f"WITH {SEQUENCES} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_VALID} AS valid FROM rolled")
def valid_sequence(spark, sf_dir):
    return sequences(spark, sf_dir).select(*_ID, T.valid_sequence(F.col("response")).alias("valid"))


@query(
    "answer_scores",
    f"""WITH {SEQUENCES}, {_SCORED}, j AS (SELECT *, {NORM.format(x='gold')} AS g, {NORM.format(x="coalesce(prediction, '')")} AS p FROM scored)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, prediction, CASE WHEN n_answers >= 2 THEN prediction END AS solution,
  CAST(CASE WHEN prediction IS NULL THEN 0 WHEN g = p THEN 1 ELSE 0.1 END AS DOUBLE) AS em_score, CAST(CASE WHEN prediction IS NULL THEN 0 WHEN contains(p, g) THEN 1 ELSE 0.1 END AS DOUBLE) AS subem_score,
  CASE WHEN prediction IS NULL THEN 0 ELSE CAST(length(p) > 0 AND g = p AS INT) END AS pure_em FROM j""",
)
def answer_scores(spark, sf_dir):
    rows = sequences(spark, sf_dir).withColumns({"prediction": T.last_answer(F.col("response")), "solution": T.extract_solution(F.col("response"))})
    p, golds = F.col("prediction"), F.array("gold")
    return rows.select(*_ID, "prediction", "solution", T.score(p, T.em_check(p, golds)).alias("em_score"), T.score(p, T.subem_check(p, golds)).alias("subem_score"), F.coalesce(T.answer_em(p, golds), F.lit(False)).cast("int").alias("pure_em"))


@query(
    "shaped_scores",
    f"""WITH {SEQUENCES}, {_SCORED}, j AS (SELECT *, {NORM.format(x='gold')} AS g, {NORM.format(x="coalesce(prediction, '')")} AS p, contains({NORM.format(x="regexp_extract(response, '<information>([^<]*)</information>', 1)")}, {NORM.format(x='gold')}) AS found FROM scored)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CASE WHEN prediction IS NULL THEN CASE WHEN valid THEN CASE WHEN found THEN 0.3 ELSE 0.2 END ELSE 0 END
  WHEN g = p THEN CASE WHEN valid THEN 1 ELSE 0.8 END WHEN valid THEN CASE WHEN found THEN 0.3 ELSE 0.2 END ELSE 0.1 END AS DOUBLE) AS score FROM j""",
)
def shaped_scores(spark, sf_dir):
    rows = sequences(spark, sf_dir).withColumns({"prediction": T.last_answer(F.col("response")), "valid": T.valid_sequence(F.col("response"))})
    golds = F.array("gold")
    got = T.shaped_score(F.col("valid"), T.em_check(F.col("prediction"), golds), T.retrieval_correct(F.col("response"), golds), F.col("prediction"))
    return rows.select(*_ID, r6(got, "score"))


@query(
    "parse_action",
    f"""WITH {SEQUENCES}, a AS (SELECT *, regexp_extract(response, '<search>([^<]*)</search>', 1) AS s, regexp_extract(response, '<answer>([^<]*)</answer>', 1) AS n, instr(response, '<search>') AS at FROM rolled)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN s <> '' THEN 'search' WHEN n <> '' THEN 'answer' END AS action, CASE WHEN s <> '' THEN trim(s) WHEN n <> '' THEN trim(n) END AS content,
  CASE WHEN contains(response, '</search>') THEN split_part(response, '</search>', 1) || '</search>' WHEN contains(response, '</answer>') THEN split_part(response, '</answer>', 1) || '</answer>' ELSE response END AS cut,
  CAST(len(regexp_extract_all(response, '<think>')) AS INT) AS n_think FROM a""",
)
def parse_action(spark, sf_dir):
    rows = sequences(spark, sf_dir).withColumn("a", T.first_action(F.col("response")))
    return rows.select(*_ID, "a.action", "a.content", T.cut_at_action(F.col("response")).alias("cut"), T.tag_count(F.col("response"), "think").alias("n_think"))


@query(
    "observations",
    f"""WITH {SEQUENCES}, a AS (SELECT *, regexp_extract(response, '<search>([^<]*)</search>', 1) AS s, regexp_extract(response, '<answer>([^<]*)</answer>', 1) AS n FROM rolled)
SELECT CASE WHEN s <> '' THEN 'search' WHEN n <> '' THEN 'answer' ELSE 'invalid' END AS kind, count(*) AS n, count(*) FILTER (s = '' AND n <> '') AS n_done, count(*) FILTER (s <> '' OR n <> '') AS n_valid, CAST(sum(CASE WHEN s <> '' THEN length(doc) + 31 ELSE 0 END) AS BIGINT) AS observed FROM a GROUP BY 1""",
)
def observations(spark, sf_dir):
    """What the environment answers to each action: a search's information block, nothing for an answer."""
    rows = sequences(spark, sf_dir).withColumn("a", T.first_action(F.col("response")))
    kind = F.coalesce("a.action", F.lit("invalid"))
    observed = F.when(kind == "search", F.concat(F.lit("\n\n<information>"), "doc", F.lit("</information>\n\n"))).otherwise("")
    got = rows.select(kind.alias("kind"), observed.alias("observed")).groupBy("kind")
    return got.agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "answer").alias("n_done"), F.count_if(F.col("kind") != "invalid").alias("n_valid"), F.sum(F.length("observed")).cast("long").alias("observed"))


@query("redact_answers", r"SELECT p_partkey, regexp_replace('say ' || p_name || ' (' || p_brand || ') or x' || p_brand || ', ' || p_type, '(^|[^0-9A-Za-z_])' || regexp_replace(p_brand, '([\.#])', '\\\1', 'g') || '([^0-9A-Za-z_]|$)', '\1[REDACTED]\2', 'gi') AS redacted FROM part")
def redact_answers(spark, sf_dir):
    text = F.concat(F.lit("say "), "p_name", F.lit(" ("), "p_brand", F.lit(") or x"), "p_brand", F.lit(", "), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", T.redact(text, F.array("p_brand", F.lit(""))).alias("redacted"))


@query("phrase_present", r"SELECT p_partkey, contains(' ' || regexp_replace(trim(regexp_replace(lower(p_type), '[^a-z0-9_]+', ' ', 'g')), '\s+', ' ', 'g') || ' ', ' ' || split_part(lower(p_name), ' ', 1) || ' ') AS in_type, contains(' ' || trim(regexp_replace(lower(p_name), '[^a-z0-9_]+', ' ', 'g')) || ' ', ' ' || split_part(lower(p_name), ' ', 1) || ' ') AS in_name FROM part")
def phrase_present(spark, sf_dir):
    first = F.element_at(F.split("p_name", " "), 1)
    return table(spark, sf_dir, "part").select("p_partkey", T.phrase_present(F.col("p_type"), first).alias("in_type"), T.phrase_present(F.col("p_name"), first).alias("in_name"))


@query("hash_holdout", "SELECT doc_id, CAST('0x' || substr(sha256('7:' || doc_id), 1, 16) AS UBIGINT) / 18446744073709551616.0 < CAST(0.1 AS DOUBLE) AS held_out FROM documents")
def hash_holdout(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.heldout(F.col("doc_id").cast("string"), 7, 0.1).alias("held_out"))


@query("redact_credentials", r"""SELECT event_id, '{"api_key": "[REDACTED]", "note": "Bearer [REDACTED]", "type": "' || event_type || '"}' AS clean FROM events""")
def redact_credentials(spark, sf_dir):
    raw = F.concat(F.lit('{"api_key": "k-'), F.col("user_id").cast("string"), F.lit('", "note": "bearer t'), F.col("event_id").cast("string"), F.lit('", "type": "'), "event_type", F.lit('"}'))
    return table(spark, sf_dir, "events").select("event_id", T.redact_credentials(raw).alias("clean"))


@query("lexical_relevance", f"WITH {PAIRS} SELECT conv_id, turn, CAST(len(list_intersect(list_distinct(regexp_extract_all(lower(gold), '[a-z]{{4,}}')), list_distinct(regexp_extract_all(lower(prediction), '[a-z]{{4,}}')))) AS INT) AS relevance FROM pairs")
def lexical_relevance(spark, sf_dir):
    terms = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z]{4,})"), F.lit(1))
    return pairs(spark, sf_dir).select("conv_id", "turn", F.size(F.array_intersect(terms("gold"), terms("prediction"))).alias("relevance"))


@query(
    "query_validity",
    """WITH w AS (SELECT conv_id, turn, text, len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS n FROM conversations)
SELECT conv_id, turn, CASE WHEN n < 3 THEN 'too_short' WHEN n > 30 THEN 'too_long' WHEN length(text) > 240 THEN 'too_many_characters' ELSE 'valid' END AS reason FROM w""",
)
def query_validity(spark, sf_dir):
    """Why a search query is not acceptable: 3 to 30 words and at most 240 characters are."""
    n = F.size(F.filter(F.split("text", " "), lambda x: x != ""))
    reason = F.when(n < 3, "too_short").when(n > 30, "too_long").when(F.length("text") > 240, "too_many_characters").otherwise("valid")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", reason.alias("reason"))


@query(
    "passages_to_string",
    """SELECT ps_order AS order_key, string_agg('Doc ' || i || '(Title: ' || p_brand || ') ' || p_name || chr(10), '' ORDER BY i) AS passages
FROM (SELECT l_orderkey AS ps_order, p_brand, p_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY ps_order""",
)
def passages_to_string(spark, sf_dir):
    """The text block that an agent sees for its retrieved documents."""
    lines = table(spark, sf_dir, "lineitem").select(*_ID).join(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    docs = lines.groupBy(F.col("l_orderkey").alias("order_key")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "p_brand", "p_name"))).alias("d"))
    line = lambda d, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit("(Title: "), d["p_brand"], F.lit(") "), d["p_name"], F.lit("\n"))
    return docs.select("order_key", F.array_join(F.transform("d", line), "").alias("passages"))


@query("trajectory_messages", f"WITH {SEQUENCES} SELECT form, count(*) AS n, count(*) FILTER (response LIKE '%<information>%') AS n_user_turns, CAST(sum(length(response)) AS BIGINT) AS n_chars FROM rolled GROUP BY form")
def trajectory_messages(spark, sf_dir):
    """Messages of each trajectory: information becomes a user turn, the rest assistant turns; joined again they are the trajectory."""
    parts = F.split("response", r"(?=<information>)|(?<=</information>)", -1)
    messages = F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.struct(F.when(F.startswith(p, F.lit("<information>")), "user").otherwise("assistant").alias("role"), p.alias("content")))
    rows = sequences(spark, sf_dir).withColumn("m", messages).withColumn("back", F.array_join("m.content", ""))
    got = rows.groupBy((F.col("l_linenumber") % 6).alias("form"))
    return got.agg(F.count("*").alias("n"), F.count_if(F.exists("m", lambda x: x["role"] == "user")).alias("n_user_turns"), F.sum(F.when(F.col("back") == F.col("response"), F.length("back"))).cast("long").alias("n_chars"))


_STRICT = r"regexp_full_match(response, '\s*<think>.*</think>\s*<{t}>.*</{t}>\s*', 's')"


@query(
    "parse_turn",
    f"""WITH {SEQUENCES}, p AS (SELECT *, {_STRICT.format(t='answer')} AS strict_answer, len({_ANSWERS}) > 0 AS has_answer, regexp_extract(response, '<search>([^<]*)</search>', 1) AS s FROM rolled)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN has_answer THEN 'answer' WHEN s <> '' THEN 'search' ELSE 'failure' END AS action, strict_answer AS strict,
  CASE WHEN strict_answer OR s = '' THEN NULL ELSE trim(s) END AS query, trim({_ANSWERS}[-1]) AS answer,
  CASE WHEN strict_answer THEN '' WHEN has_answer AND s <> '' THEN 'answer_turn_not_exact_think_then_answer,answer_turn_contains_search_tag' WHEN has_answer THEN 'answer_turn_not_exact_think_then_answer' ELSE 'search_turn_not_exact_think_then_search' END AS reasons FROM p""",
)
def parse_turn(spark, sf_dir):
    """Each rollout taken as one turn: what it does, and what is wrong with its form."""
    rows = sequences(spark, sf_dir).withColumn("p", R.parse_turn(F.col("response")))
    return rows.select(*_ID, "p.action", "p.strict", "p.query", "p.answer", F.array_join("p.reasons", ",").alias("reasons"))


@query("web_results", "WITH d AS (SELECT l_orderkey, p_brand, min(l_linenumber * 1000000 + l_partkey) AS first FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY first, p_brand) AS i FROM d) SELECT l_orderkey, string_agg('Page ' || i || ': ' || substr(p_brand, 1, 7), chr(10) ORDER BY i) AS pages FROM r WHERE i <= 3 GROUP BY l_orderkey")
def web_results(spark, sf_dir):
    """Distinct brands of each order, as found, as three result pages."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("at"), "l_partkey")
    got = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("at", "p_brand"))).alias("d"))
    return got.select("l_orderkey", R.web_results(F.col("d.p_brand"), 3, 7).alias("pages"))


@query("loss_mask_coverage", "SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS tokens, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS trained FROM conversations GROUP BY conv_id")
def loss_mask_coverage(spark, sf_dir):
    """Characters stand for tokens: how many of each conversation are trained on."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("n")))).alias("m"))
    got = turns.select("conv_id", R.loss_mask(F.col("m.role"), F.col("m.n")).alias("mask"))
    return got.select("conv_id", F.size("mask").cast("long").alias("tokens"), F.aggregate("mask", F.lit(0), lambda s, x: s + x).cast("long").alias("trained"))
