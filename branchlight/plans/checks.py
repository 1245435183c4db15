"""Smaller column functions over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import tokens as T
from ..functions import trajectory as J
from ..operators import answers as A
from ..operators import retrieval as R
from .registry import query
from .relations import r6, table
from .texts import _ID, _SCORED, NORM, SEQUENCES, sequences
from .tokens import TOKENS, responses

_K = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(
    "shaped_f1",
    f"""WITH {SEQUENCES}, {_SCORED}, j AS (SELECT *, {NORM.format(x='gold')} AS g, {NORM.format(x="coalesce(prediction, '')")} AS p, contains({NORM.format(x="regexp_extract(response, '<information>([^<]*)</information>', 1)")}, {NORM.format(x='gold')}) AS found FROM scored),
f AS (SELECT *, CASE WHEN valid THEN CASE WHEN found THEN 0.3 ELSE 0.2 END ELSE 0 END AS base FROM j)
SELECT {_K}, round(CAST(CASE WHEN prediction IS NULL OR p <> g THEN base WHEN valid THEN 1 ELSE 0.8 END AS DOUBLE), 6) AS score FROM f""",
)
def shaped_f1(spark, sf_dir):
    """The graded reward of rollouts; here an answer is the gold one or shares no word with it."""
    rows = sequences(spark, sf_dir).withColumns({"prediction": X.last_answer(F.col("response")), "valid": X.valid_sequence(F.col("response"))})
    rows = rows.withColumns({"p": X.normalize_answer(F.coalesce("prediction", F.lit(""))), "g": X.normalize_answer(F.col("gold"))})
    rows = rows.withColumns({"a": X.tokens(F.col("p")), "b": X.tokens(F.col("g"))})
    f1 = F.coalesce(X.f1_of(*map(F.col, "pgab")), F.lit(0.0))
    return rows.select(*_ID, r6(X.shaped_f1(F.col("valid"), f1, X.retrieval_correct(F.col("response"), F.array("gold")), F.col("prediction")), "score"))


@query("gsm8k_answers", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_partkey || p_size END AS strict, CASE p_partkey % 3 WHEN 2 THEN NULL ELSE p_partkey || CASE WHEN p_partkey % 3 = 0 THEN ',' || p_size ELSE '' END END AS flexible FROM part")
def gsm8k_answers(spark, sf_dir):
    """Numbers after the mark, without commas and dollars; or the last number of a text."""
    n, m = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("so it is #### "), n, F.lit(","), m)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("first 5 and then "), n, F.lit(" . done"))).otherwise("no number")
    return table(spark, sf_dir, "part").select("p_partkey", A.gsm8k_answer(text).alias("strict"), A.gsm8k_answer(text, False).alias("flexible"))


@query("trajectory_faults", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'trajectory_did_not_end_with_nonempty_answer,final_turn_is_not_answer,empty_final_answer,unexpected_final_tag_count_<answer>,unexpected_final_tag_count_</answer>,unexpected_final_tag_<search>,unexpected_final_tag_</search>' WHEN 2 THEN 'missing_information_after_search' ELSE 'requires_at_least_one_search_round' END AS faults FROM part")
def trajectory_faults(spark, sf_dir):
    """Why turns are not searches and then an answer: sound, without the answer, without an observation, without a search."""
    kind = F.col("p_partkey") % 4
    turn = lambda i, raw, info: F.struct(F.lit(i).alias("turn_index"), raw.alias("raw_output"), info.alias("information"), F.lit(False).alias("hit_max_new_tokens"))
    search = turn(0, F.concat(F.lit("<think>a</think><search>"), "p_name", F.lit("</search>")), F.when(kind != 2, F.col("p_type")))
    answer = turn(1, F.concat(F.lit("<think>b</think><answer>"), "p_brand", F.lit("</answer>")), F.lit(None).cast("string"))
    turns = F.when(kind == 1, F.array(search)).when(kind == 3, F.array(answer)).otherwise(F.array(search, answer))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(J.validate_trajectory(turns, kind != 1), ",").alias("faults"))


@query("thinking_tags", "SELECT p_partkey, '<think>' || p_name || '</think> ' || p_type AS text, CAST(CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 0 END AS INT) AS replaced FROM part")
def thinking_tags(spark, sf_dir):
    open_, close = F.when(F.col("p_partkey") % 2 == 0, "<Thinking>").otherwise("<think>"), F.when(F.col("p_partkey") % 2 == 0, "</THINKING >").otherwise("</think>")
    text, n = J.normalize_thinking(F.concat(F.lit(" "), open_, "p_name", close, F.lit(" "), "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("text"), n.alias("replaced"))


@query("clipped_observations", f"WITH {TOKENS} SELECT row_id, least(4, count(*)) AS n, CAST(sum(CASE WHEN n <= 4 THEN id WHEN i <= 2 THEN id WHEN i = 3 THEN -1 WHEN i = 4 THEN -2 ELSE 0 END) AS BIGINT) AS total FROM tokens GROUP BY row_id")
def clipped_observations(spark, sf_dir):
    """Observations of four tokens at most, the last two of a cut one being its closing tag's."""
    closing = F.array(F.lit(-1).cast("long"), F.lit(-2).cast("long"))
    rows = responses(spark, sf_dir).select("row_id", J.clip_observation(F.col("id").cast("array<bigint>"), 4, closing).alias("t"))
    return rows.select("row_id", F.size("t").cast("long").alias("n"), F.aggregate("t", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("head_and_tail", f"WITH {TOKENS} SELECT row_id, least(4, count(*)) AS n, CAST(sum(CASE WHEN n <= 4 OR i = 1 OR i > n - 3 THEN id ELSE 0 END) AS BIGINT) AS total FROM tokens GROUP BY row_id")
def head_and_tail(spark, sf_dir):
    """The first token and as many of the last as four tokens allow."""
    rows = responses(spark, sf_dir).select("row_id", J.keep_head_and_tail(F.col("id").cast("array<bigint>"), 1, 4).alias("t"))
    return rows.select("row_id", F.size("t").cast("long").alias("n"), F.aggregate("t", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("divergences", "WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_tax AS t, l_discount AS d FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(0.5 * (CASE WHEN t > 0 THEN t * ln(2 * t / (t + d)) ELSE 0 END + CASE WHEN d > 0 THEN d * ln(2 * d / (t + d)) ELSE 0 END + (1 - t) * ln(2 * (1 - t) / (2 - t - d)) + (1 - d) * ln(2 * (1 - d) / (2 - t - d))), 8) + 0.0 AS jsd FROM p")
def divergences(spark, sf_dir):
    """Jensen-Shannon divergence of two coins."""
    coin = lambda c: F.array(F.col(c), 1 - F.col(c))
    return table(spark, sf_dir, "lineitem").select(*_ID, (F.round(T.jsd(coin("l_tax"), coin("l_discount")), 8) + F.lit(0.0)).alias("jsd"))


@query("last_token_rewards", f"WITH {TOKENS} SELECT row_id, max(n) AS n, CAST(max(n) AS BIGINT) AS place, CAST(1 AS DOUBLE) AS total FROM tokens GROUP BY row_id")
def last_token_rewards(spark, sf_dir):
    """A model's score as an array over tokens: at the last valid one."""
    rows = responses(spark, sf_dir).select("row_id", F.col("n").cast("long").alias("n"), T.score_at_last(F.lit(1.0), F.col("n")).alias("s"))
    return rows.select("row_id", "n", F.array_position("s", F.lit(1.0)).alias("place"), F.aggregate("s", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("pooled_vectors", "SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) + 0.0 AS cls, round((embedding[1]::DOUBLE - embedding[1]::DOUBLE / 2) / 2 * 2, 5) + 0.0 AS mean FROM embeddings")
def pooled_vectors(spark, sf_dir):
    """First-token and mean pooling of three token vectors, the last one masked: a vector, its half turned round, and noise."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    tokens = F.array(e, F.transform("embedding", lambda x: -x.cast("double") / 2), F.transform("embedding", lambda x: x.cast("double") * 9))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", tokens.alias("t"))
    mask = F.array(*map(F.lit, (1, 1, 0)))
    return rows.select("vec_id", (F.round(R.unit(R.pooled(F.col("t"), mask, "cls"))[0], 5) + F.lit(0.0)).alias("cls"), (F.round(R.pooled(F.col("t"), mask, "mean")[0] * 2, 5) + F.lit(0.0)).alias("mean"))


@query("compressed_texts", "SELECT p_partkey, len(string_split(trim(p_name), ' ')) <= 4 AS whole, true AS fits FROM part")
def compressed_texts(spark, sf_dir):
    """Names shortened to four words by a count given from outside, here of words."""
    shorten = A.compressing(4, lambda t: len(t.split()), " .. ")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", shorten("p_name").alias("s"))
    return rows.select("p_partkey", (F.col("s") == F.col("p_name")).alias("whole"), (F.size(F.filter(F.split("s", " "), lambda w: w != "")) <= 4).alias("fits"))
