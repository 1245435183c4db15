"""Reward checkers over parts, and losses over token arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rewards as R
from ..functions import text as X
from ..functions import tokens as T
from ..operators import groups as G
from .registry import query
from .relations import ROLLOUTS, r6, rollouts, table
from .texts import _ID, SEQUENCES, _VALID, sequences
from .tokens import TOKENS, responses

_K = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query("multiply_scores", "SELECT p_partkey, CAST(CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 0.1 ELSE 0 END AS DOUBLE) AS score FROM part")
def multiply_scores(spark, sf_dir):
    """A product told right, wrong, without a number, without the assistant, and in a broken tag."""
    kind, product = F.col("p_partkey") % 5, F.col("p_partkey") * F.col("p_size")
    say = lambda x: F.concat(F.lit("ask <answer>7</answer> Assistant: so <answer> "), x, F.lit(" </answer>"))
    text = F.when(kind == 0, say(product.cast("string"))).when(kind == 1, say((product + 1).cast("string"))).when(kind == 2, say(F.lit("12 or so"))).when(kind == 3, F.concat(F.lit("<answer>"), product.cast("string"), F.lit("</answer>"))).otherwise("Assistant: <answer>3")
    return table(spark, sf_dir, "part").select("p_partkey", R.REGISTRY["multiply"](text, product).alias("score"))


@query("countdown_scores", "SELECT p_partkey, CAST(CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 4 THEN 0 ELSE 0.1 END AS DOUBLE) AS score FROM part")
def countdown_scores(spark, sf_dir):
    """(a + b) * 2 told right, with a number left out, off by one, as something that is no arithmetic, and not at all."""
    a, b = F.col("p_partkey").cast("string"), (F.col("p_size") + 1).cast("string")
    kind = F.col("p_partkey") % 5
    said = F.when(kind == 0, F.concat(F.lit("("), a, F.lit(" + "), b, F.lit(") * 2"))).when(kind == 1, F.concat(a, F.lit(" + "), b)).when(kind == 2, F.concat(F.lit("2 * ("), a, F.lit(" - "), b, F.lit(")"))).when(kind == 3, F.concat(a, F.lit(" x "), b, F.lit(" 2")))
    text = F.concat(F.lit("Assistant: "), F.coalesce(F.concat(F.lit("<answer>"), said, F.lit("</answer>")), F.lit("no idea")))
    numbers = F.array(F.lit(2).cast("long"), F.col("p_partkey").cast("long"), (F.col("p_size") + 1).cast("long"))
    return table(spark, sf_dir, "part").select("p_partkey", R.countdown(text, numbers, ((F.col("p_partkey") + F.col("p_size") + 1) * 2).cast("double")).alias("score"))


@query("math_scores", "SELECT p_partkey, CAST(CASE WHEN p_partkey % 6 < 4 THEN 1 ELSE 0 END AS DOUBLE) AS score FROM part")
def math_scores(spark, sf_dir):
    """A fraction told in four equivalent forms, wrong, and outside a box."""
    a, b = (F.col("p_size") % 9 + 1).cast("string"), (F.col("p_partkey") % 7 + 2).cast("string")
    kind = F.col("p_partkey") % 6
    form = F.when(kind == 0, F.concat(F.lit("\\frac{"), a, F.lit("}{"), b, F.lit("}"))).when(kind == 1, F.concat(a, F.lit("/"), b)).when(kind == 2, F.concat(F.lit("x = \\dfrac"), a, b)).when(kind == 3, F.concat(F.lit("\\left\\tfrac{"), a, F.lit("}{"), b, F.lit("}\\right\\%"))).otherwise(F.concat(F.lit("\\frac{"), a, F.lit("}{1"), b, F.lit("}")))
    text = F.concat(F.lit("so \\boxed{1} or "), F.when(kind == 5, form).otherwise(F.concat(F.lit("$\\boxed{"), form, F.lit("}$."))))
    return table(spark, sf_dir, "part").select("p_partkey", R.math(text, F.concat(F.lit("\\frac{"), a, F.lit("}{"), b, F.lit("}"))).alias("score"))


@query("source_rewards", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size % 2 AS DOUBLE) ELSE p_size / 100.0 END AS score FROM part")
def source_rewards(spark, sf_dir):
    source = F.when(F.col("p_partkey") % 2 == 0, "musique").otherwise("web")
    return table(spark, sf_dir, "part").select("p_partkey", R.by_source(source, (F.col("p_size") % 2).cast("double"), F.col("p_size") / 100.0).alias("score"))


@query("judged_scores", "SELECT p_partkey, CAST(CASE WHEN p_size % 3 > 0 THEN 0.25 WHEN p_partkey % 2 = 0 THEN 1 ELSE 0.8 END AS DOUBLE) AS score FROM part")
def judged_scores(spark, sf_dir):
    """Scores raised where a judge, asked for 64 rows at a time, holds the answer equivalent."""
    rows = R.judged(table(spark, sf_dir, "part").select("p_partkey", "p_size"), lambda items: [size % 3 == 0 for (size,) in items], ["p_size"])
    return rows.select("p_partkey", R.upgraded(F.lit(0.25), F.col("equivalent"), F.col("p_partkey") % 2 == 0).alias("score"))


_START = "<|im_start|>assistant" + "' || chr(10) || '"


@query("marked_sequences", f"WITH {SEQUENCES} SELECT {_K}, CASE WHEN l_suppkey % 5 = 0 THEN 'missing_assistant_marker' WHEN form = 2 THEN 'unbalanced_search' WHEN {_VALID} THEN '' ELSE 'order_or_content' END AS fault, l_suppkey % 5 > 0 AND {_VALID} AS valid FROM rolled")
def marked_sequences(spark, sf_dir):
    """The strict form after the assistant's marker, and what is wrong otherwise."""
    prompt = F.when(F.col("l_suppkey") % 5 == 0, "ask <think>").otherwise("ask <think><|im_start|>assistant\n")
    text = F.concat(prompt, F.col("response"))
    return sequences(spark, sf_dir).select(*_ID, X.sequence_fault(text).alias("fault"), X.valid_sequence(text, marker=True).alias("valid"))


@query("lax_sequences", f"WITH {SEQUENCES} SELECT {_K}, form IN (0, 1, 3) AS valid FROM rolled")
def lax_sequences(spark, sf_dir):
    """The lax form: free text between blocks, a search may come first, an answer may follow information."""
    return sequences(spark, sf_dir).select(*_ID, X.valid_sequence(F.concat(F.lit("well "), F.col("response")), X.LAX).alias("valid"))


@query("kl_controller", "SELECT o_custkey, round(CAST(0.1 AS DOUBLE) * exp(sum(ln(1 + least(0.2, greatest(-0.2, o_totalprice / 200000 - 1)) * 32 / 1000))), 8) AS coefficient FROM orders GROUP BY 1")
def kl_controller(spark, sf_dir):
    """The coefficient after each customer's orders, whose prices stand for divergences."""
    got = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("o"))
    return got.select("o_custkey", F.round(T.adaptive_kl(F.col("o.o_totalprice"), 0.1, 200000.0, 1000.0, F.lit(32)), 8).alias("coefficient"))


@query("action_log_probs", f"WITH {TOKENS} SELECT row_id, round(coalesce(sum(lp) FILTER (id <> 3), 0) / greatest(1, count(*) FILTER (id <> 3)), 6) + 0.0 AS mean FROM tokens GROUP BY row_id")
def action_log_probs(spark, sf_dir):
    """Mean log-probability of tokens; id 3 stands for padding."""
    return responses(spark, sf_dir).select("row_id", r6(T.action_log_prob(F.col("lp"), F.col("id"), 3), "mean"))


@query("event_gates", f"WITH {TOKENS} SELECT row_id, round(sum((ref - lp) * m) / greatest(1, sum(m)), 6) + 0.0 AS lift, row_id % 3 > 0 AND sum(m) > 0 AND round(sum((ref - lp) * m) / greatest(1, sum(m)), 9) > 0.05 AS gated FROM tokens GROUP BY row_id")
def event_gates(spark, sf_dir):
    """Events whose teacher raises the tokens' mean log-probability enough."""
    lp, ref, m = F.col("lp"), F.col("ref"), F.col("m")
    return responses(spark, sf_dir).select("row_id", r6(T.mean_lift(lp, ref, m), "lift"), T.event_gate(lp, ref, m, F.col("row_id") % 3 > 0, 0.05 + 1e-9).alias("gated"))


@query(
    "sampled_nll",
    f"""WITH {TOKENS}, s AS (SELECT *, sum(m) OVER w AS nm, sum(1 - m) OVER w AS nk FROM tokens WINDOW w AS (PARTITION BY row_id)),
x AS (SELECT row_id, lp, greatest(0, ref - lp) * (m * 0.2 / greatest(1, nm) + (1 - m) * 1.0 / greatest(1, nk)) * CASE WHEN row_id % 3 > 0 THEN 0.5 ELSE 0 END AS w FROM s)
SELECT row_id, round(-sum(lp * w), 9) + 0.0 AS numerator, round(sum(w), 9) AS weight FROM x GROUP BY row_id""",
)
def sampled_nll(spark, sf_dir):
    """Weighted negative log-likelihood of each response, thought tokens being those of the mask."""
    other = F.transform("m", lambda x: 1 - x)
    rows = responses(spark, sf_dir).withColumn("s", T.span_weights(F.col("m"), other))
    ones = F.transform("m", lambda x: F.lit(1.0))
    got = rows.withColumn("x", T.sampled_nll(F.col("lp"), F.col("ref"), ones, F.col("s"), F.col("row_id") % 3 > 0, F.lit(0.5)))
    return got.select("row_id", (F.round("x.numerator", 9) + F.lit(0.0)).alias("numerator"), F.round("x.weight", 9).alias("weight"))


@query("skill_advantages", f"WITH {TOKENS} SELECT round(sum((ref - lp) * m), 3) + 0.0 AS total, round(sum(abs(ref - lp) * m), 3) AS size, count(*) FILTER (m > 0 AND ref - lp > 1e-9) AS positive, count(*) FILTER (m > 0) AS tokens FROM tokens")
def skill_advantages(spark, sf_dir):
    """What a skill adds, token by token, summed up over all responses."""
    rows = responses(spark, sf_dir).withColumn("a", T.skill_advantage(F.col("ref"), F.col("lp"), F.col("m")))
    x = rows.select(F.explode(F.arrays_zip("a", "m")).alias("x")).select("x.a", "x.m")
    return x.agg((F.round(F.sum("a"), 3) + F.lit(0.0)).alias("total"), F.round(F.sum(F.abs("a")), 3).alias("size"), F.count_if(F.col("a") > 1e-9).alias("positive"), F.count_if(F.col("m") > 0).alias("tokens"))


@query("weighted_loss", f"WITH {TOKENS} SELECT round(sum(m * v * -lp) / greatest(1, sum(m * v)), 6) AS loss, round(avg(CASE WHEN ref > lp THEN 1.0 ELSE 0.0 END) FILTER (m > 0), 6) AS lifted FROM tokens")
def weighted_loss(spark, sf_dir):
    """A weighted mean loss whose weights count as one at least, and the share of tokens that are lifted."""
    x = responses(spark, sf_dir).select(F.explode(F.arrays_zip("lp", "ref", "v", "m")).alias("x")).select("x.*")
    w = F.col("m") * F.col("v")
    return x.agg(F.round(F.sum(w * -F.col("lp")) / F.greatest(F.lit(1.0), F.sum(w)), 6).alias("loss"), F.round(F.avg(F.when(F.col("m") > 0, (F.col("ref") > F.col("lp")).cast("double"))), 6).alias("lifted"))


@query("masked_cross_entropy", f"WITH {TOKENS} SELECT row_id, round(sum(m * (ln(exp(lp) + exp(ref) + exp(v)) - CASE id % 3 WHEN 0 THEN lp WHEN 1 THEN ref ELSE v END)), 5) + 0.0 AS loss, CAST(sum(m) AS BIGINT) AS tokens FROM tokens GROUP BY row_id")
def masked_cross_entropy(spark, sf_dir):
    """Cross-entropy over three logits a token."""
    rows = responses(spark, sf_dir).select("row_id", "m", F.transform("id", lambda x: (x % 3).cast("int")).alias("y"), F.zip_with(F.arrays_zip("lp", "ref"), "v", lambda a, v: F.array(a["lp"], a["ref"], v)).alias("z"))
    return rows.select("row_id", (F.round(T.masked_cross_entropy(F.col("z"), F.col("y"), F.col("m")), 5) + F.lit(0.0)).alias("loss"), F.aggregate("m", F.lit(0.0), lambda s, x: s + x).cast("long").alias("tokens"))


@query("information_masks", f"WITH {TOKENS} SELECT row_id, least(9, 2 + count(*) + 3) AS n, CAST(CASE WHEN count(*) <= 4 THEN 2 + count(*) ELSE 6 END AS BIGINT) AS kept, CAST(least(count(*), 6) * 4 AS BIGINT) AS turns FROM tokens GROUP BY row_id")
def information_masks(spark, sf_dir):
    """Two prompt tokens, a response and three of information, the last nine of them; the response is turn 4."""
    one = lambda *xs: F.array(*[F.lit(x).cast("long") for x in xs])
    rows = responses(spark, sf_dir).withColumn("x", T.with_information(one(1, 2), F.col("id").cast("array<bigint>"), one(7, 8, 9), 9, F.lit(4)))
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x).cast("long")
    return rows.select("row_id", F.size("x.tokens").cast("long").alias("n"), total(F.col("x.mask")).alias("kept"), total(F.col("x.turns")).alias("turns"))


@query("interval_token_scores", f"WITH {TOKENS} SELECT row_id, max(n) * 4 AS tokens, round(sum(v * 3), 5) AS total FROM tokens GROUP BY row_id")
def interval_token_scores(spark, sf_dir):
    """Scores on intervals of four tokens; the last of each gets none."""
    spans = F.transform("v", lambda v, i: F.struct((i * 4).alias("start"), (i * 4 + 4).alias("stop"), v.alias("score")))
    rows = responses(spark, sf_dir).select("row_id", "n", T.interval_scores(F.col("n") * 4, spans).alias("s"))
    return rows.select("row_id", F.size("s").cast("long").alias("tokens"), F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query(
    "gae_whitened",
    f"""WITH {TOKENS}, d AS (SELECT row_id, i, m, r + 0.9 * coalesce(lead(v) OVER (PARTITION BY row_id ORDER BY i), 0) - v AS delta FROM tokens),
a AS (SELECT t.row_id, t.i, t.m, sum(power(CAST(0.855 AS DOUBLE), u.i - t.i) * u.delta) AS adv FROM d t JOIN d u ON u.row_id = t.row_id AND u.i >= t.i GROUP BY ALL),
s AS (SELECT avg(adv) AS mean, var_samp(adv) AS var FROM a WHERE m > 0) SELECT row_id, round(sum(m * (adv - mean) / sqrt(var + 1e-8)), 4) + 0.0 AS whitened FROM a, s GROUP BY row_id""",
)
def gae_whitened(spark, sf_dir):
    """Generalised advantages, whitened over the masked tokens of the whole batch."""
    rows = responses(spark, sf_dir).withColumn("r", T.score_at_last(F.lit(1.0), F.col("n")))
    rows = rows.select("row_id", "m", T.gae(F.col("r"), F.col("v"), 0.9, 0.95).alias("a"))
    valid = rows.select(F.explode(F.arrays_zip("a", "m")).alias("x")).filter("x.m > 0")
    stats = valid.agg(F.avg("x.a").alias("mean"), F.var_samp("x.a").alias("var"))  # one row
    white = F.transform("a", lambda x: (x - F.col("mean")) / F.sqrt(F.col("var") + 1e-8))
    return rows.crossJoin(F.broadcast(stats)).select("row_id", (F.round(T.masked_sum(white, F.col("m")), 4) + F.lit(0.0)).alias("whitened"))


@query(
    "advantage_pooled_tokens",
    f"WITH {TOKENS}, p AS (SELECT row_id, o_custkey AS uid, v, m FROM tokens JOIN orders ON row_id = o_orderkey), s AS (SELECT uid, count(*) AS k, avg(v) AS mean, stddev_samp(v) AS std FROM p WHERE m > 0 GROUP BY uid) SELECT row_id, round(sum(CASE WHEN m > 0 THEN CASE WHEN k = 1 THEN 0 ELSE (v - mean) / (std + 1e-6) END ELSE 0 END), 5) + 0.0 AS total FROM p LEFT JOIN s USING (uid) GROUP BY row_id",
)
def advantage_pooled_tokens(spark, sf_dir):
    """Group-relative advantages over all valid tokens of a group; a group of one token has none."""
    rows = responses(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("uid")), "row_id")
    x = rows.select("row_id", "uid", F.explode(F.arrays_zip("v", "m")).alias("x")).select("row_id", "uid", "x.v", "x.m")
    s = x.filter("m > 0").groupBy("uid").agg(F.count("*").alias("k"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    a = F.when((F.col("m") > 0) & (F.col("k") > 1), (F.col("v") - F.col("mean")) / (F.col("std") + 1e-6)).otherwise(0.0)
    return x.join(s, "uid", "left").groupBy("row_id").agg((F.round(F.sum(a), 5) + F.lit(0.0)).alias("total"))


@query(
    "advantage_branch_credit",
    f"WITH {ROLLOUTS} SELECT tree_uid, line, part, supplier, round(CASE WHEN count(*) OVER w > 1 THEN (score - avg(score) OVER w) / (stddev_samp(score) OVER w + 1e-6) ELSE score / (1 + 1e-6) END + CASE WHEN line % 2 = 0 THEN 0.5 * (tokens / 50 - 0.5) ELSE 0 END, 4) + 0.0 AS advantage FROM rollouts WINDOW w AS (PARTITION BY uid)",
)
def advantage_branch_credit(spark, sf_dir):
    """The group's advantage plus half of a local credit where its mask is set."""
    credit = F.when(F.col("line") % 2 == 0, F.col("tokens") / 50 - 0.5)
    got = G.advantages(rollouts(spark, sf_dir).withColumn("credit", credit), "branch_credit", credit="credit", coefficient=0.5)
    return got.select("tree_uid", "line", "part", "supplier", (F.round("advantage", 4) + F.lit(0.0)).alias("advantage"))
