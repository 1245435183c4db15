"""Token-array math: an order is a response, its lines are the tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as T
from .registry import query
from .relations import r6, table

_SORT = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"
#: Tokens one by one; the reward, the order's fraction of a currency unit, comes with the last.
TOKENS = f"""tok AS (SELECT l_orderkey AS row_id, row_number() OVER w AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, -l_tax * 10 AS lp, -l_discount * 10 AS ref, sqrt(l_quantity / 50) AS v, CASE WHEN l_returnflag = 'N' THEN 0.0 ELSE 1.0 END AS m, l_suppkey AS id
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_SORT})), tokens AS (SELECT *, CASE WHEN i = n THEN 1.0 ELSE 0.0 END AS r FROM tok)"""


def responses(spark, sf_dir):
    keys = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    cols = {"lp": -F.col("l_tax") * 10, "ref": -F.col("l_discount") * 10, "v": F.sqrt(F.col("l_quantity") / 50), "m": F.when(F.col("l_returnflag") == "N", 0.0).otherwise(1.0), "id": F.col("l_suppkey")}
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row_id"), *keys, *[c.alias(k) for k, c in cols.items()])
    got = lines.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct(*keys, *cols))).alias("t"))
    return got.select("row_id", F.size("t").alias("n"), *[F.col(f"t.{k}").alias(k) for k in cols])


@query("masked_reductions", f"WITH {TOKENS} SELECT row_id, round(sum(lp * m), 6) + 0.0 AS masked_sum, round(sum(lp * m) / nullif(sum(m), 0), 6) + 0.0 AS masked_mean FROM tokens GROUP BY row_id")
def masked_reductions(spark, sf_dir):
    return responses(spark, sf_dir).select("row_id", r6(T.masked_sum(F.col("lp"), F.col("m")), "masked_sum"), r6(T.masked_mean(F.col("lp"), F.col("m")), "masked_mean"))


@query("masked_whiten", f"WITH {TOKENS}, s AS (SELECT avg(lp) AS mean, var_samp(lp) AS var FROM tokens WHERE m > 0) SELECT row_id, round(sum(m * (lp - mean) / sqrt(var + 1e-8)), 5) + 0.0 AS whitened FROM tokens, s GROUP BY row_id")
def masked_whiten(spark, sf_dir):
    rows = responses(spark, sf_dir)
    valid = rows.select(F.explode(F.arrays_zip("lp", "m")).alias("x")).filter("x.m > 0")
    stats = valid.agg(F.avg("x.lp").alias("mean"), F.var_samp("x.lp").alias("var"))  # one row
    got = rows.crossJoin(F.broadcast(stats))
    white = F.transform("lp", lambda x: (x - F.col("mean")) / F.sqrt(F.col("var") + 1e-8))
    return got.select("row_id", (F.round(T.masked_sum(white, F.col("m")), 5) + F.lit(0.0)).alias("whitened"))


@query("kl_penalties", f"WITH {TOKENS}, k AS (SELECT row_id, lp - ref AS d, greatest(-20, least(20, ref - lp)) AS c FROM tokens) SELECT row_id, round(sum(d), 5) + 0.0 AS kl, round(sum(abs(d)), 5) AS abs, round(sum(0.5 * d * d), 5) AS mse, round(sum(greatest(-10, least(10, exp(c) - c - 1))), 5) + 0.0 AS low_var_kl FROM k GROUP BY row_id")
def kl_penalties(spark, sf_dir):
    total = lambda k: (F.round(F.aggregate(T.kl_penalty(F.col("lp"), F.col("ref"), k), F.lit(0.0), lambda s, x: s + x), 5) + F.lit(0.0)).alias(k)
    return responses(spark, sf_dir).select("row_id", *[total(k) for k in ("kl", "abs", "mse", "low_var_kl")])


@query("kl_shaped_rewards", f"WITH {TOKENS} SELECT row_id, round(sum(r - 0.05 * (lp - ref) * m), 6) + 0.0 AS shaped FROM tokens GROUP BY row_id")
def kl_shaped_rewards(spark, sf_dir):
    rows = responses(spark, sf_dir).withColumn("r", T.score_at_last(F.lit(1.0), F.col("n")))
    kl = F.zip_with(T.kl_penalty(F.col("lp"), F.col("ref"), "kl"), F.col("m"), lambda k, m: 0.05 * k * m)
    shaped = F.zip_with("r", kl, lambda r, k: r - k)
    return rows.select("row_id", r6(F.aggregate(shaped, F.lit(0.0), lambda s, x: s + x), "shaped"))


@query("gae", f"WITH {TOKENS}, d AS (SELECT row_id, i, r + 0.9 * coalesce(lead(v) OVER (PARTITION BY row_id ORDER BY i), 0) - v AS delta, v FROM tokens), a AS (SELECT t.row_id, t.i, t.v, sum(power(CAST(0.855 AS DOUBLE), u.i - t.i) * u.delta) AS adv FROM d t JOIN d u ON u.row_id = t.row_id AND u.i >= t.i GROUP BY ALL) SELECT row_id, CAST(i AS INT) AS i, round(adv, 6) + 0.0 AS advantage, round(adv + v, 6) + 0.0 AS ret FROM a")
def gae(spark, sf_dir):
    rows = responses(spark, sf_dir).withColumn("r", T.score_at_last(F.lit(1.0), F.col("n")))
    got = rows.withColumn("a", T.gae(F.col("r"), F.col("v"), 0.9, 0.95)).select("row_id", F.posexplode(F.arrays_zip("a", "v")).alias("i", "x"))
    at = lambda c, n: (F.round(c, 6) + F.lit(0.0)).alias(n)
    return got.select("row_id", (F.col("i") + 1).alias("i"), at(F.col("x.a"), "advantage"), at(F.col("x.a") + F.col("x.v"), "ret"))


@query("eos_and_positions", f"WITH {TOKENS}, e AS (SELECT *, min(CASE WHEN id % 3 = 0 THEN i END) OVER (PARTITION BY row_id) AS stop FROM tokens) SELECT row_id, CAST(sum(CASE WHEN stop IS NULL OR i <= stop THEN 1 ELSE 0 END) AS BIGINT) AS kept, CAST(sum(m) AS BIGINT) - 1 AS last_position FROM e GROUP BY row_id")
def eos_and_positions(spark, sf_dir):
    """Tokens kept by the end mask (ids divisible by three end) and the last position id."""
    rows = responses(spark, sf_dir)
    kept = T.eos_mask(F.transform("id", lambda x: (x % 3).cast("int")), F.lit(0))
    positions = T.position_ids(F.transform("m", lambda x: x.cast("int")))
    return rows.select("row_id", F.aggregate(kept, F.lit(0), lambda s, x: s + x).cast("long").alias("kept"), F.element_at(positions, -1).cast("long").alias("last_position"))


@query("pad_and_truncate", f"WITH {TOKENS} SELECT row_id, string_agg(CASE WHEN i <= 4 THEN id END, ',' ORDER BY i) || repeat(',0', 4 - CAST(least(max(n), 4) AS INT)) AS padded_right, repeat('0,', 4 - CAST(least(max(n), 4) AS INT)) || string_agg(CASE WHEN i > n - 4 THEN id END, ',' ORDER BY i) AS padded_left FROM tokens GROUP BY row_id")
def pad_and_truncate(spark, sf_dir):
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    zero = lambda left: text(T.pad(F.col("id"), 4, 0, left))
    return responses(spark, sf_dir).select("row_id", zero(False).alias("padded_right"), zero(True).alias("padded_left"))


@query(
    "policy_loss",
    f"""WITH {TOKENS}, p AS (SELECT row_id, m, exp(lp - ref) AS ratio, lp - ref AS d, v - 0.5 AS a FROM tokens),
l AS (SELECT row_id, m, d, ratio, a, greatest(-a * ratio, -a * least(1.2, greatest(0.8, ratio))) AS loss FROM p)
SELECT round(sum(loss * m) / sum(m), 6) + 0.0 AS token_mean, round(sum(CASE WHEN a < 0 THEN least(loss, -a * 3) ELSE loss END * m) / sum(m), 6) + 0.0 AS dual, round(sum(CASE WHEN loss > -a * ratio THEN m ELSE 0 END) / sum(m), 6) AS clip_fraction, round(sum(-d * m) / sum(m), 6) + 0.0 AS approx_kl FROM l""",
)
def policy_loss(spark, sf_dir):
    """Clipped and dual-clipped policy loss, share of clipped tokens, and KL, all over valid tokens."""
    t = responses(spark, sf_dir).select(F.explode(F.arrays_zip("lp", "ref", "v", "m")).alias("t")).select("t.*")
    t = t.select("m", (F.col("lp") - F.col("ref")).alias("d"), F.exp(F.col("lp") - F.col("ref")).alias("ratio"), (F.col("v") - 0.5).alias("a"))
    loss = T.clipped_objective(F.col("ratio"), F.col("a"))
    mean = lambda x, name: r6(F.sum(x * F.col("m")) / F.sum("m"), name)
    return t.agg(mean(loss, "token_mean"), mean(T.dual_clipped_objective(F.col("ratio"), F.col("a")), "dual"), mean((loss > -F.col("a") * F.col("ratio")).cast("double"), "clip_fraction"), mean(-F.col("d"), "approx_kl"))


@query("aggregate_loss", f"WITH {TOKENS}, s AS (SELECT row_id, sum(v * m) AS total, sum(m) AS k FROM tokens GROUP BY row_id) SELECT round(sum(total) / sum(k), 6) AS token_mean, round(avg(total), 6) AS seq_mean_token_sum, round(avg(CASE WHEN k > 0 THEN total / k END), 6) AS seq_mean_token_mean FROM s")
def aggregate_loss(spark, sf_dir):
    rows = responses(spark, sf_dir).select(T.masked_sum(F.col("v"), F.col("m")).alias("total"), F.aggregate("m", F.lit(0.0), lambda s, x: s + x).alias("k"))
    return rows.agg(r6(F.sum("total") / F.sum("k"), "token_mean"), r6(F.avg("total"), "seq_mean_token_sum"), r6(F.avg(F.try_divide("total", "k")), "seq_mean_token_mean"))


@query("sequence_ratio", f"WITH {TOKENS} SELECT row_id, round(exp(sum((lp - ref) * m) / greatest(sum(m), 1)), 6) AS ratio FROM tokens GROUP BY row_id")
def sequence_ratio(spark, sf_dir):
    """One importance ratio per response: the exponential of its mean log-probability difference."""
    d = F.zip_with("lp", "ref", lambda a, b: a - b)
    k = F.greatest(F.aggregate("m", F.lit(0.0), lambda s, x: s + x), F.lit(1.0))
    return responses(spark, sf_dir).select("row_id", r6(F.exp(T.masked_sum(d, F.col("m")) / k), "ratio"))


@query("turn_ratio", f"WITH {TOKENS} SELECT row_id, i AS turn, CASE WHEN i < 10 THEN round(exp(lp - ref), 6) ELSE 0.0 END AS ratio FROM tokens")
def turn_ratio(spark, sf_dir):
    """A ratio per turn, one token each here; turns from the tenth on keep ratio zero."""
    t = responses(spark, sf_dir).select("row_id", F.posexplode(F.zip_with("lp", "ref", lambda a, b: a - b)).alias("i", "d"))
    got = t.groupBy("row_id", (F.col("i") + 1).cast("long").alias("turn")).agg(F.avg("d").alias("d"))
    return got.select("row_id", "turn", F.when(F.col("turn") < 10, F.round(F.exp("d"), 6)).otherwise(0.0).alias("ratio"))


@query("value_loss", f"WITH {TOKENS}, c AS (SELECT m, power(v - r, 2) AS plain, power(greatest(0.4, least(0.6, v)) - r, 2) AS clipped FROM tokens) SELECT round(0.5 * sum(greatest(plain, clipped) * m) / sum(m), 6) AS loss, round(sum(CASE WHEN clipped > plain THEN m ELSE 0 END) / sum(m), 6) AS clip_fraction FROM c")
def value_loss(spark, sf_dir):
    rows = responses(spark, sf_dir).withColumn("r", T.score_at_last(F.lit(1.0), F.col("n")))
    t = rows.select(F.explode(F.arrays_zip("v", "r", "m")).alias("t")).select("t.*")
    plain = F.pow(F.col("v") - F.col("r"), 2)
    clipped = F.pow(F.greatest(F.lit(0.4), F.least(F.lit(0.6), F.col("v"))) - F.col("r"), 2)
    return t.agg(r6(0.5 * F.sum(F.greatest(plain, clipped) * F.col("m")) / F.sum("m"), "loss"), r6(F.sum((clipped > plain).cast("double") * F.col("m")) / F.sum("m"), "clip_fraction"))


@query("entropy_and_log_prob", "WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i, label % 64 AS label FROM embeddings), z AS (SELECT vec_id, ln(sum(exp(e))) AS lse, sum(e * exp(e)) / sum(exp(e)) AS mean, max(CASE WHEN i = label + 1 THEN e END) AS hit FROM x GROUP BY vec_id) SELECT vec_id, round(lse - mean, 5) AS entropy, round(hit - lse, 5) AS log_prob FROM z")
def entropy_and_log_prob(spark, sf_dir):
    """Embeddings taken as logits."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"), (F.col("label") % 64).alias("label"))
    return rows.select("vec_id", F.round(T.entropy(F.col("x")), 5).alias("entropy"), F.round(T.log_prob(F.col("x"), F.col("label")), 5).alias("log_prob"))
