"""Distillation events and rescued rows on customer trees and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distill as D
from ..operators import rescue as R
from .registry import query
from .relations import table

#: Tags as single ids.
_MARKS = D.Marks(((1,), (2,)), ((3,), (4,)))


def _edges(spark, sf_dir):
    """Customers are roots, orders their children, and each order has one child more, which ends the path. An edge thinks its key's digits and searches
    its status; every fifth order has no search, every seventh saw its query."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")
    k = F.col("o_orderkey")
    asked = F.transform(F.split("o_orderpriority", ""), lambda c: F.ascii(c))
    one = lambda *xs: F.array(*map(F.lit, xs))
    # Columns, so that no token of what is made of them makes them again.
    o = o.withColumn("digits", F.transform(F.split(k.cast("string"), ""), lambda c: F.ascii(c))).withColumn("n", F.size("digits"))
    digits = F.col("digits")
    o = o.withColumn("first", F.when(k % 5 == 0, digits).otherwise(F.concat(one(1), digits, one(2, 3), asked, one(4)))).withColumn("last", F.concat(one(1), digits, one(2, 3), digits, one(4)))
    shape = lambda uid, parent, t, value, place, leaves: [F.col("o_custkey").alias("tree_uid"), uid.alias("node_uid"), parent.alias("parent_node_uid"), t.alias("tokens"), F.transform(t, lambda x, i: F.when((k % 7 == 0) & (x == 3), 1).when((k % 7 == 0) & (i > F.col("n") + 2), 0).otherwise(1)).alias("info"), value.alias("node_value"), place.alias("place"), leaves.alias("leaf_count")]
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    none = F.array().cast("array<int>")
    value = F.round(F.col("o_totalprice") % 1, 2)
    root = o.select("o_custkey").distinct().select(F.col("o_custkey").alias("tree_uid"), text("c", F.col("o_custkey")).alias("node_uid"), F.lit(None).cast("string").alias("parent_node_uid"), none.alias("tokens"), none.alias("info"), F.lit(0.0).alias("node_value"), F.lit(0).cast("long").alias("place"), F.lit(1).cast("long").alias("leaf_count"))
    middle = o.select(*shape(text("o", k), text("c", F.col("o_custkey")), F.col("first"), value, k, k % 3 + 1))
    last = o.select(*shape(text("e", k), text("o", k), F.col("last"), value, k, F.lit(1).cast("long")))
    nodes = root.unionByName(middle).unionByName(last)
    return D.with_spans(nodes, _MARKS).withColumn("instruction", F.when(F.col("place") % 11 != 0, one(9, 9, 9)))


#: n: digits of the key; an edge's tokens are think, digits, end, search, query, end.
_SQL = """o AS (SELECT o_custkey AS t, o_orderkey AS k, length(CAST(o_orderkey AS VARCHAR)) AS n, length(o_orderpriority) AS m, round(o_totalprice % 1, 2) AS v, o_orderkey % 3 + 1 AS w FROM orders),
e AS (SELECT t, k, 'o' || k AS id, n, m, v, w, CASE WHEN k % 5 = 0 THEN 'no_search' WHEN k % 7 = 0 THEN 'observed_tokens' END AS bad FROM o),
l AS (SELECT t, k, 'e' || k AS id, n, n AS m, v, 1 AS w, CASE WHEN k % 7 = 0 THEN 'observed_tokens' END AS bad FROM o)"""


def _shown(rows):
    return rows.select("leaf", "at", "node_uid", F.round("weight", 6).alias("weight"), F.size("positions").cast("long").alias("taught"), F.aggregate("positions", F.lit(0).cast("long"), lambda a, x: a + x).alias("places"), F.col("required").cast("long").alias("required"))


_PLACES = "(n + m) AS taught, n * (n + 1) // 2 + m * (n + 3) + m * (m - 1) // 2 AS places, CAST(3 + n + m + 3 AS BIGINT) AS required"


@query("dense_events", f"WITH {_SQL}, a AS (SELECT k, 0 AS d, * EXCLUDE k FROM e UNION ALL SELECT k, 1, * EXCLUDE k FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d DESC) AS back, row_number() OVER (PARTITION BY k ORDER BY d) - 1 AS place FROM a WHERE bad IS NULL AND k % 11 <> 0 AND 3 + n + m + 3 <= 22) SELECT 'e' || k AS leaf, CAST(place AS INT) AS at, id AS node_uid, CAST(1 AS DOUBLE) AS weight, {_PLACES} FROM r WHERE back <= 2".replace(" AS at,", ' AS "at",'))
def dense_events(spark, sf_dir):
    """Every taught edge, at most two on a path, twenty-two tokens each."""
    return _shown(D.events(_edges(spark, sf_dir), "dense", 2, 22)[0])


_CONTRAST = f"""{_SQL}, g AS (SELECT t, count(*) AS siblings, max(v) AS top, min(v) AS low, stddev_pop(v) AS std, max_by(k, struct_pack(v := v, p := -k)) AS best, sum(w) AS sw, sum(w * v) AS sv FROM e WHERE bad IS NULL GROUP BY t),
b AS (SELECT e.*, siblings, round(top - low, 9) AS gap, best, std, CASE WHEN sw > bw THEN top - (sv - bw * top) / (sw - bw) END AS adv FROM e LEFT JOIN (SELECT g.*, e.w AS bw FROM g JOIN e ON e.k = g.best) g USING (t)),
s AS (SELECT *, CASE WHEN bad IS NOT NULL THEN bad WHEN siblings < 2 THEN 'below_two_queries' WHEN gap < 0.25 THEN 'below_gap' WHEN best <> k THEN 'not_the_best' WHEN NOT coalesce(adv > 0, false) THEN 'below_advantage' WHEN k % 11 = 0 THEN 'no_instruction' ELSE 'event' END AS outcome FROM b)"""


@query("contrast_events", f'WITH {_CONTRAST} SELECT \'e\' || k AS leaf, 0 AS "at", id AS node_uid, round(least(3, adv / greatest(std, 1e-6)) / w, 6) AS weight, {_PLACES} FROM s WHERE outcome = \'event\'')
def contrast_events(spark, sf_dir):
    """The best order of each customer, where it is better than the others by enough."""
    return _shown(D.events(_edges(spark, sf_dir), "contrast", 1, 100, least_gap=0.25 - 1e-9)[0])


@query(
    "event_counters",
    f"""WITH {_CONTRAST}, c AS (SELECT outcome, count(*) AS n FROM s GROUP BY 1 UNION ALL SELECT CASE WHEN bad IS NOT NULL THEN bad ELSE 'below_two_queries' END, count(*) FROM l GROUP BY 1 UNION ALL SELECT 'root', count(*) FROM o)
SELECT outcome, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1 UNION ALL SELECT 'dropped_early', 0""",
)
def event_counters(spark, sf_dir):
    """Why edges on paths are no events."""
    return D.events(_edges(spark, sf_dir), "contrast", 1, 100, least_gap=0.25 - 1e-9)[1]


@query("failure_events", f"WITH {_SQL} SELECT count(*) AS n, count(DISTINCT k) AS leaves FROM (SELECT k, v, bad FROM e UNION ALL SELECT k, v, bad FROM l) WHERE bad IS NULL AND k % 11 <> 0 AND v < CAST(0.8 AS DOUBLE)")
def failure_events(spark, sf_dir):
    """Events of paths that failed."""
    return D.events(_edges(spark, sf_dir), "global_failure", 3, 100)[0].agg(F.count("*").alias("n"), F.countDistinct("leaf").alias("leaves"))


def _codes(c):
    return F.transform(F.split(c, ""), F.ascii)


@query(
    "spliced_rescues",
    """WITH p AS (SELECT p_partkey AS row_idx, length(p_brand) AS np, length(p_name) AS n, length(p_type) AS m, p_partkey % 6 = 0 AS kd, p_size FROM part), w AS (SELECT max(greatest(n, CASE WHEN kd THEN m ELSE 0 END)) AS w FROM p)
SELECT row_idx, w AS width, CASE WHEN kd THEN m ELSE n END AS valid, CASE WHEN kd THEN (m + 1) // 2 ELSE 0 END AS taught, CASE WHEN kd THEN CAST(p_size AS DOUBLE) ELSE CAST(n AS DOUBLE) END AS score, np + CASE WHEN kd THEN m ELSE n END - 1 AS last_position, np + CASE WHEN kd THEN m - m // 3 ELSE n END AS model_tokens, CASE WHEN kd THEN 0 ELSE n END AS credit FROM p, w""",
)
def spliced_rescues(spark, sf_dir):
    """Every sixth part's response replaced by one with another length, a teacher's tokens at every other place and observations at every third."""
    rows = table(spark, sf_dir, "part").withColumn("row_idx", F.col("p_partkey"))
    mine, theirs = _codes("p_name"), _codes("p_type")
    batch = rows.select("row_idx", _codes("p_brand").alias("prompts"), mine.alias("responses"), F.array_repeat(F.lit(1), F.length("p_brand") + F.length("p_name")).alias("info_mask"), F.transform(mine, lambda _: F.lit(1.0)).alias("token_level_scores"), F.transform(mine, lambda _: F.lit(1)).alias("branch_credit_mask"))
    rescued = rows.filter("row_idx % 6 = 0").select("row_idx", theirs.alias("response"), F.transform(theirs, lambda t, i: F.when(i % 3 == 2, 0).otherwise(t)).alias("info"), F.transform(theirs, lambda _: F.lit(1)).alias("turns"), F.transform(theirs, lambda _, i: i % 2 == 0).alias("kd"), F.col("p_size").cast("double").alias("score"))
    got = R.spliced(batch, rescued, 0)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    count = lambda c: F.size(F.filter(c, lambda x: x.cast("int") == 1)).cast("long")
    return got.select("row_idx", F.size("responses").cast("long").alias("width"), F.size(F.filter("responses", lambda t: t != 0)).cast("long").alias("valid"), count("kd").alias("taught"), total("token_level_scores").alias("score"), F.array_max("position_ids").cast("long").alias("last_position"), count("info_mask").alias("model_tokens"), count("branch_credit_mask").alias("credit"))


_PIECE = "1 + CAST('0x' || substr(sha256({uid}), 1, 4) AS INT) % 5"


def _piece(uid, k):
    """One to five tokens, by a hash of the node."""
    n = (F.lit(1) + F.conv(F.substring(F.sha2(uid.cast("binary"), 256), 1, 4), 16, 10).cast("int") % 5).cast("int")
    return F.struct(F.array_repeat(k + 10, n).alias("tokens"), F.array_repeat(F.lit(False), n).alias("kd"))


@query(
    "seeded_forks",
    f"""WITH RECURSIVE t AS (SELECT c_custkey AS tree, length(c_mktsegment) AS a, length(c_name) AS b FROM customer),
n AS (SELECT tree, tree || '-1' AS id, 1 AS depth, a AS len, 0 AS grown, false AS second FROM t UNION ALL SELECT tree, tree || '-2', 2, a + b, 0, true FROM t
  UNION ALL SELECT tree, kid, depth + 1, len + {_PIECE.format(uid='kid')}, grown + 1, second FROM (SELECT n.*, substr(sha256(id || ':' || i), 1, 16) AS kid FROM n, range(2) AS r(i) WHERE grown < 2))
SELECT n.tree, id, len, CASE WHEN second THEN t.a + t.b ELSE t.a END AS taught FROM n JOIN t USING (tree) WHERE grown = 2""",
)
def seeded_forks(spark, sf_dir):
    """Two levels grown from both nodes of each customer's seeded tree: lengths of the leaves and how much of them a teacher wrote."""
    c = table(spark, sf_dir, "customer").withColumn("tree_uid", F.col("c_custkey")).select("tree_uid", "c_mktsegment", "c_name")
    c = R.spread(c, "tree_uid")
    hop = lambda col: F.struct(_codes(col).alias("tokens"), F.transform(_codes(col), lambda _: F.lit(True)).alias("kd"))
    seeds = R.seeded(c, hop("c_mktsegment"), hop("c_name"))
    nodes = R.grown(seeds, 2, 2, _piece)
    plans = c.select("tree_uid", F.concat(F.col("tree_uid").cast("string"), F.lit("-2")).alias("hop2_uid"), hop("c_mktsegment")["kd"].alias("kd1"), hop("c_name")["kd"].alias("kd2"))
    masks = R.leaf_masks(nodes, plans)
    return masks.select(F.col("tree_uid").alias("tree"), F.col("node_uid").alias("id"), F.col("length").cast("long").alias("len"), F.size(F.filter("mask", lambda x: x)).cast("long").alias("taught"))
