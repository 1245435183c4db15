"""Tree operators on customer trees (customer, orders, lines)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import trees
from .registry import query
from .relations import NODES, r6, table, tree_nodes

#: The same closure in SQL, recursively.
_CLOSURE = f"""RECURSIVE {NODES},
closure AS (
  SELECT tree_uid, node_uid AS ancestor, node_uid, 0 AS steps FROM nodes
  UNION ALL SELECT c.tree_uid, n.parent_node_uid, c.node_uid, c.steps + 1 FROM closure c JOIN nodes n ON n.tree_uid = c.tree_uid AND n.node_uid = c.ancestor WHERE n.parent_node_uid IS NOT NULL),
leaf AS (SELECT * FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM nodes k WHERE k.tree_uid = n.tree_uid AND k.parent_node_uid = n.node_uid)),
vals AS (SELECT c.tree_uid, c.ancestor AS node_uid, count(*) AS leaf_count, sum(coalesce(l.score, 0)) AS leaf_sum, avg(coalesce(l.score, 0)) AS node_value, avg(CASE WHEN coalesce(l.score, 0) >= CAST(0.5 AS DOUBLE) THEN 1.0 ELSE 0.0 END) AS correct_value
  FROM closure c JOIN leaf l ON l.tree_uid = c.tree_uid AND l.node_uid = c.node_uid GROUP BY ALL)"""


@query("tree_closure", f"WITH {_CLOSURE} SELECT ancestor, count(*) - 1 AS n_descendants, max(steps) AS height FROM closure GROUP BY tree_uid, ancestor")
def tree_closure(spark, sf_dir):
    got = trees.closure(tree_nodes(spark, sf_dir))
    return got.groupBy("tree_uid", "ancestor").agg((F.count("*") - 1).alias("n_descendants"), F.max("steps").alias("height")).drop("tree_uid")


@query("tree_node_values", f"WITH {_CLOSURE} SELECT node_uid, leaf_count, round(leaf_sum, 6) + 0.0 AS leaf_sum, round(node_value, 10) + 0.0 AS node_value, round(correct_value, 10) + 0.0 AS correct_value FROM vals")
def tree_node_values(spark, sf_dir):
    got = trees.node_values(tree_nodes(spark, sf_dir), also={"correct_value": 0.5})
    return got.select("node_uid", "leaf_count", r6(F.col("leaf_sum"), "leaf_sum"), *[(F.round(c, 10) + F.lit(0.0)).alias(c) for c in ("node_value", "correct_value")])


_CREDIT = f"""{_CLOSURE}, edge AS (SELECT n.tree_uid, n.parent_node_uid, n.node_uid, v.leaf_count, v.node_value FROM nodes n JOIN vals v ON v.tree_uid = n.tree_uid AND v.node_uid = n.node_uid WHERE n.parent_node_uid IS NOT NULL),
other AS (SELECT *, count(*) OVER w AS siblings, stddev_pop(node_value) OVER w AS deviation,
  CASE WHEN count(*) OVER w > 1 THEN (sum(leaf_count * node_value) OVER w - leaf_count * node_value) / (sum(leaf_count) OVER w - leaf_count) ELSE node_value END AS baseline
  FROM edge WINDOW w AS (PARTITION BY tree_uid, parent_node_uid)),
scaled AS (SELECT *, CASE WHEN siblings > 1 THEN node_value - baseline ELSE 0 END AS credit_raw, CASE WHEN siblings > 1 AND deviation > 1e-6 THEN (node_value - baseline) / (deviation + 1e-6) ELSE 0 END AS s FROM other),
credit AS (SELECT *, greatest(-3, least(3, s)) AS credit, abs(s) > 3 AS clipped FROM scaled)"""


def _credit(spark, sf_dir):
    return trees.sibling_credit(trees.edges(trees.node_values(tree_nodes(spark, sf_dir))))


@query("sibling_credit", f"WITH {_CREDIT} SELECT node_uid, siblings, round(baseline, 8) + 0.0 AS baseline, round(credit_raw, 8) + 0.0 AS credit_raw, round(credit, 4) + 0.0 AS credit FROM credit")
def sibling_credit(spark, sf_dir):
    got = _credit(spark, sf_dir)
    at = lambda c, d: (F.round(c, d) + F.lit(0.0)).alias(c)
    return got.select("node_uid", "siblings", at("baseline", 8), at("credit_raw", 8), at("credit", 4))


@query(
    "edge_statistics",
    f"""WITH {_CREDIT} SELECT tree_uid, count(*) AS edges, count(*) FILTER (siblings > 1) AS with_siblings, count(*) FILTER (siblings = 1) AS without_siblings, count(*) FILTER (clipped) AS clipped,
  count(DISTINCT CASE WHEN siblings > 1 AND deviation <= 1e-6 THEN parent_node_uid END) AS zero_variance_parents, round(count(*) FILTER (siblings > 1) / count(*), 6) AS fraction_with_siblings FROM credit GROUP BY tree_uid""",
)
def edge_statistics(spark, sf_dir):
    got = _credit(spark, sf_dir).groupBy("tree_uid")
    return got.agg(
        F.count("*").alias("edges"),
        F.count_if(F.col("siblings") > 1).alias("with_siblings"),
        F.count_if(F.col("siblings") == 1).alias("without_siblings"),
        F.count_if("clipped").alias("clipped"),
        F.countDistinct(F.when((F.col("siblings") > 1) & (F.col("deviation") <= 1e-6), F.col("parent_node_uid"))).alias("zero_variance_parents"),
        r6(F.count_if(F.col("siblings") > 1) / F.count("*"), "fraction_with_siblings"),
    )


@query(
    "credit_distribution",
    f"""WITH {_CREDIT} SELECT round(avg(credit), 5) + 0.0 AS mean, round(stddev_pop(credit), 5) AS std, round(avg(CAST(credit > 1e-9 AS INT)), 6) AS positive, round(avg(CAST(credit < -1e-9 AS INT)), 6) AS negative, round(sqrt(sum(credit * credit)), 3) AS l2 FROM credit""",
)
def credit_distribution(spark, sf_dir):
    x = F.col("credit")
    at = lambda c, d, n: (F.round(c, d) + F.lit(0.0)).alias(n)
    return _credit(spark, sf_dir).agg(at(F.avg(x), 5, "mean"), at(F.stddev_pop(x), 5, "std"), r6(F.avg((x > 1e-9).cast("int")), "positive"), r6(F.avg((x < -1e-9).cast("int")), "negative"), at(F.sqrt(F.sum(x * x)), 3, "l2"))


_SEGMENT = """WITH leaf AS (SELECT l_orderkey AS node, count(*) AS n, avg(CASE WHEN l_discount >= CAST(0.05 AS DOUBLE) THEN 1.0 ELSE 0.0 END) AS v FROM lineitem GROUP BY l_orderkey),
edge AS (SELECT o_custkey AS tree, node, n, v, count(*) OVER w AS siblings, stddev_pop(v) OVER w AS deviation, sum(n) OVER w - n AS others, sum(n * v) OVER w - n * v AS rest FROM leaf JOIN orders ON node = o_orderkey WINDOW w AS (PARTITION BY o_custkey)),
credit AS (SELECT *, CASE WHEN siblings > 1 AND deviation > 1e-6 THEN greatest(-3, least(3, (v - rest / others) / (deviation + 1e-6))) ELSE 0 END AS c FROM edge)
SELECT c_mktsegment AS segment, count(*) AS edges, count(*) FILTER (siblings = 1) AS only_children, round(avg(abs(c)), 5) AS mean_abs_credit, round(avg(CAST(c > 1e-9 AS INT)), 6) AS positive FROM credit JOIN customer ON tree = c_custkey GROUP BY c_mktsegment"""


@query("credit_by_segment", _SEGMENT)
def credit_by_segment(spark, sf_dir):
    """Sibling-counterfactual credit of every order within its customer, summarised by market segment."""
    values = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("leaf_count"), F.avg((F.col("l_discount") >= F.lit(0.05)).cast("double")).alias("node_value"))
    edges = values.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").select(F.col("o_custkey").alias("tree_uid"), F.col("o_custkey").alias("parent_node_uid"), F.col("o_orderkey").alias("node_uid"), "leaf_count", "node_value")
    credit = trees.sibling_credit(edges).join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("tree_uid") == F.col("c_custkey"))
    return credit.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("edges"), F.count_if(F.col("siblings") == 1).alias("only_children"), F.round(F.avg(F.abs("credit")), 5).alias("mean_abs_credit"), r6(F.avg((F.col("credit") > 1e-9).cast("int")), "positive"))


@query(
    "tree_diff",
    f"""WITH {_CLOSURE} SELECT n.node_uid, round((greatest(v.node_value - p.node_value, 0) + v.node_value) / sqrt(v.leaf_count), 8) + 0.0 AS diff
FROM nodes n JOIN vals v ON v.tree_uid = n.tree_uid AND v.node_uid = n.node_uid JOIN vals p ON p.tree_uid = n.tree_uid AND p.node_uid = n.parent_node_uid""",
)
def tree_diff(spark, sf_dir):
    return trees.tree_diff(tree_nodes(spark, sf_dir)).select("node_uid", (F.round("diff", 8) + F.lit(0.0)).alias("diff"))


@query("tree_prune", f"WITH {_CLOSURE} SELECT DISTINCT c.ancestor AS node_uid FROM closure c JOIN leaf l ON l.tree_uid = c.tree_uid AND l.node_uid = c.node_uid WHERE l.score >= CAST(0.95 AS DOUBLE)")
def tree_prune(spark, sf_dir):
    """Nodes left when the leaves of the highest reward are selected."""
    nodes = tree_nodes(spark, sf_dir)
    return trees.prune(nodes, trees.leaves(nodes).filter("score >= 0.95D")).select("node_uid")


@query(
    "expansion_candidates",
    f"""WITH {NODES}, u AS (SELECT tree_uid, parent_node_uid AS node_uid, greatest(0, coalesce(-avg(log_prob_node), 0)) AS uncertainty FROM nodes WHERE parent_node_uid IS NOT NULL GROUP BY ALL),
d AS (SELECT tree_uid, max(depth) AS deepest FROM nodes JOIN u USING (tree_uid, node_uid) GROUP BY tree_uid)
SELECT n.node_uid, round(uncertainty, 6) + 0.0 AS uncertainty, CAST(CASE WHEN depth = 0 THEN 0 WHEN deepest <= 1 THEN 1 ELSE 0.25 + 0.75 * greatest(0, 1 - abs(2.0 * depth / deepest - 1)) END AS DOUBLE) AS preference,
  CASE WHEN depth = 0 THEN 'root' WHEN depth = 1 THEN 'after_search_depth1' ELSE 'after_search_depth2' END AS bucket, CASE WHEN depth = 0 THEN CAST(0.23255813953488372 AS DOUBLE) WHEN depth = 1 THEN CAST(0.20754716981132076 AS DOUBLE) ELSE CAST(0.11363636363636363 AS DOUBLE) END AS prior
FROM nodes n JOIN u USING (tree_uid, node_uid) JOIN d USING (tree_uid)""",
)
def expansion_candidates(spark, sf_dir):
    """Nodes that may be expanded (all but leaves) with the parts of their selection weight."""
    nodes = tree_nodes(spark, sf_dir)
    deepest = F.max("depth").over(Window.partitionBy("tree_uid"))
    got = nodes.join(trees.uncertainty(nodes), ["tree_uid", "node_uid"]).withColumn("deepest", deepest)
    bucket = F.when(F.col("depth") == 0, "root").when(F.col("depth") == 1, "after_search_depth1").otherwise("after_search_depth2")
    # Calibrated outcome priors by bucket.
    prior = F.when(F.col("depth") == 0, F.lit(0.23255813953488372)).when(F.col("depth") == 1, F.lit(0.20754716981132076)).otherwise(F.lit(0.11363636363636363))
    return got.select("node_uid", r6(F.col("uncertainty"), "uncertainty"), r6(trees.depth_preference(F.col("depth"), F.col("deepest")), "preference"), bucket.alias("bucket"), prior.alias("prior"))


@query(
    "sibling_contrasts",
    f"""WITH {_CLOSURE}, k AS (SELECT n.tree_uid, n.parent_node_uid, n.node_uid, v.node_value AS value FROM nodes n JOIN vals v ON v.tree_uid = n.tree_uid AND v.node_uid = n.node_uid WHERE n.parent_node_uid IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY tree_uid, parent_node_uid ORDER BY round(value, 9), node_uid) AS lo, row_number() OVER (PARTITION BY tree_uid, parent_node_uid ORDER BY round(value, 9) DESC, node_uid DESC) AS hi, count(*) OVER (PARTITION BY tree_uid, parent_node_uid) AS n FROM k)
SELECT a.parent_node_uid, a.node_uid AS worst, b.node_uid AS best, round(b.value - a.value, 6) AS gap FROM r a JOIN r b ON a.tree_uid = b.tree_uid AND a.parent_node_uid = b.parent_node_uid
WHERE a.lo = 1 AND b.hi = 1 AND a.n > 1 AND round(b.value, 9) - round(a.value, 9) >= CAST(0.25 AS DOUBLE)""",
)
def sibling_contrasts(spark, sf_dir):
    values = trees.node_values(tree_nodes(spark, sf_dir)).withColumn("node_value", F.round("node_value", 9))
    return trees.value_contrasts(values, 0.25).select("parent_node_uid", F.col("worst.node_uid").alias("worst"), F.col("best.node_uid").alias("best"), r6(F.col("best.value") - F.col("worst.value"), "gap"))


@query("tree_integrity", f"WITH {NODES} SELECT count(*) AS n_nodes, count(*) FILTER (node_uid = parent_node_uid) AS self_children, count(*) - count(DISTINCT (tree_uid, node_uid)) AS repeated, count(*) FILTER (parent_node_uid IS NULL) AS roots FROM nodes")
def tree_integrity(spark, sf_dir):
    nodes = tree_nodes(spark, sf_dir)
    return nodes.agg(F.count("*").alias("n_nodes"), F.count_if(F.col("node_uid") == F.col("parent_node_uid")).alias("self_children"), (F.count("*") - F.countDistinct("tree_uid", "node_uid")).alias("repeated"), F.count_if(F.col("parent_node_uid").isNull()).alias("roots"))


@query("tree_snapshot", f"WITH {NODES} SELECT tree_uid, count(*) AS n_nodes, max(depth) AS deepest, string_agg(node_uid, ',' ORDER BY depth, node_uid) AS nodes FROM nodes GROUP BY tree_uid")
def tree_snapshot(spark, sf_dir):
    """Trees nested again, nodes by depth."""
    got = tree_nodes(spark, sf_dir).groupBy("tree_uid").agg(F.count("*").alias("n_nodes"), F.max("depth").alias("deepest"), F.array_sort(F.collect_list(F.struct("depth", "node_uid"))).alias("x"))
    return got.select("tree_uid", "n_nodes", "deepest", F.array_join("x.node_uid", ",").alias("nodes"))


@query(
    "path_token_intervals",
    f"""WITH {_CREDIT}, path AS (SELECT c.tree_uid, c.node_uid AS leaf, c.steps, k.node_uid, k.credit FROM closure c JOIN leaf l ON l.tree_uid = c.tree_uid AND l.node_uid = c.node_uid JOIN credit k ON k.tree_uid = c.tree_uid AND k.node_uid = c.ancestor)
SELECT leaf, node_uid, (row_number() OVER w - 1) * 10 AS start, row_number() OVER w * 10 AS stop, round(credit, 4) + 0.0 AS credit FROM path WINDOW w AS (PARTITION BY tree_uid, leaf ORDER BY steps DESC)""",
)
def path_token_intervals(spark, sf_dir):
    """Credit of each edge of each root-to-leaf path over the tokens of that edge (ten each); the root has none."""
    ends = trees.credited_paths(tree_nodes(spark, sf_dir))
    entry = lambda uid, times, x: F.struct(uid.alias("node_uid"), x["credit"].alias("credit"), (times * x["rows"]).alias("times"))
    own = entry(F.col("node_uid"), F.lit(1).cast("long"), {"credit": F.col("credit"), "rows": F.col("rows")})
    way = F.reverse(F.concat(F.array(own), F.zip_with("path", "along", lambda p, a: entry(p["uid"], p["times"], a))))
    # A uid in several rows counts as in a join of rows; the root has no edge.
    rows = F.flatten(F.transform(F.filter(way, lambda x: x["times"].isNotNull()), lambda x: F.array_repeat(x, (x["times"] * F.col("rows") * F.col("rows")).cast("int"))))
    got = ends.select(F.col("node_uid").alias("leaf"), F.posexplode(rows).alias("at", "x"))
    return got.select("leaf", "x.node_uid", (F.col("at") * 10).cast("long").alias("start"), ((F.col("at") + 1) * 10).cast("long").alias("stop"), (F.round("x.credit", 4) + F.lit(0.0)).alias("credit"))
