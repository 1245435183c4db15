"""Expansion of tree nodes and distillation events, on customer trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import selection as S
from ..operators import trees
from .registry import query
from .relations import NODES, r6, table, tree_nodes

_SHARE = lambda key: f"(CAST('0x' || substr(sha256({key}), 1, 13) AS UBIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE)"
_CANDIDATES = f"""{NODES}, kid AS (SELECT tree_uid, parent_node_uid AS node_uid, count(*) AS children, greatest(0, coalesce(-avg(log_prob_node), 0)) AS uncertainty FROM nodes WHERE parent_node_uid IS NOT NULL GROUP BY ALL),
c AS (SELECT tree_uid, node_uid, depth, children, uncertainty, max(depth) OVER (PARTITION BY tree_uid) AS deepest, CASE depth WHEN 0 THEN CAST(0.23255813953488372 AS DOUBLE) WHEN 1 THEN CAST(0.20754716981132076 AS DOUBLE) ELSE CAST(0.11363636363636363 AS DOUBLE) END AS prior FROM nodes JOIN kid USING (tree_uid, node_uid)),
cand AS (SELECT *, CAST(CASE WHEN depth = 0 THEN 0 WHEN deepest <= 1 THEN 1 ELSE 0.25 + 0.75 * greatest(0, 1 - abs(2.0 * depth / deepest - 1)) END AS DOUBLE) AS preference FROM c),
w AS (SELECT *, CAST(1e-6 AS DOUBLE) + uncertainty + CASE WHEN depth >= 1 THEN 1 ELSE 0 END + 1.0 / (1 + children) + preference AS balanced, CAST(1e-6 AS DOUBLE) + prior * prior AS by_prior FROM cand)"""


def _candidates(spark, sf_dir):
    return S.candidates(tree_nodes(spark, sf_dir), F.col("depth"))


@query("expansion_weights", f"WITH {_CANDIDATES} SELECT node_uid, round(balanced, 6) AS balanced, round(by_prior, 8) AS by_prior, CAST(1 AS DOUBLE) AS equal FROM w")
def expansion_weights(spark, sf_dir):
    got = _candidates(spark, sf_dir)
    return got.select("node_uid", r6(S.weight("uncertainty_balanced"), "balanced"), F.round(S.weight("outcome_prior"), 8).alias("by_prior"), S.weight("random").alias("equal"))


@query(
    "expansion_draws",
    f"""WITH {_CANDIDATES}, cum AS (SELECT *, sum(by_prior) OVER (PARTITION BY tree_uid ORDER BY node_uid) AS hi, sum(by_prior) OVER (PARTITION BY tree_uid) AS total FROM w),
d AS (SELECT tree_uid, i, {_SHARE("'21:' || tree_uid || ':' || i")} AS u FROM (SELECT DISTINCT tree_uid FROM w), unnest([0, 1, 2, 3]) AS t(i)),
met AS (SELECT cum.*, i FROM cum JOIN d USING (tree_uid) WHERE u * total >= hi - by_prior AND u * total < hi)
SELECT tree_uid, count(*) AS selected, count(*) - count(DISTINCT node_uid) AS duplicates, round(avg(depth), 6) AS mean_depth, round(avg(CASE WHEN depth >= 1 THEN 1.0 ELSE 0.0 END), 6) AS after_search, round(avg(uncertainty), 6) AS mean_uncertainty, round(avg(prior), 6) AS mean_prior FROM met GROUP BY tree_uid""",
)
def expansion_draws(spark, sf_dir):
    """Four draws by outcome prior for each tree, with what is kept about them."""
    got = S.selection_stats(S.select(_candidates(spark, sf_dir), "outcome_prior", 4, 21))
    return got.select("tree_uid", "selected", "duplicates", *[F.round(c, 6).alias(c) for c in ("mean_depth", "after_search", "mean_uncertainty", "mean_prior")])


@query("expansion_grouped", f"WITH {_CANDIDATES}, n AS (SELECT tree_uid, count(*) AS n FROM w GROUP BY 1), r AS (SELECT tree_uid, node_uid, row_number() OVER (PARTITION BY tree_uid ORDER BY node_uid) AS i FROM w) SELECT r.tree_uid, node_uid, CAST(d AS INT) AS draw FROM r JOIN n USING (tree_uid), unnest([0, 1, 2]) AS t(d) WHERE i = 1 + floor({_SHARE(chr(39) + '22:' + chr(39) + ' || r.tree_uid || ' + chr(39) + ':0' + chr(39))} * n)")
def expansion_grouped(spark, sf_dir):
    """All draws of a tree on one node."""
    return S.select(_candidates(spark, sf_dir), "grouped_random", 3, 22).select("tree_uid", "node_uid", F.col("draw").cast("int").alias("draw"))


@query("expansion_balanced", f"WITH {_CANDIDATES}, r AS (SELECT tree_uid, node_uid, row_number() OVER (PARTITION BY tree_uid ORDER BY -ln({_SHARE(chr(39) + '23:' + chr(39) + ' || tree_uid || ' + chr(39) + ':' + chr(39) + ' || node_uid')}) / balanced, node_uid) AS i, count(*) OVER (PARTITION BY tree_uid) AS n FROM w) SELECT tree_uid, count(*) AS drawn, count(DISTINCT node_uid) AS nodes FROM r WHERE i <= 2 AND n >= 2 GROUP BY 1")
def expansion_balanced(spark, sf_dir):
    """Two draws without replacement from trees with enough candidates."""
    got = _candidates(spark, sf_dir)
    enough = got.groupBy("tree_uid").count().filter("count >= 2").select("tree_uid")
    return S.select(got.join(enough, "tree_uid"), "uncertainty_balanced", 2, 23).groupBy("tree_uid").agg(F.count("*").alias("drawn"), F.countDistinct("node_uid").alias("nodes"))


_UP = f"{NODES}, leaf AS (SELECT DISTINCT tree_uid, node_uid, parent_node_uid FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM nodes k WHERE k.tree_uid = n.tree_uid AND k.parent_node_uid = n.node_uid))"


@query(
    "leaf_sample_prune",
    f"""WITH {_UP}, s AS (SELECT *, row_number() OVER (PARTITION BY tree_uid ORDER BY substr(sha256('24:' || tree_uid || ':' || node_uid), 1, 13), node_uid) AS i FROM leaf),
kept AS (SELECT tree_uid, node_uid FROM s WHERE i <= 2 UNION SELECT tree_uid, parent_node_uid FROM s WHERE i <= 2 UNION SELECT n.tree_uid, n.parent_node_uid FROM s JOIN nodes n ON n.tree_uid = s.tree_uid AND n.node_uid = s.parent_node_uid WHERE i <= 2)
SELECT tree_uid, count(*) AS n_nodes FROM kept WHERE node_uid IS NOT NULL GROUP BY 1""",
)
def leaf_sample_prune(spark, sf_dir):
    """Trees cut down to two sampled leaves and what leads to them."""
    nodes = trees.known(tree_nodes(spark, sf_dir))
    ends = nodes.filter("leaf").select("tree_uid", "node_uid", "parent_node_uid")
    return trees.above_leaves(nodes, S.drawn_leaves(ends, 2, 24)).groupBy("tree_uid").agg(F.count("*").alias("n_nodes"))


def _kids(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("tree_uid"), F.col("o_custkey").alias("parent_node_uid"), F.col("o_orderkey").alias("node_uid"), F.round(F.col("o_totalprice") % 1, 2).alias("node_value"), (F.col("o_orderkey") % 5).alias("leaf_count"), F.col("o_orderkey").alias("place"))
    return orders


@query(
    "sibling_events",
    """WITH k AS (SELECT o_custkey AS t, o_orderkey AS id, round(o_totalprice % 1, 2) AS v, greatest(1, o_orderkey % 5) AS n FROM orders),
g AS (SELECT t, count(*) AS siblings, max(v) AS top, min(v) AS low, max_by(id, struct_pack(v := v, p := -id)) AS target, sum(n) AS sn, sum(n * v) AS sv FROM k GROUP BY t),
e AS (SELECT g.*, top - low AS gap, CASE WHEN sn > n THEN top - (sv - n * top) / (sn - n) END AS adv FROM g JOIN k ON k.id = target)
SELECT t AS parent, target, siblings, round(gap, 6) AS value_gap, round(adv, 6) AS raw_advantage, CASE WHEN siblings < 2 THEN 'below_two_queries' WHEN round(gap, 9) < 0.5 THEN 'below_gap' WHEN round(adv, 9) <= 0.1 THEN 'below_advantage' ELSE 'event' END AS outcome FROM e""",
)
def sibling_events(spark, sf_dir):
    """The best order of each customer against the others, weighted by leaves; or why it is no event."""
    got = S.sibling_events(_kids(spark, sf_dir), 0.5 - 1e-9, 0.1 + 1e-9)
    return got.select(F.col("parent_node_uid").alias("parent"), "target", "siblings", F.round("value_gap", 6).alias("value_gap"), F.round("raw_advantage", 6).alias("raw_advantage"), "outcome")


@query(
    "path_events",
    f"""WITH {_UP}, e AS (SELECT DISTINCT tree_uid, node_uid, round(coalesce(score, 0), 4) AS adv, depth FROM nodes WHERE depth >= 1 AND node_uid LIKE 'o%'),
p AS (SELECT tree_uid, node_uid AS leaf, node_uid, 0 AS steps FROM leaf UNION ALL SELECT tree_uid, node_uid, parent_node_uid, 1 FROM leaf)
SELECT leaf, p.node_uid, steps, round(least(1.0, adv / 0.25) / 3, 6) AS weight FROM p JOIN e ON e.tree_uid = p.tree_uid AND e.node_uid = p.node_uid""",
)
def path_events(spark, sf_dir):
    """The last event on each leaf's path, with its weight."""
    nodes = tree_nodes(spark, sf_dir)
    events = nodes.filter("depth = 1").select("tree_uid", "node_uid", F.round(F.coalesce("score", F.lit(0.0)), 4).alias("raw_advantage"), F.lit(0.25).alias("deviation"), F.lit(3).alias("leaf_count"))
    return S.path_events(nodes, events, 1).select("leaf", "node_uid", "steps", F.round("weight", 6).alias("weight"))


def _codes(c):
    return F.transform(F.split(c, ""), F.ascii)


_CODES = lambda c: f"[ascii(x) for x in string_split({c}, '')]"


@query(
    "anchored_prefixes",
    f"""WITH t AS (SELECT p_partkey, p_size - 2 AS b, {_CODES('p_brand')} AS p, {_CODES('p_name')} AS s FROM part),
k AS (SELECT p_partkey, b, p, s, CASE WHEN b <= 0 THEN [] WHEN len(p) >= b THEN p[len(p) - b + 1 :] ELSE list_concat(p, s[greatest(1, len(s) - (b - len(p)) + 1) :]) END AS kept FROM t)
SELECT p_partkey, array_to_string(kept, ' ') AS tokens, b <= 0 OR len(p) + len(s) > b AS truncated, round(CASE WHEN b <= 0 THEN 0 WHEN len(p) >= b THEN b / len(p) ELSE 1 END, 6) AS retained FROM k""",
)
def anchored_prefixes(spark, sf_dir):
    """Prompt and newest state within budgets from -1 to 48 tokens; every other state begins with the prompt."""
    prompt, more = _codes("p_brand"), _codes("p_name")
    state = F.when(F.col("p_partkey") % 2 == 0, F.concat(prompt, more)).otherwise(more)
    rows = table(spark, sf_dir, "part").select("p_partkey", prompt.alias("p"), state.alias("s"), (F.col("p_size") - 2).cast("int").alias("b"))
    got = rows.withColumn("a", S.anchored_prefix(F.col("p"), F.col("s"), F.col("b")))
    return got.select("p_partkey", F.array_join("a.tokens", " ").alias("tokens"), "a.truncated", F.round("a.prompt_retained", 6).alias("retained"))


@query("token_spans", "SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN instr(p_name, split_part(p_name, ' ', 2)) - 1 END AS start FROM part")
def token_spans(spark, sf_dir):
    """Where a word's tokens begin within the name's."""
    word = F.when(F.col("p_partkey") % 3 > 0, F.element_at(F.split("p_name", " "), 2)).otherwise("@@")
    rows = table(spark, sf_dir, "part").select("p_partkey", _codes("p_name").alias("t"), _codes(word).alias("w"))
    return rows.select("p_partkey", S.token_span(F.col("t"), F.col("w")).cast("long").alias("start"))


@query("rescue_replacement", "SELECT doc_id AS row_idx, CASE WHEN doc_id % 7 = 0 AND doc_id % 2 = 0 THEN 'zz' ELSE lang END AS lang, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE n_chars END AS n_chars, doc_id % 7 = 0 AS kd FROM documents")
def rescue_replacement(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), "lang", "n_chars")
    rescued = rows.filter("row_idx % 7 = 0").select("row_idx", F.when(F.col("row_idx") % 2 == 0, "zz").alias("lang"))
    return S.replaced(rows, rescued, ["lang"], ["n_chars"])


@query("leaf_kd_masks", "SELECT p_partkey, p_size AS n, len(list_filter((CASE WHEN p_partkey % 2 = 0 THEN [1, 0, 1, 1, 0, 1] ELSE [1, 0, 1] END)[1 : p_size], lambda x: x = 1)) AS taught FROM part")
def leaf_kd_masks(spark, sf_dir):
    flags = lambda *xs: F.array(*[F.lit(bool(x)) for x in xs])
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("n"), S.leaf_kd_mask(F.col("p_size").cast("int"), flags(1, 0, 1), flags(1, 0, 1), F.col("p_partkey") % 2 == 0).alias("m"))
    return rows.select("p_partkey", "n", F.size(F.filter("m", lambda x: x)).cast("long").alias("taught"))


@query("stats_once", "SELECT l_orderkey, count(*) AS n, round(sum(CASE WHEN i = 1 THEN l_quantity ELSE 0 END), 4) AS counted FROM (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem) GROUP BY 1")
def stats_once(spark, sf_dir):
    """A tree's statistic on its first leaf row alone."""
    rows = S.on_first_row(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_quantity")
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("counted"))


@query(
    "path_token_lengths",
    f"""WITH {_UP}, p AS (SELECT tree_uid, node_uid AS leaf, node_uid, 0 AS steps FROM leaf UNION ALL SELECT l.tree_uid, l.node_uid, l.parent_node_uid, 1 FROM leaf l JOIN nodes n ON n.tree_uid = l.tree_uid AND n.node_uid = l.parent_node_uid WHERE n.parent_node_uid IS NOT NULL)
SELECT leaf, node_uid, CAST(sum(length(node_uid)) OVER w - length(node_uid) AS BIGINT) AS start, CAST(sum(length(node_uid)) OVER w AS BIGINT) AS stop FROM p WINDOW w AS (PARTITION BY tree_uid, leaf ORDER BY steps DESC)""",
)
def path_token_lengths(spark, sf_dir):
    """Token intervals of edges on each leaf's path; a node adds as many tokens as its name has letters."""
    got = S.path_intervals(tree_nodes(spark, sf_dir), F.length("node_uid"))
    return got.select("leaf", "node_uid", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))
