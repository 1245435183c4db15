"""Joins, set operations and contracts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import curate as C
from ..sources import io
from .registry import query
from .relations import table


@query("semi_join_ids", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey")
def semi_join_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey").join(ids, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("anti_join_exclusion", "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join_exclusion(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(done, "o_orderkey", "left_anti")


@query("first_metadata_wins", "WITH m AS (SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) SELECT c_custkey, o_orderkey, o_orderpriority FROM customer JOIN m ON c_custkey = o_custkey")
def first_metadata_wins(spark, sf_dir):
    meta = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(F.struct("o_orderkey", "o_orderpriority")).alias("m"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(meta, "c_custkey").select("c_custkey", "m.*")


@query("split_leakage", "SELECT count(DISTINCT a.o_custkey) AS leaked FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey WHERE a.o_orderkey % 2 = 0 AND b.o_orderkey % 2 = 1")
def split_leakage(spark, sf_dir):
    """Customers on both sides of a split by order number."""
    orders = table(spark, sf_dir, "orders")
    train, val = (orders.filter(F.col("o_orderkey") % 2 == i).select("o_custkey") for i in (0, 1))
    return train.intersect(val).agg(F.count("*").alias("leaked"))


@query("metadata_chain", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, c_mktsegment, n_name, r_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def metadata_chain(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    got = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    got = got.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return got.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "c_mktsegment", "n_name", "r_name")


@query("paired_arms", "SELECT c_custkey, coalesce(bool_or(o_orderpriority = '1-URGENT'), false) AS urgent, coalesce(bool_or(o_orderpriority = '5-LOW'), false) AS low FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def paired_arms(spark, sf_dir):
    """Two arms by uid; a missing one counts as false."""
    arms = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.bool_or(F.col("o_orderpriority") == "5-LOW").alias("low"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(arms, "c_custkey", "left").fillna(False, ["urgent", "low"])


@query("arms_long_to_wide", "SELECT user_id, round(coalesce(sum(value) FILTER (event_type = 'click'), 0), 4) AS click, round(coalesce(sum(value) FILTER (event_type = 'view'), 0), 4) AS view FROM events GROUP BY user_id")
def arms_long_to_wide(spark, sf_dir):
    """Events by user and arm, wide; a missing arm scores zero, not nothing."""
    wide = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.sum("value"))
    return wide.fillna(0.0).select("user_id", *[(F.round(c, 4)).alias(c) for c in ("click", "view")])


@query("query_cache", "WITH q AS (SELECT DISTINCT p_brand FROM part), c AS (SELECT p_brand, sha256(p_brand) AS answer FROM q) SELECT p_partkey, answer FROM part JOIN c USING (p_brand)")
def query_cache(spark, sf_dir):
    """Distinct queries are answered once and the answers given back to all rows."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    answers = parts.select("p_brand").distinct().withColumn("answer", F.sha2(F.col("p_brand").cast("binary"), 256))
    return parts.join(answers, "p_brand").select("p_partkey", "answer")


@query("cache_merge", "SELECT coalesce(b.k, a.k) AS k, coalesce(b.v, a.v) AS v FROM (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE o_orderkey % 3 < 2 GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, -max(o_orderkey) AS v FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1) b ON a.k = b.k")
def cache_merge(spark, sf_dir):
    """Two key-value caches in one; the right one wins."""
    orders = table(spark, sf_dir, "orders")
    a = orders.filter("o_orderkey % 3 < 2").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("v"))
    b = orders.filter("o_orderkey % 3 > 0").groupBy(F.col("o_custkey").alias("k")).agg((-F.max("o_orderkey")).alias("v"))
    return io.merge_cache(a, b, "k", "v")


_OTHER = "substr(sha256(a.n_name || b.n_name), 1, 16)"


@query("shuffled_control", f"SELECT a.n_nationkey, b.n_name AS control FROM nation a JOIN nation b ON a.n_regionkey <> b.n_regionkey QUALIFY row_number() OVER (PARTITION BY a.n_nationkey ORDER BY {_OTHER}, b.n_name) = 1")
def shuffled_control(spark, sf_dir):
    """For each row a drawn row of a different group; nation is a fixed table of 25 rows."""
    nation = table(spark, sf_dir, "nation")
    a, b = nation.alias("a"), nation.alias("b")
    d = F.substring(F.sha2(F.concat("a.n_name", "b.n_name").cast("binary"), 256), 1, 16)
    met = a.join(F.broadcast(b), F.col("a.n_regionkey") != F.col("b.n_regionkey")).select(F.col("a.n_nationkey").alias("n_nationkey"), F.col("b.n_name").alias("control"), d.alias("d"))
    return C.first_per_key(met, ["n_nationkey"], ["d", "control"]).select("n_nationkey", "control")


@query("set_contract", "WITH e AS (SELECT c_custkey, s FROM customer, (SELECT unnest(['F', 'O', 'P']) AS s)), h AS (SELECT DISTINCT o_custkey, o_orderstatus FROM orders) SELECT c_custkey, s AS missing FROM e WHERE NOT EXISTS (SELECT 1 FROM h WHERE o_custkey = c_custkey AND o_orderstatus = s)")
def set_contract(spark, sf_dir):
    """What is missing from customers times order states."""
    expected = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(*map(F.lit, "FOP"))).alias("missing"))
    have = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("missing")).distinct()
    return expected.join(have, ["c_custkey", "missing"], "left_anti")


@query("ordered_fetch", "SELECT i.at, p_partkey, p_name FROM (SELECT CAST(unnest([5, 3, 11, 2]) AS BIGINT) AS k, CAST(unnest([0, 1, 2, 3]) AS INT) AS at) i JOIN part ON p_partkey = k")
def ordered_fetch(spark, sf_dir):
    """Rows of a list of ids, with their places in it."""
    ids = spark.range(1).select(F.posexplode(F.array(*[F.lit(x).cast("long") for x in (5, 3, 11, 2)])).alias("at", "k"))
    return table(spark, sf_dir, "part").join(F.broadcast(ids), F.col("p_partkey") == F.col("k")).select("at", "p_partkey", "p_name")


@query("sole_pending_match", "WITH c AS (SELECT l_orderkey AS turn, l_suppkey AS call, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem), o AS (SELECT o_orderkey AS turn, o_custkey % 100 AS call FROM orders) SELECT o.turn, CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.turn = o.turn AND c.call = o.call) THEN 'matched' WHEN EXISTS (SELECT 1 FROM c WHERE c.turn = o.turn AND c.n = 1) THEN 'sole_pending' ELSE 'orphan' END AS outcome FROM o")
def sole_pending_match(spark, sf_dir):
    """Observations meet calls by turn and call id; failing that, the only call of the turn; else they are orphans."""
    calls = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("t")).agg(F.collect_set("l_suppkey").alias("calls"), F.count("*").alias("n"))
    seen = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("turn"), (F.col("o_custkey") % 100).alias("call"))
    got = seen.join(calls, F.col("turn") == F.col("t"), "left")
    return got.select("turn", F.when(F.array_contains("calls", F.col("call")), "matched").when(F.col("n") == 1, "sole_pending").otherwise("orphan").alias("outcome"))


@query("row_aligned_union", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def row_aligned_union(spark, sf_dir):
    """Columns of two views of the same rows; the one they share must agree."""
    orders = table(spark, sf_dir, "orders")
    return C.union_checked(orders.select("o_orderkey", "o_custkey", "o_orderstatus"), orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("remaining_gold", "WITH p AS (SELECT l_orderkey, list_distinct(list(l_suppkey % 10)) AS gold FROM lineitem GROUP BY 1), q AS (SELECT o_orderkey, [o_custkey % 10, o_orderkey % 10] AS got FROM orders) SELECT l_orderkey, len(list_intersect(gold, got)) AS n_hit, len(list_filter(gold, lambda g: NOT list_contains(got, g))) AS n_left FROM p JOIN q ON l_orderkey = o_orderkey")
def remaining_gold(spark, sf_dir):
    gold = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey") % 10).alias("gold"))
    got = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.array(F.col("o_custkey") % 10, F.col("o_orderkey") % 10).alias("got"))
    return gold.join(got, "l_orderkey").select("l_orderkey", F.size(F.array_intersect("gold", "got")).cast("long").alias("n_hit"), F.size(F.array_except("gold", "got")).cast("long").alias("n_left"))


@query("next_hop_hits", "WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), f AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY i) AS occurrence FROM e) SELECT user_id, CAST(sum(CASE WHEN occurrence = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_new, count(*) AS n FROM f GROUP BY user_id")
def next_hop_hits(spark, sf_dir):
    """Steps of each user that bring something not seen before on the way."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", (F.row_number().over(w) == 1).alias("new"))
    return e.groupBy("user_id").agg(F.count_if("new").alias("n_new"), F.count("*").alias("n"))
