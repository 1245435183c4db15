"""De-duplication, splits and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import balance as balancing
from ..operators import batching
from ..operators import curate as C
from .registry import query
from .relations import r6, table


def _draw(seed, *key):
    return f"substr(sha256('{seed}:' || " + " || ':' || ".join(key) + "), 1, 13)"


@query("first_appearance", "SELECT doc_id, sha256(text) AS text_sha FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def first_appearance(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha"))
    return docs.groupBy("text_sha").agg(F.min("doc_id").alias("doc_id"))


@query("last_wins", "SELECT user_id, max_by(event_id, struct_pack(ts := ts, e := event_id)) AS event_id, count(*) AS n FROM events GROUP BY user_id")
def last_wins(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("n"))


@query("max_gap_per_event", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) = 1")
def max_gap_per_event(spark, sf_dir):
    """The row with the larger gap of each event; the first of equals."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return C.first_per_key(lines, ["l_orderkey"], [F.desc("l_quantity"), "l_linenumber", "l_partkey", "l_suppkey"])


@query("latest_complete_group", "WITH g AS (SELECT o_custkey, o_orderpriority, max(o_orderkey) AS step, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY ALL) SELECT o_custkey, o_orderpriority, step FROM g WHERE n >= 2 AND top < 400000 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY step DESC) = 1")
def latest_complete_group(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.max("o_orderkey").alias("step"), F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    return C.first_per_key(g.filter("n >= 2 and top < 400000"), ["o_custkey"], [F.desc("step")]).select("o_custkey", "o_orderpriority", "step")


@query("earliest_capped", "WITH q AS (SELECT o_orderpriority AS source, o_custkey AS question, min(o_orderkey) AS sample FROM orders GROUP BY ALL) SELECT source, question, sample FROM q QUALIFY row_number() OVER (PARTITION BY source ORDER BY sample) <= 50")
def earliest_capped(spark, sf_dir):
    """The earliest sample of each question, up to 50 questions a source."""
    q = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("source"), F.col("o_custkey").alias("question")).agg(F.min("o_orderkey").alias("sample"))
    return C.ranked(q, ["source"], ["sample"], "at").filter("at <= 50").drop("at")


@query("mixture_sample", f"SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {_draw(3, 'doc_id')}, doc_id) <= CASE lang WHEN 'en' THEN 40 WHEN 'fr' THEN 40 ELSE 20 END")
def mixture_sample(spark, sf_dir):
    """A seeded draw of 40, 40, 20 and 20 documents of the languages."""
    n = F.when(F.col("lang").isin("en", "fr"), 40).otherwise(20)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").withColumn("d", C.draw(3, "doc_id"))
    return C.ranked(docs, ["lang"], ["d", "doc_id"], "at").filter(F.col("at") <= n).select("doc_id", "lang")


@query("balanced_sample", f"SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {_draw(11, 'doc_id')}, doc_id) <= 5")
def balanced_sample(spark, sf_dir):
    return C.sample_per_group(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", ["doc_id"], 5, 11)


@query("group_split", f"WITH g AS (SELECT DISTINCT o_custkey FROM orders), r AS (SELECT o_custkey, row_number() OVER (ORDER BY {_draw(5, 'o_custkey')}, o_custkey) AS place, count(*) OVER () AS n FROM g) SELECT o_orderkey, CASE WHEN place <= greatest(1, least(n - 1, round_even(n * 0.1, 0))) THEN 'val' ELSE 'train' END AS split FROM orders JOIN r USING (o_custkey)")
def group_split(spark, sf_dir):
    return C.split_by_group(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 0.1, 5).select("o_orderkey", "split")


@query(
    "stratified_split",
    f"""WITH s AS (SELECT o_orderpriority AS st, count(*) AS n, count(*) * 0.07 AS share FROM orders GROUP BY ALL),
q AS (SELECT st, floor(share) + CASE WHEN row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, st) <= round_even((SELECT sum(n) FROM s) * 0.07, 0) - (SELECT sum(floor(share)) FROM s) THEN 1 ELSE 0 END AS quota FROM s)
SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_draw(9, 'o_orderkey')}, o_orderkey) <= quota THEN 'val' ELSE 'train' END AS split FROM orders JOIN q ON st = o_orderpriority""",
)
def stratified_split(spark, sf_dir):
    return C.stratified_split(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["o_orderkey"], 0.07, 9).select("o_orderkey", "split")


@query("weighted_sample", f"WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, -ln((CAST('0x' || {_draw(2, 'l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey')} AS UBIGINT) + 1) / CAST(4503599627370497 AS DOUBLE)) / l_quantity AS race FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM r QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY race, l_orderkey, l_linenumber, l_partkey, l_suppkey) <= 2")
def weighted_sample(spark, sf_dir):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return C.weighted_sample(table(spark, sf_dir, "lineitem").select(*keys, "l_quantity"), "l_orderkey", keys, "l_quantity", 2, 2).select(*keys)


@query("bucket_round_robin", f"WITH b AS (SELECT event_id, CASE WHEN value <= 25 THEN 0 WHEN value >= 75 THEN 1 ELSE 2 END AS bucket, {_draw(4, 'event_id')} AS d FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY d, event_id) AS place FROM b) SELECT event_id, bucket FROM r ORDER BY place, bucket LIMIT 90")
def bucket_round_robin(spark, sf_dir):
    """Ninety events in turn from the low, the high and the middle bucket."""
    bucket = F.when(F.col("value") <= 25, 0).when(F.col("value") >= 75, 1).otherwise(2)
    rows = table(spark, sf_dir, "events").select("event_id", bucket.alias("bucket")).withColumn("d", C.draw(4, "event_id"))
    at = C.ranked(rows, ["bucket"], ["d", "event_id"], "at").filter("at <= 90")
    return at.orderBy("at", "bucket").limit(90).select("event_id", "bucket")


@query("oversample", "SELECT item_id, CAST(unnest(range(16)) AS INT) AS repeat_index FROM benchmark")
def oversample(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("repeat_index"))


@query("repeat_interleave", "SELECT item_id, CAST(c AS INT) AS copy, CAST(row_number() OVER (ORDER BY item_id, c) - 1 AS BIGINT) AS interleaved, CAST(row_number() OVER (ORDER BY c, item_id) - 1 AS BIGINT) AS tiled FROM (SELECT item_id, unnest(range(3)) AS c FROM benchmark)")
def repeat_interleave(spark, sf_dir):
    """Copies of rows with their places in interleaved and in tiled order, from row numbers alone."""
    items = table(spark, sf_dir, "benchmark").select("item_id")
    n = items.agg(F.count("*").alias("n"))
    at = C.numbered(items, "item_id", "at")
    got = at.crossJoin(F.broadcast(n)).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return got.select("item_id", "copy", (F.col("at") * 3 + F.col("copy")).alias("interleaved"), (F.col("copy") * F.col("n") + F.col("at")).alias("tiled"))


@query("derangement", "SELECT r_regionkey, coalesce(lead(r_name) OVER (ORDER BY r_regionkey), (SELECT min_by(r_name, r_regionkey) FROM region)) AS other FROM region")
def derangement(spark, sf_dir):
    """A control without fixed points: each row gets the next one's value, the last the first's."""
    rows = table(spark, sf_dir, "region")
    w = Window.partitionBy(F.lit(0)).orderBy("r_regionkey")
    first = F.first("r_name").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select("r_regionkey", F.coalesce(F.lead("r_name").over(w), first).alias("other"))


@query("running_budget", "SELECT o_orderkey, source, spent FROM (SELECT o_orderkey, o_orderpriority AS source, round(sum(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey), 2) AS spent FROM orders) WHERE spent <= 1000000")
def running_budget(spark, sf_dir):
    """Orders of each source, in turn, while a running sum stays within the budget."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("source"), "o_totalprice")
    got = C.running_sum(rows, ["source"], "o_orderkey", [], "o_totalprice", "spent")
    return got.select("o_orderkey", "source", F.round("spent", 2).alias("spent")).filter("spent <= 1000000")


@query("balanced_partitions")
def balanced_partitions(spark, sf_dir):
    """Orders of each customer in three parts of near-equal price, with the load of the parts."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("group"), "o_orderkey", F.floor("o_totalprice").alias("length"))
    rows = rows.join(rows.groupBy("group").count().filter("count >= 3").select("group"), "group")
    return balancing.imbalance(balancing.balance(rows, "group", "o_orderkey", "length", 3), "length")


@query("token_budget_batches", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor((sum(l_quantity) OVER w - l_quantity) / 100) AS BIGINT) AS batch FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING)")
def token_budget_batches(spark, sf_dir):
    """Micro-batches of about a hundred tokens, in order, of each supplier's lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    got = C.running_sum(lines, ["l_suppkey"], "l_orderkey", ["l_linenumber", "l_partkey"], "l_quantity", "upto")
    return got.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor((F.col("upto") - F.col("l_quantity")) / 100).alias("batch"))


_PACKED = """WITH RECURSIVE l AS (SELECT o_custkey AS request, l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS row_idx FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
o AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY {order}row_idx) - 1 AS place FROM l),
w AS (SELECT request, place, 0 AS batch, 0 AS slot, n AS widest FROM o WHERE place = 0 UNION ALL
  SELECT o.request, o.place, CASE WHEN (slot + 2) * greatest(widest, n) > 200 THEN batch + 1 ELSE batch END, CASE WHEN (slot + 2) * greatest(widest, n) > 200 THEN 0 ELSE slot + 1 END, CASE WHEN (slot + 2) * greatest(widest, n) > 200 THEN n ELSE greatest(widest, n) END FROM w JOIN o ON o.request = w.request AND o.place = w.place + 1)
SELECT request, row_idx::INT AS row_idx, l_orderkey, n, batch, slot, place::INT AS place, max(n) OVER (PARTITION BY request, batch) AS width FROM w JOIN o USING (request, place)"""


def _requests(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("request")), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.withColumn("n", F.col("l_quantity").cast("int")).select("request", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "n")


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


@query("dynamic_batches", _PACKED.format(order=""))
def dynamic_batches(spark, sf_dir):
    """Lines of each customer, as they come, in batches of at most 200 padded tokens."""
    got = batching.pack(_requests(spark, sf_dir), "request", _LINE, "n", 200)
    return got.select("request", "row_idx", "l_orderkey", "n", "batch", "slot", "place", "width")


@query("packed_batches", _PACKED.format(order="n DESC, "))
def packed_batches(spark, sf_dir):
    """The same, longest lines first; row_idx is where results go back to."""
    got = batching.pack(_requests(spark, sf_dir), "request", _LINE, "n", 200, by_length=True)
    return got.select("request", "row_idx", "l_orderkey", "n", "batch", "slot", "place", "width")


@query("restored_order", "SELECT o_custkey AS request, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS INT) AS row_idx, CAST(l_quantity AS INT) * 2 AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def restored_order(spark, sf_dir):
    """Scores of packed rows, brought back to the rows' places in their requests."""
    plan = batching.pack(_requests(spark, sf_dir), "request", _LINE, "n", 200, by_length=True)
    return batching.restore(plan.select("request", "place", (F.col("n") * 2).alias("score")), plan, ["request"])


@query("dataset_stats", "SELECT lang, count(*) AS n, count(*) - count(DISTINCT text) AS duplicates, min(n_chars) AS least, round(avg(n_chars), 4) AS mean, max(n_chars) AS most FROM documents GROUP BY lang")
def dataset_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return docs.groupBy("lang").agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct("h")).alias("duplicates"), F.min("n_chars").alias("least"), F.round(F.avg("n_chars"), 4).alias("mean"), F.max("n_chars").alias("most"))


@query("qa_rows", "SELECT item_id, 'bench:' || item_id AS idx, CASE WHEN ends_with(trim(text), '?') THEN trim(text) ELSE trim(text) || '?' END AS question FROM benchmark")
def qa_rows(spark, sf_dir):
    """Questions in the training form, trimmed and with a question mark."""
    q = F.trim("text")
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.struct(F.lit("test").alias("split"), F.concat(F.lit("bench:"), F.col("item_id").cast("string")).alias("index")).alias("extra_info"), F.array(F.struct(F.lit("user").alias("role"), F.when(F.endswith(q, F.lit("?")), q).otherwise(F.concat(q, F.lit("?"))).alias("content"))).alias("prompt"))
    return rows.select("item_id", F.col("extra_info.index").alias("idx"), F.col("prompt")[0]["content"].alias("question"))


@query("normalize_messages", "SELECT conv_id, count(*) AS n, bool_and(role IN ('user', 'assistant', 'system') AND trim(text) <> '') AS well_formed, max_by(role, turn) = 'assistant' AS ends_well, sha256(string_agg(role || ':' || trim(text), chr(10) ORDER BY turn)) AS content_hash FROM conversations GROUP BY conv_id")
def normalize_messages(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.trim("text").alias("content")))).alias("m"))
    good = F.forall("m", lambda x: x["role"].isin("user", "assistant", "system") & (x["content"] != ""))
    text = F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["role"], x["content"])), "\n")
    return turns.select("conv_id", F.size("m").cast("long").alias("n"), good.alias("well_formed"), (F.element_at("m", -1)["role"] == "assistant").alias("ends_well"), F.sha2(text.cast("binary"), 256).alias("content_hash"))


@query(
    "alternating_sample",
    f"""WITH RECURSIVE b AS (SELECT event_id, user_id, CASE WHEN value <= 25 THEN 0 WHEN value >= 75 THEN 1 ELSE 2 END AS bucket, {_draw(4, 'event_id')} AS d FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY d, event_id) AS place FROM b QUALIFY row_number() OVER (PARTITION BY bucket, user_id ORDER BY d, event_id) <= 2),
c AS (SELECT list({{'bucket': bucket, 'place': place, 'user_id': user_id, 'event_id': event_id}} ORDER BY place) AS all_rows FROM f),
w AS (
  SELECT 0 AS turn, CAST(0 AS BIGINT) AS n, 0 AS idle, CAST([] AS BIGINT[]) AS users, [CAST(0 AS BIGINT), 0, 0] AS spot, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS INT) AS bucket
  UNION ALL
  SELECT turn + 1, n + CAST(r IS NOT NULL AS INT), CASE WHEN r IS NULL THEN idle + 1 ELSE 0 END, CASE WHEN r IS NULL THEN users ELSE list_append(users, r.user_id) END,
    list_transform(spot, lambda x, i: CASE WHEN i = turn % 3 + 1 AND r IS NOT NULL THEN r.place ELSE x END), r.event_id, r.bucket
  FROM (SELECT w.* EXCLUDE (event_id, bucket), list_filter(all_rows, lambda x: x.bucket = w.turn % 3 AND x.place > w.spot[w.turn % 3 + 1] AND len(list_filter(w.users, lambda u: u = x.user_id)) < 2)[1] AS r FROM w, c WHERE w.n < 90 AND w.idle < 3)
)
SELECT event_id, user_id, bucket, CAST(n AS INT) AS place FROM w JOIN (SELECT event_id, user_id FROM events) USING (event_id)""",
)
def alternating_sample(spark, sf_dir):
    """Ninety events in turn from the low, the high and the middle bucket, at most two of a user."""
    bucket = F.when(F.col("value") <= 25, 0).when(F.col("value") >= 75, 1).otherwise(2)
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", bucket.alias("bucket"))
    return C.alternating_sample(rows, ["event_id"], "bucket", [0, 1, 2], "user_id", 90, 2, 4).withColumnRenamed("at", "place")


@query(
    "unique_questions",
    f"""WITH q AS (SELECT conv_id, turn, role, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS q, {_draw(8, 'conv_id', 'turn')} AS d FROM conversations WHERE role IN ('user', 'assistant')),
o AS (SELECT * FROM q WHERE q <> '' QUALIFY row_number() OVER (PARTITION BY role, q ORDER BY d, conv_id, turn) = 1)
SELECT conv_id, turn, role FROM o QUALIFY row_number() OVER (PARTITION BY role ORDER BY d, conv_id, turn) <= 20""",
)
def unique_questions(spark, sf_dir):
    """Twenty different messages of each role."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return C.unique_questions(rows, "role", T.question_key(F.col("text")), ["user", "assistant"], ["conv_id", "turn"], 20, 8).select("conv_id", "turn", "role")


@query("shuffled_sample", f"WITH s AS (SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {_draw(11, 'doc_id')}, doc_id) <= 7) SELECT doc_id, source, row_number() OVER (ORDER BY {_draw(12, 'doc_id')}, doc_id) AS place FROM s")
def shuffled_sample(spark, sf_dir):
    return C.shuffled_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", ["doc_id"], 7, 11)
