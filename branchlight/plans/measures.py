"""Gates, arms, controls, contracts and token rows over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import forms, leaks, prompts
from ..operators import answers, audit
from ..operators import batch as B
from ..operators import curate as C
from ..operators import groups as G
from ..operators import tokenizing as K
from ..operators import trees
from .registry import query
from .relations import NODES, ROLLOUTS, r6, rollouts, table, tree_nodes

#: A public vocabulary; where it is is up to the caller.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

_ARMS = "arm AS (SELECT o_orderkey AS k, a.arm, (floor(o_totalprice) + a.i * 37) % 10 < a.most AS hit, 1.0 / (1 + (floor(o_totalprice) + a.i * 13) % a.ranks) AS mrr FROM orders, (VALUES ('real', 1, 6, 3), ('student', 2, 3, 6), ('plain', 3, 4, 5), ('shuffle', 4, 2, 7)) AS a(arm, i, most, ranks))"


def _arms(spark, sf_dir):
    price = F.floor("o_totalprice")
    made = lambda arm, i, most, ranks: F.struct(F.lit(arm).alias("arm"), ((price + i * 37) % 10 < most).cast("int").alias("hit"), (1.0 / (1 + (price + i * 13) % ranks)).alias("mrr"))
    arms = F.array(made("real", 1, 6, 3), made("student", 2, 3, 6), made("plain", 3, 4, 5), made("shuffle", 4, 2, 7))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.explode(arms).alias("a")).select("k", "a.*")


_LIFTS = f"""WITH {_ARMS}, w AS (SELECT k, arm, CAST(hit AS INT) AS hit, mrr FROM arm),
d AS (SELECT 'hit:' || b.arm AS what, r.k, CAST(r.hit - b.hit AS DOUBLE) AS delta FROM w r JOIN w b USING (k) WHERE r.arm = 'real' AND b.arm <> 'real' UNION ALL SELECT 'mrr:' || b.arm, r.k, r.mrr - b.mrr FROM w r JOIN w b USING (k) WHERE r.arm = 'real' AND b.arm <> 'real'),
o AS (SELECT *, row_number() OVER (PARTITION BY what ORDER BY substr(sha256('73:' || k), 1, 13), k) - 1 AS place, count(*) OVER (PARTITION BY what) AS n FROM d),
p AS (SELECT what, r, floor(CAST('0x' || substr(sha256('73:' || what || ':' || r || ':' || place), 1, 13) AS UBIGINT) / CAST(4503599627370496 AS DOUBLE) * n) AS place FROM o, range(20) AS t(r)),
m AS (SELECT what, r, avg(delta) AS m FROM p JOIN o USING (what, place) GROUP BY ALL),
b AS (SELECT what, quantile_cont(m, [0.025, 0.975]) AS q FROM m GROUP BY 1),
lift AS (SELECT string_split(what, ':')[1] AS metric, string_split(what, ':')[2] AS baseline, n, mean, q[1] AS low, q[2] AS high FROM b JOIN (SELECT what, count(*) AS n, avg(delta) AS mean FROM d GROUP BY 1) USING (what))"""


def _lifts(spark, sf_dir):
    return audit.paired_lifts(_arms(spark, sf_dir), "k", "arm", ["hit", "mrr"], "real", ["student", "plain", "shuffle"], 20, 73)


@query("paired_lifts", f"{_LIFTS} SELECT metric, baseline, n, round(mean, 6) + 0.0 AS mean, round(low, 6) + 0.0 AS low, round(high, 6) + 0.0 AS high FROM lift")
def paired_lifts(spark, sf_dir):
    """What the real arm adds to each baseline, with bootstrap intervals."""
    return _lifts(spark, sf_dir).select("metric", "baseline", "n", *[r6(F.col(c), c) for c in ("mean", "low", "high")])


@query("strict_gate", f"{_LIFTS}, c AS (SELECT bool_and(mean >= CAST(0.15 AS DOUBLE)) FILTER (metric = 'hit') AS hit_check, bool_and(low >= 0) FILTER (metric = 'hit' AND baseline <> 'student') AS ci_check, bool_and(mean > 0) FILTER (metric = 'mrr' AND baseline <> 'student') AS mrr_check FROM lift) SELECT *, true AS valid_check, false AS leak_check, false AS gate_pass FROM c")
def strict_gate(spark, sf_dir):
    """The gate over the lifts, with too many leaks."""
    return audit.strict_gate(_lifts(spark, sf_dir), 0.9, 0.06, 0.15, ["plain", "shuffle"])


@query("arm_report", f"WITH {_ARMS}, r AS (SELECT arm.*, o_custkey AS uid, o_orderstatus <> 'O' AS answered FROM arm JOIN orders ON k = o_orderkey WHERE NOT (arm = 'plain' AND o_custkey % 3 = 0)), s AS (SELECT uid FROM r GROUP BY 1 HAVING count(DISTINCT arm) = 4), g AS (SELECT arm, uid, count(*) AS k, count(*) FILTER (hit) AS c, count(*) FILTER (answered) AS a FROM r JOIN s USING (uid) GROUP BY ALL) SELECT arm, count(*) AS uids, CAST(sum(k) AS BIGINT) AS samples, round(sum(c) / sum(k), 6) AS em, round(sum(a) / sum(k), 6) AS answered, round(avg(CASE WHEN c > 0 THEN 1.0 ELSE 0.0 END), 6) AS pass_at_k FROM g GROUP BY arm")
def arm_report(spark, sf_dir):
    """Arms over the customers that all of them have."""
    rows = _arms(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("uid"), (F.col("o_orderstatus") != "O").alias("answered")), "k")
    got = audit.arm_report(rows.filter("not (arm = 'plain' and uid % 3 = 0)").withColumn("right", F.col("hit") == 1), "uid", "arm", "right", "answered")
    return got.select("arm", "uids", "samples", *[r6(F.col(c), c) for c in ("em", "answered", "pass_at_k")])


@query("retrieval_overlap", "WITH l AS (SELECT l_orderkey AS q, list(DISTINCT l_suppkey % 20) AS found FROM lineitem GROUP BY 1), g AS (SELECT q, found, list_distinct([o_custkey % 20, o_orderkey % 20]) AS gold FROM l JOIN orders ON q = o_orderkey), n AS (SELECT q, len(list_intersect(found, gold)) AS b, len(list_distinct(list_concat(found, gold))) AS u, len(gold) AS g FROM g) SELECT q, round(b / g, 6) AS recall, round(b / u, 6) AS jaccard, b > 0 AS any_hit, b = g AS all_hit FROM n")
def retrieval_overlap(spark, sf_dir):
    """Titles found for each order against its gold ones."""
    lists = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("q")).agg(F.collect_set(F.col("l_suppkey") % 20).alias("found"))
    rows = lists.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q"), F.array(F.col("o_custkey") % 20, F.col("o_orderkey") % 20).alias("gold")), "q")
    m = audit.retrieval_overlap(F.col("found"), F.col("gold"))
    return rows.select("q", r6(m["recall"], "recall"), r6(m["jaccard"], "jaccard"), m["any_hit"].alias("any_hit"), m["all_hit"].alias("all_hit"))


@query("feature_counts", "WITH t AS (SELECT o_orderpriority AS source, l_orderkey, count(*) AS turns, sum(l_quantity) AS tokens, bool_or(l_tax > 0.06) AS slow, bool_or(l_returnflag = 'R') AS returned FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) SELECT source, feature, count(*) FILTER (has) AS n, round(avg(CASE WHEN has THEN 1.0 ELSE 0.0 END), 6) AS share FROM (SELECT source, 'many_turns' AS feature, turns > 4 AS has FROM t UNION ALL SELECT source, 'long', tokens > 100 FROM t UNION ALL SELECT source, 'slow', slow FROM t UNION ALL SELECT source, 'returned', returned FROM t) GROUP BY ALL")
def feature_counts(spark, sf_dir):
    """How many trajectories of each source have each feature."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("turns"), F.sum("l_quantity").alias("tokens"), F.bool_or(F.col("l_tax") > 0.06).alias("slow"), F.bool_or(F.col("l_returnflag") == "R").alias("returned"))
    rows = lines.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("source")), "l_orderkey")
    has = F.map_from_arrays(F.array(*map(F.lit, ("many_turns", "long", "slow", "returned"))), F.array(F.col("turns") > 4, F.col("tokens") > 100, "slow", "returned"))
    return rows.select("source", F.explode(has).alias("feature", "has")).groupBy("source", "feature").agg(F.count_if("has").alias("n"), r6(F.avg(F.col("has").cast("double")), "share"))


@query("training_metrics", f"WITH {ROLLOUTS}, a AS (SELECT *, CASE WHEN count(*) OVER w > 1 THEN (score - avg(score) OVER w) / (stddev_samp(score) OVER w + 1e-6) ELSE score / (1 + 1e-6) END AS adv FROM rollouts WINDOW w AS (PARTITION BY uid)) SELECT m, round(min(v), 5) + 0.0 AS least, round(sum(v * tokens) / sum(tokens), 5) + 0.0 AS mean, round(max(v), 5) + 0.0 AS most FROM (SELECT 'score' AS m, score AS v, 1 AS tokens FROM a UNION ALL SELECT 'advantage', adv, tokens FROM a UNION ALL SELECT 'return', score * 0.5, tokens FROM a) GROUP BY m")
def training_metrics(spark, sf_dir):
    """Least, mean and largest score of responses, and advantage and return of their tokens: every token has its response's, so it counts as often as there are tokens."""
    rows = G.advantages(rollouts(spark, sf_dir), "grpo")
    each = F.array(*[F.struct(F.lit(m).alias("m"), v.alias("v"), n.alias("tokens")) for m, v, n in (("score", F.col("score"), F.lit(1.0)), ("advantage", F.col("advantage"), F.col("tokens")), ("return", F.col("score") * 0.5, F.col("tokens")))])
    at = lambda c, n: (F.round(c, 5) + F.lit(0.0)).alias(n)
    mean = audit.exact_sum(F.col("v") * F.col("tokens")) / audit.exact_sum(F.col("tokens"))
    return rows.select(F.explode(each).alias("x")).select("x.*").groupBy("m").agg(at(F.min("v"), "least"), at(mean, "mean"), at(F.max("v"), "most"))


@query("seeded_derangement", "WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY substr(sha256('19:' || o_orderkey), 1, 13), o_orderkey) AS i, count(*) OVER () AS n FROM orders) SELECT a.o_orderkey, a.o_custkey, b.o_orderkey AS control FROM r a JOIN r b ON b.i = a.i % a.n + 1")
def seeded_derangement(spark, sf_dir):
    """Another order for each order."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return C.derangement(rows, ["o_orderkey"], "o_orderkey", 19, "control")


@query("source_mixture", "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY substr(sha256('13:' || doc_id), 1, 13), doc_id) AS i FROM documents) SELECT doc_id, lang FROM r WHERE i <= CASE lang WHEN 'en' THEN 20 WHEN 'de' THEN 6 WHEN 'fr' THEN 7 ELSE 0 END")
def source_mixture(spark, sf_dir):
    """Thirty-three documents: six tenths and two tenths of two languages, the rest of a third."""
    return C.mixture(table(spark, sf_dir, "documents").select("doc_id", "lang").filter("lang is not null"), "lang", ["doc_id"], {"en": 0.61, "de": 0.2, "fr": 0.19}, 33, 13)


@query("counted_sources", "SELECT r_regionkey, r_name, n_nationkey FROM region JOIN nation ON r_regionkey = n_regionkey")
def counted_sources(spark, sf_dir):
    """Nations of regions, five each, or an error."""
    rows = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).select("r_regionkey", "r_name", "n_nationkey")
    return C.require_counts(rows, "r_regionkey", {i: 5 for i in range(5)})


@query("rejected_messages", "WITH c AS (SELECT conv_id, list({'role': trim(role), 'content': trim(text)} ORDER BY turn) AS m FROM conversations WHERE NOT (conv_id % 4 = 0 AND turn = (SELECT max(turn) FROM conversations x WHERE x.conv_id = conversations.conv_id)) GROUP BY 1) SELECT conv_id, CASE WHEN m[-1].role = 'assistant' AND m[-1].content <> '' AND len(list_filter(m, lambda x: x.role = '' OR x.content IS NULL)) = 0 THEN len(m) ELSE 0 END AS turns FROM c")
def rejected_messages(spark, sf_dir):
    """Turns of conversations that may be trained on; zero for those rejected. Every fourth has lost its last turn."""
    c = table(spark, sf_dir, "conversations")
    last = c.groupBy(F.col("conv_id").alias("__c")).agg(F.max("turn").alias("__last"))
    kept = c.join(last, F.col("conv_id") == F.col("__c")).filter("not (conv_id % 4 = 0 and turn = __last)")
    m = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    neat = forms.normalized_messages(F.col("m"))
    return m.select("conv_id", F.when(neat.isNotNull(), F.size(neat)).otherwise(0).cast("long").alias("turns"))


@query("stable_ids", "SELECT o_orderkey, substr(sha256(o_orderpriority || ':' || o_orderkey || ':'), 1, 16) AS id FROM orders")
def stable_ids(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", forms.stable_id(F.col("o_orderpriority"), F.col("o_orderkey"), F.lit(None)).alias("id"))


@query("schema_faults", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 1 THEN 'empty,length,schema' WHEN p_partkey % 4 = 3 THEN 'length,schema' ELSE 'length' END AS faults FROM part")
def schema_faults(spark, sf_dir):
    """Skills of two fields, of which some parts lack one, and some have one more."""
    k = F.col("p_partkey")
    text = F.when(k % 4 == 1, F.lit('{"a":"look"}')).when(k % 4 == 3, F.lit('{"a":"look","b":"on","c":"x"}')).otherwise(F.lit('{"b":"on","a":"look"}'))
    rows = table(spark, sf_dir, "part").select("p_partkey", text.alias("t"))
    fields = {n: F.get_json_object("t", f"$.{n}") for n in ("a", "b")}
    none = F.array().cast("array<string>")
    return rows.select("p_partkey", F.array_join(leaks.skill_faults(fields, none, F.lit(""), F.lit(""), none, F.json_object_keys("t")), ",").alias("faults"))


@query("tree_snapshots", f"WITH {NODES}, d AS (SELECT DISTINCT * FROM nodes), k AS (SELECT tree_uid, parent_node_uid AS node_uid, string_agg(node_uid, '+' ORDER BY node_uid) AS kids, count(*) AS n FROM d WHERE parent_node_uid IS NOT NULL GROUP BY ALL) SELECT tree_uid, max(CASE WHEN parent_node_uid IS NULL THEN node_uid END) AS root, count(*) AS n_nodes, count(*) FILTER (n IS NULL) AS leaves, sha256(string_agg(node_uid || '<' || coalesce(parent_node_uid, '') || '>' || coalesce(kids, ''), ';' ORDER BY depth, node_uid)) AS shape FROM d LEFT JOIN k USING (tree_uid, node_uid) GROUP BY tree_uid")
def tree_snapshots(spark, sf_dir):
    """Whole trees nested, with the links of each node."""
    got = trees.snapshot(tree_nodes(spark, sf_dir).repartition("tree_uid").distinct(), ["score"])
    shape = F.array_join(F.transform("nodes", lambda n: F.concat(n["node_uid"], F.lit("<"), F.coalesce(n["parent_node_uid"], F.lit("")), F.lit(">"), F.array_join(n["child_node_uids"], "+"))), ";")
    return got.select("tree_uid", F.col("root_node_uid").alias("root"), "n_nodes", F.size(F.filter("nodes", lambda n: n["is_leaf"])).cast("long").alias("leaves"), F.sha2(shape.cast("binary"), 256).alias("shape"))


@query("lists_and_rows", "SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS row_idx, o_orderkey, o_orderstatus FROM orders")
def lists_and_rows(spark, sf_dir):
    """Orders of each customer as lists and as rows again."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias(B.ROW), "o_orderkey", "o_orderstatus")
    return B.rows_of_lists(B.lists_by(rows, "o_custkey"), "o_custkey").withColumnRenamed(B.ROW, "row_idx")


@query("size_report", "SELECT 'c_custkey' AS column, count(c_custkey) AS values, 0 AS missing, sum(length(CAST(c_custkey AS VARCHAR)))::BIGINT AS bytes FROM customer UNION ALL SELECT 'c_name', count(c_name), 0, sum(strlen(c_name))::BIGINT FROM customer UNION ALL SELECT 'tokens', count(*), 0, sum(length(c_name) * 2)::BIGINT FROM customer".replace("AS values", 'AS "values"').replace("AS column", 'AS "column"'))
def size_report(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.transform(F.split("c_name", ""), lambda _: F.lit(10)).alias("tokens"))
    return B.size_report(rows)


@query(
    "hindsight_prompts",
    """SELECT p_partkey, sha256(chr(10) || '<hindsight>' || chr(10) || 'A better branch from this exact search state later retrieved:' || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN '(no retrieval evidence was returned)' ELSE p_name END || chr(10) || 'Its branch value was ' || printf('%.4f', p_size / 64) || '; its local advantage over the alternatives was ' || printf('%.4f', p_size / 128) || '.' || chr(10) || 'Outcomes of other attempted searches from the same state (query text withheld to prevent copying):' || chr(10)
  || CASE WHEN p_partkey % 2 = 0 THEN '- (no textual alternative available)' ELSE '- anonymized alternative branch 1: value ' || printf('%.4f', p_size / 32) || chr(10) || '- anonymized alternative branch 2: value 0.5000' END || chr(10) || '</hindsight>' || chr(10)
  || 'Use this hindsight only to correct the direction of the agent''s private reasoning and next search. Never state or imply a final answer, and never claim access to future information. Continue as an agent that only knows the visible current state.' || chr(10)) AS prompt FROM part""",
)
def hindsight_prompts(spark, sf_dir):
    size = F.col("p_size")
    others = F.when(F.col("p_partkey") % 2 == 0, F.array().cast("array<double>")).otherwise(F.array(size / 32, F.lit(0.5)))
    made = prompts.hindsight(F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")), size / 64, size / 128, others)
    return table(spark, sf_dir, "part").select("p_partkey", F.sha2(made.cast("binary"), 256).alias("prompt"))


@query("token_round_trip", "SELECT doc_id, text IS NULL AS missing, sha256(text) AS restored FROM documents")
def token_round_trip(spark, sf_dir, vocabulary: str = VOCABULARY):
    """Documents as ids of a public vocabulary and as texts again."""
    rows = table(spark, sf_dir, "documents").select("doc_id", K.encoded(F.col("text"), vocabulary).alias("ids"))
    back = K.decoded(F.col("ids"), vocabulary)
    return rows.select("doc_id", F.col("ids").isNull().alias("missing"), F.sha2(back.cast("binary"), 256).alias("restored"))


_CODED = "WITH t AS (SELECT p_partkey, length(p_name) + length(p_type) AS n, length(p_brand) AS m FROM part), k AS (SELECT *, 40 - m AS keep, least(8, (40 - m) // 2) AS head FROM t)"


def _codes(*columns):
    return F.concat(*[F.transform(F.split(c, ""), F.ascii) for c in columns])


@query("masked_labels", f"{_CODED} SELECT p_partkey, least(n, keep) + m AS length, least(n, keep) AS ignored, m AS learned FROM k")
def masked_labels(spark, sf_dir):
    """Prompt and response in forty places: how many labels are ignored and how many count."""
    rows = table(spark, sf_dir, "part").select("p_partkey", K.training_row(_codes("p_name", "p_type"), _codes("p_brand"), 40, 8, 8).alias("r"))
    count = lambda keep: F.size(F.filter("r.labels", keep)).cast("long")
    return rows.select("p_partkey", F.size("r.input_ids").cast("long").alias("length"), count(lambda x: x == K.IGNORED).alias("ignored"), count(lambda x: x != K.IGNORED).alias("learned"))


@query("preference_sides", "WITH t AS (SELECT p_partkey, list_concat([ascii(x) for x in string_split(p_brand, '')], [ascii(x) for x in string_split(p_name, '')]) AS a, list_concat([ascii(x) for x in string_split(p_brand, '')], [ascii(x) for x in string_split(p_type, '')]) AS b FROM part), s AS (SELECT p_partkey, 'chosen' AS side, list_append(a, 2) AS ids FROM t UNION ALL SELECT p_partkey, 'rejected', list_append(b, 2) FROM t) SELECT p_partkey, side, 24::BIGINT AS n, least(24, len(ids)) AS attended, list_sum(ids[1:24])::BIGINT AS total FROM s")
def preference_sides(spark, sf_dir):
    """Both sides of a preference in twenty-four places, with masks."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(K.preference_sides(_codes("p_brand"), _codes("p_name"), _codes("p_type"), 24, 2, 0)).alias("i", "s"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("p_partkey", F.when(F.col("i") == 0, "chosen").otherwise("rejected").alias("side"), F.size("s.input_ids").cast("long").alias("n"), total(F.col("s.attention_mask")).alias("attended"), total(F.col("s.input_ids")).alias("total"))


@query("unpadded_pieces", "SELECT p_partkey, length(p_name) AS n, (length(p_name) + 6) // 7 AS pieces, (length(p_name) - 1) % 7 + 1 AS last FROM part")
def unpadded_pieces(spark, sf_dir):
    """Names in sixty-four places, the padding taken off again, cut into pieces of seven."""
    ids = K.fitted(_codes("p_name"), 64, 0, left=True)
    rows = table(spark, sf_dir, "part").select("p_partkey", ids.alias("ids")).select("p_partkey", K.unpadded(F.col("ids"), F.transform("ids", lambda x: (x != 0).cast("int"))).alias("u"))
    cut = rows.select("p_partkey", F.size("u").cast("long").alias("n"), K.split(F.col("u"), 7).alias("p"))
    return cut.select("p_partkey", "n", F.size("p").cast("long").alias("pieces"), F.size(F.element_at("p", -1)).cast("long").alias("last"))


@query(
    "shortened_texts",
    """WITH t AS (SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_name || ' ' || p_type AS x FROM part), n AS (SELECT p_partkey, x, unnest(range(0, length(x) // 2 + 1)) AS n FROM t), s AS (SELECT p_partkey, n, substr(x, 1, n) || ' .. ' || CASE WHEN n = 0 THEN '' ELSE right(x, n) END AS s FROM n),
b AS (SELECT p_partkey, max_by(s, n) AS s FROM s WHERE len(list_filter(string_split(s, ' '), lambda w: w <> '')) <= 4 GROUP BY 1) SELECT p_partkey, CASE WHEN len(list_filter(string_split(x, ' '), lambda w: w <> '')) <= 4 THEN x ELSE s END AS short FROM t LEFT JOIN b USING (p_partkey)""",
)
def shortened_texts(spark, sf_dir):
    """Descriptions of parts shortened to four words, the mark between head and tail included."""
    text = F.concat_ws(" ", "p_name", "p_type", "p_brand", "p_name", "p_type")
    shorten = answers.compressing(4, lambda t: len(t.split()), " .. ")
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("x")).select("p_partkey", shorten("x").alias("short"))
