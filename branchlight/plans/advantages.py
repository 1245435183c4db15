"""Group advantages, group classes and pass@k."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import groups
from .registry import query
from .relations import ROLLOUTS, r6, rollouts

_ID = ["tree_uid", "line", "part", "supplier"]
_G = "CASE WHEN count(*) OVER ({w}) > 1 THEN ({x} - avg({x}) OVER ({w})) / (stddev_samp({x}) OVER ({w}) + 1e-6) ELSE {x} / (1 + 1e-6) END"
_UID = _G.format(x="score", w="PARTITION BY uid")
_TREE = _G.format(x="score", w="PARTITION BY tree_uid")
_ZERO = "CASE WHEN count(*) OVER (PARTITION BY {g}) = 1 THEN 0 ELSE {f} END"
_KINDS = {
    "grpo": _UID,
    "rloo": "CASE WHEN count(*) OVER w > 1 THEN score * count(*) OVER w / (count(*) OVER w - 1) - avg(score) OVER w * count(*) OVER w / (count(*) OVER w - 1) ELSE score END",
    "tree": f"{_UID} + {_TREE}",
    "tree_inner": _TREE,
    "tree_per_token": _ZERO.format(g="uid", f=_UID) + " + " + _ZERO.format(g="tree_uid", f=_TREE),
    "no_estimator": "score",
}


def _register(kind: str, expression: str) -> None:
    sql = f"WITH {ROLLOUTS} SELECT tree_uid, line, part, supplier, round({expression}, 10) + 0.0 AS advantage FROM rollouts WINDOW w AS (PARTITION BY uid)"

    @query(f"advantage_{kind}", sql)
    def _(spark, sf_dir):
        return groups.advantages(rollouts(spark, sf_dir), kind).select(*_ID, (F.round("advantage", 10) + F.lit(0.0)).alias("advantage"))


for _kind, _sql in _KINDS.items():
    _register(_kind, _sql)


@query("advantage_tree_2norm", f"WITH {ROLLOUTS}, once AS (SELECT *, {_UID} AS x FROM rollouts) SELECT tree_uid, line, part, supplier, round({_G.format(x='x', w='PARTITION BY tree_uid')}, 5) + 0.0 AS advantage FROM once")
def advantage_tree_2norm(spark, sf_dir):
    got = groups.advantages(rollouts(spark, sf_dir), "tree_2norm")
    return got.select(*_ID, (F.round("advantage", 5) + F.lit(0.0)).alias("advantage"))


_CLASSES = f"""{ROLLOUTS}, classes AS (
  SELECT uid, min(tree_uid) AS first_row, count(*) AS n, count(*) FILTER (score >= CAST(0.8 AS DOUBLE)) AS n_correct,
    CASE WHEN count(*) FILTER (score >= CAST(0.8 AS DOUBLE)) = 0 THEN 'all_wrong' WHEN count(*) FILTER (score >= CAST(0.8 AS DOUBLE)) = count(*) THEN 'all_correct' ELSE 'mixed' END AS class
  FROM rollouts GROUP BY uid)"""


@query("group_classes", f"WITH {_CLASSES} SELECT uid, n, n_correct, class FROM classes")
def group_classes(spark, sf_dir):
    return groups.group_classes(rollouts(spark, sf_dir))


@query("dapo_counters", f"WITH {_CLASSES} SELECT class, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows, round(avg(n_correct / n), 6) AS accuracy FROM classes GROUP BY class")
def dapo_counters(spark, sf_dir):
    got = groups.group_classes(rollouts(spark, sf_dir))
    return got.groupBy("class").agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"), r6(F.avg(F.col("n_correct") / F.col("n")), "accuracy"))


@query("dapo_selection", f"WITH {_CLASSES}, chosen AS (SELECT uid FROM classes WHERE class = 'mixed' ORDER BY first_row, uid LIMIT 100) SELECT r.uid, r.tree_uid, r.line, r.part, r.supplier, round(score, 6) AS score FROM rollouts r JOIN chosen USING (uid)")
def dapo_selection(spark, sf_dir):
    """Rows of the first 100 mixed groups, in order of appearance."""
    rows = rollouts(spark, sf_dir)
    mixed = groups.group_classes(rows).filter("class = 'mixed'").select("uid")
    first = rows.groupBy("uid").agg(F.min("tree_uid").alias("first_row")).join(mixed, "uid").orderBy("first_row", "uid").limit(100)
    return rows.join(F.broadcast(first), "uid", "left_semi").select("uid", *_ID, r6(F.col("score"), "score"))


_PASS = "CASE WHEN n - n_correct < {k} THEN 1.0 ELSE 1 - list_reduce(list_transform(range(0, {k}), lambda i: (n - n_correct - i) * 1.0 / (n - i)), lambda a, b: a * b) END"


@query(
    "pass_at_k",
    f"""WITH {ROLLOUTS}, g AS (SELECT data_source, uid, count(*) AS n, count(*) FILTER (score >= CAST(0.8 AS DOUBLE)) AS n_correct FROM rollouts GROUP BY ALL),
k AS (SELECT data_source, {_PASS.format(k=1)} AS p1, {_PASS.format(k=2)} AS p2, {_PASS.format(k=4)} AS p4 FROM g)
SELECT coalesce(data_source, 'micro') AS data_source, round(avg(p1), 6) AS pass_1, round(avg(p2), 6) AS pass_2, round(avg(p4), 6) AS pass_4, count(*) AS n_groups FROM k GROUP BY GROUPING SETS ((data_source), ())""",
)
def pass_at_k(spark, sf_dir):
    got = rollouts(spark, sf_dir).groupBy("data_source", "uid").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 0.8).alias("c"))
    got = got.select("data_source", *[groups.pass_at_k(F.col("n"), F.col("c"), k).alias(f"p{k}") for k in (1, 2, 4)])
    return got.rollup("data_source").agg(*[r6(F.avg(f"p{k}"), f"pass_{k}") for k in (1, 2, 4)], F.count("*").alias("n_groups")).withColumn("data_source", F.coalesce("data_source", F.lit("micro")))


@query("max_pass_rate", f"WITH {ROLLOUTS} SELECT data_source, round(avg(CASE WHEN m >= CAST(1 AS DOUBLE) THEN 1.0 ELSE 0.0 END), 6) AS pass_rate FROM (SELECT data_source, uid, max(score) AS m FROM rollouts GROUP BY ALL) GROUP BY data_source")
def max_pass_rate(spark, sf_dir):
    got = rollouts(spark, sf_dir).groupBy("data_source", "uid").agg(F.max("score").alias("m"))
    return got.groupBy("data_source").agg(r6(F.avg((F.col("m") >= 1.0).cast("double")), "pass_rate"))


@query("validation_reward", f"WITH {ROLLOUTS} SELECT data_source, round(avg(score), 6) AS mean_reward, round(avg(CAST(score >= CAST(0.8 AS DOUBLE) AS DOUBLE)), 6) AS em, count(*) AS n FROM rollouts GROUP BY data_source")
def validation_reward(spark, sf_dir):
    return rollouts(spark, sf_dir).groupBy("data_source").agg(r6(F.avg("score"), "mean_reward"), r6(F.avg((F.col("score") >= 0.8).cast("double")), "em"), F.count("*").alias("n"))


@query("all_wrong_rescue", f"WITH {_CLASSES} SELECT uid, first_row, n FROM classes WHERE class = 'all_wrong'")
def all_wrong_rescue(spark, sf_dir):
    """All-wrong groups with their first row: candidates for a teacher's rescue."""
    rows = rollouts(spark, sf_dir)
    got = rows.groupBy("uid").agg(F.min("tree_uid").alias("first_row"), F.count("*").alias("n"), F.count_if(F.col("score") >= 0.8).alias("c"))
    return got.filter("c = 0").select("uid", "first_row", "n")
