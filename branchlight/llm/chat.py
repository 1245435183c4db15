"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

Loggers write a conversation again after every turn. A rolling hash over the turns so far names every
prefix of a conversation: each turn is hashed with its place, in three parts of 40 bits, and running sums over the turns name the
prefixes. A conversation whose whole is a proper prefix of a longer one is dropped by
an anti-join on (turns, hash), and of equal conversations the one with the smallest conv_id stays. Every conversation is told which
one holds it: of the maximal conversations that begin with it the one with the smallest conv_id.
What remains is rendered. Markers inside a role or text are escaped by a backslash (`<|` becomes `<\\|`, `<\\|` becomes `<\\\\|`, and so
on, which can be undone), so that no text can open or close a turn; a line break in a role becomes a blank.

Defined results: turns are ordered by turn, then role and text, so that ties have one order; repeated
rows count once; a null role renders as `user`, a null text as empty and the hash tells both from the
empty string; rows with a null conv_id or turn are ignored; an empty table gives none; a long conversation is hashed turn by turn in a
window that spills, and only its rendered text is one value; other columns, of whatever name, are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import session_ready, table

START, END = "<|im_start|>", "<|im_end|>"


#: Copies of the holders' table that conversations are spread over, so that a conversation logged very often is no single task's work.
SALTS = 8
_PARTS = ("h1", "h2", "h3")


def prefixes(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, n, of, h1, h2, h3, role, text): each turn with its place, the number of turns and the hash of the turns up to it."""
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    ordered = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    again = F.lit(True)
    for c in ("turn", "role", "text"):
        again = again & F.lag(c).over(ordered).eqNullSafe(F.col(c))
    rows = rows.filter("conv_id is not null and turn is not null").withColumn("again", again).filter("not again").drop("again")
    rows = rows.withColumn("n", F.row_number().over(ordered)).withColumn("of", F.count("*").over(Window.partitionBy("conv_id")).cast("int"))
    mark = lambda c: F.when(c.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.sha2(c.cast("binary"), 256)))
    named = F.sha2(F.concat_ws("/", F.col("n").cast("string"), mark(F.col("role")), mark(F.col("text"))).cast("binary"), 256)
    # Sums of 40 bits stay within a long for eight million turns.
    part = lambda i: F.conv(F.substring(named, 1 + 10 * i, 10), 16, 10).cast("long")
    return rows.withColumns({h: F.sum(part(i)).over(so_far) for i, h in enumerate(_PARTS)}).select("conv_id", "n", "of", *_PARTS, "role", "text")


def collapse(turns: DataFrame, **columns: str) -> DataFrame:
    """(conv_id, held_by, n_turns, n_copies, rendered) of every conversation. held_by is its own id where it is kept; only then it
    has n_copies (conversations equal to it, itself included) and rendered."""
    session_ready(turns.sparkSession)
    rows = prefixes(turns, **columns).checkpoint()
    key = ["n", *_PARTS]
    whole = rows.filter("n = of").select("conv_id", *key)
    # Equal conversations become one row before anything is joined; so do equal prefixes.
    unique = whole.groupBy(*key).agg(F.min("conv_id").alias("kept"), F.count("*").alias("n_copies"))
    inner = rows.filter("n < of").select(*key).distinct()
    maximal = unique.join(inner, key, "left_anti").select(F.col("kept").alias("conv_id"), "n_copies")
    holders = rows.select("conv_id", *key).join(maximal, "conv_id").groupBy(*key).agg(F.min("conv_id").alias("held_by"))
    holders = holders.join(unique.select(*key), key, "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = whole.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")).join(holders, [*key, "salt"]).select("conv_id", "held_by", F.col("n").cast("long").alias("n_turns"))
    lines = rows.join(maximal, "conv_id").groupBy("conv_id").agg(F.max("n_copies").alias("n_copies"), F.array_sort(F.collect_list(F.struct("n", "role", "text"))).alias("turns"))
    return named.join(lines.select("conv_id", "n_copies", rendered().alias("rendered")), "conv_id", "left")


def escaped(c):
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def rendered(turns: str = "turns"):
    head = lambda t: F.regexp_replace(escaped(F.coalesce(t["role"], F.lit("user"))), r"[\r\n]", " ")
    line = lambda t: F.concat(F.lit(START), head(t), F.lit("\n"), escaped(F.coalesce(t["text"], F.lit(""))), F.lit(f"{END}\n"))
    return F.array_join(F.transform(turns, line), "")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(table(spark, sf_dir, "conversations"))


ORACLE = rf"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
p AS (
  SELECT conv_id, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS of,
    string_agg(coalesce('1' || sha256(role), '0') || ':' || coalesce('1' || sha256(text), '0'), '/') OVER w AS k,
    string_agg('{START}' || regexp_replace(regexp_replace(coalesce(role, 'user'), '<(\\*)\|', '<\\\1|', 'g'), '[\r\n]', ' ', 'g') || chr(10) || regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') || '{END}' || chr(10), '') OVER w AS rendered
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role NULLS FIRST, text NULLS FIRST ROWS UNBOUNDED PRECEDING)
), whole AS (SELECT n, k, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE n = of GROUP BY n, k),
kept AS (SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.k = w.k AND q.n = w.n AND q.n < q.of)),
holds AS (SELECT q.n, q.k, min(q.conv_id) AS held_by FROM p q JOIN kept USING (conv_id) GROUP BY q.n, q.k)
SELECT p.conv_id, held_by, p.n AS n_turns, kept.n_copies, CASE WHEN kept.conv_id IS NOT NULL THEN p.rendered END AS rendered
FROM p JOIN holds ON holds.n = p.n AND holds.k = p.k LEFT JOIN kept ON kept.conv_id = p.conv_id
WHERE p.n = p.of
"""
