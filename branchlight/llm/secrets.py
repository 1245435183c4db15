"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong kinds stand by themselves: `assign` (a named value), `access` (an access key id), `hex` (a long
lower-case hexadecimal run). Weak kinds are parts of a credential and say little alone: `ident` (a
user or client name), `secret` (a mixed run of 20 characters or more), `endpoint` (a URL or an IP address).
Parts within a scope, that is with starts at most `scope` code points apart in one text, are linked
by an interval join: a weak secret needs an identifier or an endpoint there, a weak identifier or
endpoint needs a secret, be it strong or weak. A weak part that overlaps a strong span is part of that span.

A weak secret may be of any length, unless `longest` bounds it: op5_secret_scan does so, since its SQL takes
runs of 20 to 64 characters alone.

Positions are code points. They come from the lengths of what lies between matches: split() and
regexp_extract_all() see the same leftmost, non-overlapping matches.

Defined results: a null text counts as empty; repeated rows each get their row; a null doc_id is kept; a very long text is
scanned whole; an empty table gives none; ties in place are ordered by kind; other columns of the input are not read, and none of the keys may be named `parts`.
The scan's small result is checkpointed, so texts are read once and row numbers stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import session_ready, table

SCOPE = 200
#: The longest weak secret of op5_secret_scan, as its SQL has it.
LONGEST = 64
#: Kinds in their order with their patterns.
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "ident": r"(?:[Uu]ser(?:name)?|[Ll]ogin|[Aa]ccount|[Cc]lient_?[Ii]d)\x20*[:=]\x20*[A-Za-z0-9_.@-]+",
    "secret": r"[A-Za-z0-9+/_-]{20,}",
    "endpoint": r"https?://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
}
KINDS = list(PATTERNS)
STRONG, IDENTIFIERS, SECRETS = ("assign", "access", "hex"), ("access", "ident"), ("assign", "hex", "secret")
_PART = "array<struct<kind:int,at:int,gap:int,size:int,ok:boolean>>"


def _holds(kind: str, match, value, longest: int | None):
    if kind == "assign":
        return F.length(value) >= 6
    if kind == "secret":
        mixed = match.rlike("[0-9]") & match.rlike("[A-Z]") & match.rlike("[a-z]")
        return mixed if longest is None else (F.length(match) <= longest) & mixed
    return F.lit(True)


def _found(kind: str, longest: int | None):
    """Matches of a kind with the lengths of what precedes each and of itself; empty at once where none is."""
    pattern = F.lit(PATTERNS[kind])
    gaps = F.split("__text", PATTERNS[kind], -1)
    matches = F.regexp_extract_all("__text", pattern, F.lit(0))
    values = F.regexp_extract_all("__text", pattern, F.lit(2)) if kind == "assign" else matches
    zipped = F.transform(
        F.arrays_zip(matches.alias("m"), values.alias("v"), F.slice(gaps, 1, F.size(matches)).alias("g")),
        lambda x, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("at"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("size"), _holds(kind, x["m"], x["v"], longest).alias("ok")),
    )
    return F.when(F.col("__text").rlike(PATTERNS[kind]), zipped).otherwise(F.array().cast(_PART))


def scan(docs: DataFrame, keys: list, text: str = "text", longest: int | None = None) -> DataFrame:
    """keys of each row as one struct `__keys`, a row number `__row` and `__parts`, all matches; checkpointed."""
    session_ready(docs.sparkSession)
    rows = docs.select(F.struct(*keys).alias("__keys"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    rows = rows.withColumn("__parts", F.concat(*[_found(k, longest) for k in KINDS])).drop("__text")
    return rows.withColumn("__row", F.monotonically_increasing_id()).checkpoint()


def spans(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(__row, kind, start, end) of strong spans and of the weak ones that the interval join links."""
    parts = scanned.filter(F.size("__parts") > 0).repartition(F.col("__row")).select("__row", F.explode("__parts").alias("p")).select("__row", "p.*")
    upto = Window.partitionBy("__row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto)).withColumn("start", F.col("end") - F.col("size")).filter("ok").select("__row", "kind", "start", "end")
    of = lambda names: F.col("kind").isin([KINDS.index(k) for k in names])
    weak = parts.filter(~of(STRONG)).withColumn("cell", F.floor(F.col("start") / scope))
    near = parts.select(
        F.col("__row").alias("r"),
        F.col("start").alias("s"),
        F.col("end").alias("e"),
        of(STRONG).alias("strong"),
        of(IDENTIFIERS).alias("is_id"),
        of(SECRETS).alias("is_secret"),
        (F.col("kind") == KINDS.index("endpoint")).alias("is_endpoint"),
        F.explode(F.sequence(F.floor(F.col("start") / scope) - 1, F.floor(F.col("start") / scope) + 1)).alias("c"),
    )
    apart = (F.col("e") <= F.col("start")) | (F.col("s") >= F.col("end"))
    fits = F.when(F.col("kind") == KINDS.index("secret"), F.col("is_id") | F.col("is_endpoint")).otherwise(F.col("is_secret"))
    # Spans longer than the scope may overlap a part that starts far behind them.
    met = weak.join(near, (F.col("__row") == F.col("r")) & (F.col("cell") == F.col("c")) & (F.abs(F.col("start") - F.col("s")) <= scope))
    linked = met.groupBy("__row", "kind", "start", "end").agg(F.bool_or(fits & apart).alias("linked"), F.bool_or(F.col("strong") & ~apart).alias("inside")).filter("linked and not inside")
    return parts.filter(of(STRONG)).unionByName(linked.select("__row", "kind", "start", "end"))


def _told(parts):
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(parts, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, keys: list, text: str = "text", scope: int = SCOPE, longest: int | None = None) -> DataFrame:
    """keys of every row with `parts`: sorted structs of start, kind (place in KINDS) and end. Keys may have any name but `parts`."""
    scanned = scan(docs, keys, text, longest)
    grouped = spans(scanned, scope).groupBy(F.col("__row").alias("__r")).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("parts"))
    if "parts" in [c.lower() for c in scanned.schema["__keys"].dataType.names]:
        raise ValueError("a key is named parts")
    joined = scanned.select("__keys", "__row").join(grouped, F.col("__row") == F.col("__r"), "left")
    return joined.select("__keys.*", F.coalesce("parts", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).alias("parts"))


def redact(text, parts):
    """text with every maximal run of spans replaced by [REDACTED]; parts as of find_secrets()."""
    runs = F.aggregate(
        parts,
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda done, x: F.when((F.size(done) > 0) & (x["start"] <= F.element_at(done, -1)["end"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(done, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))),
    )
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(runs, lambda r: r["end"]))
    ends = F.concat(F.transform(runs, lambda r: r["start"]), F.array(F.length(text).cast("long")))
    kept = F.zip_with(starts, ends, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    return F.when(F.size(parts) > 0, F.array_join(kept, "[REDACTED]")).otherwise(text)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"), ["doc_id"], longest=LONGEST)
    base = F.filter("parts", lambda x: x["kind"] < len(STRONG))
    count = lambda k: F.size(F.filter("parts", lambda x: x["kind"] == KINDS.index(k))).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in STRONG],
        F.sha2(_told(base).cast("binary"), 256).alias("base_sha256"),
        _told(F.col("parts")).alias("spans"),
    )


def _sql_parts(kind: str, pattern: str) -> str:
    ok = {
        "assign": "len(regexp_extract_all(text, pat, 2)[i]) >= 6",
        "secret": "len(m) <= 64 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')",
    }.get(kind, "true")
    pattern = pattern.replace("'", "''")
    return f"""SELECT doc_id, {KINDS.index(kind)} AS kind, '{kind}' AS name, i, len(m) AS size, {ok} AS ok,
      sum(len(string_split_regex(text, pat)[i]) + len(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e
    FROM (SELECT doc_id, text, pat, i, regexp_extract_all(text, pat, 0)[i] AS m
      FROM (SELECT doc_id, text, pat, unnest(range(1, len(regexp_extract_all(text, pat, 0)) + 1)) AS i
        FROM (SELECT doc_id, coalesce(text, '') AS text, '{pattern}' AS pat FROM documents)))"""


def _oracle() -> str:
    pats = PATTERNS | {"assign": PATTERNS["assign"].replace("(?i:password|passwd|secret|token|api_?key)", "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")))}
    union = "\n    UNION ALL ".join(_sql_parts(k, p) for k, p in pats.items())
    return f"""WITH found AS ({union}),
p AS (SELECT doc_id, kind, name, CAST(e - size AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM found WHERE ok),
kept AS (
  SELECT doc_id, kind, name, s, e FROM p WHERE kind < 3
  UNION ALL
  SELECT w.doc_id, w.kind, w.name, w.s, w.e FROM p w JOIN p q ON w.doc_id = q.doc_id AND abs(w.s - q.s) <= {SCOPE}
  WHERE w.kind >= 3 GROUP BY ALL
  HAVING bool_or((CASE WHEN w.name = 'secret' THEN q.name IN ('access', 'ident', 'endpoint') ELSE q.name IN ('assign', 'hex', 'secret') END) AND (q.e <= w.s OR q.s >= w.e))
    AND NOT bool_or(q.kind < 3 AND NOT (q.e <= w.s OR q.s >= w.e))
), told AS (
  SELECT doc_id, count(*) FILTER (name = 'assign') AS n_assign, count(*) FILTER (name = 'access') AS n_access, count(*) FILTER (name = 'hex') AS n_hex,
    string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans
  FROM kept GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN told USING (doc_id)"""


ORACLE = _oracle()
