"""Divergence audit of sources: how far the terms of a source are from those of every other source of its language, and which
terms set it apart from the language as a whole.

Terms are runs of letters (ASCII letters and everything beyond ASCII), A-Z in lower case. A language keeps the terms found in at least `least`
of its documents, V of them. A group (a source of a language, or the whole language) gives each kept term the smoothed share
p = 1 + floor(SCALE * (count + 1) / (N + V)), N the sum of its counts. Against shares q a term weighs f = floor((p - q)^2 / q). All of that is in integers,
the products in decimals of 38 digits.

Wide term vectors: tasks count the terms of their batches, one shuffle adds them up, and each kept term of a language becomes one row with an
array of its counts by the number of the source. Tasks take the weights of a batch of such rows for the ordered pairs of sources in which at least one has
the term, in 64-bit integers of numpy; they are summed by pair in the task and by a shuffle. Terms that neither source has weigh the same for all,
so for them one product (the number of such terms by that weight) stands in for V rows.

Null texts, languages and sources are read as ''. A source without terms has N = 0 and the same share for all terms; where no term is kept (V = 0) all pairs are 0.
Repeated rows count as often as they occur. Ties are ranked by the item's UTF-8 bytes. A very long text is counted whole, and a row with many terms is
spread by term. An empty table has no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import as_bytes, session_ready, stored, table

LEAST = 3
TOP = 200
SCALE = 1_000_000_000
#: Groups whose totals and names are broadcast; more are joined by a salted shuffle.
BROADCAST_GROUPS, SALTS = 50_000, 64
#: A task counts texts of so many bytes, or terms of a group, before it sends counts on.
HELD_BYTES, HELD_TERMS = 32 << 20, 1 << 18
#: Weights of so many cells (terms by sources) are taken at once.
CELLS = 1 << 17
_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group."""

    def rows(groups: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (k, s), (n, seen) in groups.items():
            cols = [pa.array([k] * len(n), pa.string()), pa.array([s] * len(n), pa.string()), pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([seen[t] for t in n], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "docs"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        read = 0
        for b in batches:
            for key, t in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), as_bytes(b.column(2)), strict=True):
                terms = _TERM.findall(t.translate(_LOWER))
                n, seen = groups.setdefault(key, (Counter(), Counter()))
                n.update(terms)
                seen.update(set(terms))
                read += len(t)
                if read > HELD_BYTES or len(n) > HELD_TERMS:
                    yield from rows(groups)
                    groups, read = {}, 0
        yield from rows(groups)

    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang, source, text)])
    found = read.mapInArrow(counted, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kinds: Column) -> Column:
    whole = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", whole, (total + kinds).cast("decimal(20,0)"))


def weight(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


class _Groups:
    """Totals by language as one row: sources (sorted), totals (N by number of the source), kinds (V) and total (N of the language)."""

    def __init__(self, frame: DataFrame):
        self.frame = stored(frame)
        self.few = self.frame.agg(F.coalesce(F.sum(F.size("sources")), F.lit(0))).first()[0] <= BROADCAST_GROUPS

    def joined_to(self, terms: DataFrame) -> DataFrame:
        if self.few:
            return terms.join(F.broadcast(self.frame), "lang")
        salted = self.frame.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return terms.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"]).drop("salt")


def wide_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST) -> tuple[DataFrame, _Groups]:
    """(lang, term, n, p, q): for each kept term its counts and shares in arrays by source, and the share of its language; and the groups."""
    session_ready(docs.sparkSession)
    names = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).distinct()
    names = names.groupBy("lang").agg(F.sort_array(F.collect_list("source")).alias("sources"))
    counts = term_counts(docs, text, lang, source)
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("by")).filter(F.col("docs") >= least)
    kept = stored(kept.select("lang", "term", "by"))
    totals = kept.select("lang", F.explode("by").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    totals = totals.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("ns"), F.sum("n").alias("total"))
    kinds = kept.groupBy("lang").agg(F.count("*").alias("kinds"))
    zero = F.lit(0).cast("bigint")
    groups = names.join(totals, "lang", "left").join(kinds, "lang", "left")
    groups = _Groups(groups.select("lang", "sources", F.transform("sources", lambda s: F.coalesce(F.col("ns")[s], zero)).alias("totals"), F.coalesce("total", zero).alias("total"), F.coalesce("kinds", zero).alias("kinds")))
    counted = groups.joined_to(kept).withColumn("n", F.transform("sources", lambda s: F.coalesce(F.col("by")[s], zero)))
    of_all = F.aggregate("n", zero, lambda a, c: a + c)
    p = F.transform("n", lambda c, i: share(c, F.get("totals", i), F.col("kinds")))
    return stored(counted.select("lang", "term", "n", p.alias("p"), share(of_all, F.col("total"), F.col("kinds")).alias("q"))), groups


def _weights(rows: DataFrame) -> DataFrame:
    """(lang, i, j, f, terms) of parts of rows (lang, n, p): the sum of weights of source i against source j over the terms that one of them has at least, and their number."""

    def of_source(i: int, n: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, ...]:
        # Terms of i: it against all others, and those that lack the term against it. The rest of a pair's terms come with the other source.
        own, lacks = p[:, i : i + 1], n == 0
        apart = (own - p) ** 2
        f = np.concatenate([(apart // p).sum(0), (apart // own * lacks).sum(0)])
        at, me = np.arange(n.shape[1]), np.full(n.shape[1], i)
        terms = np.concatenate([np.where(at == i, 0, len(n)), lacks.sum(0)])
        return tuple(x[terms > 0] for x in (np.concatenate([me, at]), np.concatenate([at, me]), f, terms))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(0).dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                some = b.filter(pc.equal(langs.indices, k))
                n, p = (some.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(some), -1) for c in (1, 2))
                for i in np.flatnonzero((n > 0).any(0)).tolist():
                    having = np.flatnonzero(n[:, i] > 0)
                    # One weight fits in 64 bits; only as many are added up here as surely do, and Spark's sum takes over.
                    most = float(p[having].max()) ** 2 / float(p[having].min())
                    step = max(1, min(CELLS // n.shape[1], int(2**62 / most)))
                    for x in range(0, len(having), step):
                        at = having[x : x + step]
                        found = of_source(i, n[at], p[at])
                        types = (pa.int32(), pa.int32(), pa.int64(), pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found[0]), pa.string()), *[pa.array(c, t) for c, t in zip(found, types, strict=True)]], names=["lang", "i", "j", "f", "terms"])

    return rows.mapInArrow(summed, "lang string, i int, j int, f bigint, terms bigint")


def pair_divergence(wide: DataFrame, groups: _Groups) -> DataFrame:
    """(lang, source, item, value): each source of a language against each other one."""
    summed = _weights(wide.filter(F.size("n") > 1).select("lang", "n", "p")).groupBy("lang", "i", "j").agg(F.sum("f").alias("f"), F.sum("terms").alias("terms"))
    one = groups.frame.select("lang", "sources", "totals", "kinds", F.posexplode("sources").alias("i", "source"))
    pairs = one.select("lang", "kinds", "totals", "i", "source", F.posexplode("sources").alias("j", "item")).filter("i <> j")
    zero = F.lit(0).cast("bigint")
    p, q = (share(zero, F.get("totals", F.col(k)), F.col("kinds")) for k in ("i", "j"))
    neither = F.when(F.col("kinds") > 0, weight(p, q)).otherwise(zero)
    return pairs.withColumn("neither", neither).join(summed, ["lang", "i", "j"], "left").select("lang", "source", "item", (F.coalesce("f", zero) + (F.col("kinds") - F.coalesce("terms", zero)) * F.col("neither")).alias("value"))


def term_divergence(wide: DataFrame, groups: _Groups, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): the terms that a source uses more than its language, ranked, the first `top`."""
    rows = groups.joined_to(wide)
    each = F.filter(F.transform("n", lambda c, i: F.struct(F.get("sources", i).alias("source"), c.alias("n"), F.get("p", i).alias("p"))), lambda x: (x["n"] > 0) & (x["p"] > F.col("q")))
    found = rows.select("lang", F.col("term").alias("item"), "q", F.explode(each).alias("e")).select("lang", F.col("e.source").alias("source"), "item", weight(F.col("e.p"), F.col("q")).alias("value"))
    # A limit on row_number is applied before the shuffle too: a task sends `top` rows of a group at most.
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).filter(F.col("rank") <= top)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): parts `pair` and `term`."""
    wide, groups = wide_terms(docs, text, lang, source, least)
    pairs = pair_divergence(wide, groups)
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    out = lambda part, df: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return out("pair", pairs).unionByName(out("term", term_divergence(wide, groups, top)))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


ORACLE = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), occ AS (SELECT r, lang, source, unnest(terms) AS term FROM doc),
kept AS (SELECT lang, term FROM occ GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM doc),
cnt AS (SELECT lang, source, term, count(*) AS c FROM occ JOIN kept USING (lang, term) GROUP BY lang, source, term),
n AS (SELECT lang, source, sum(c) AS n FROM cnt GROUP BY lang, source),
p AS (
  SELECT lang, source, term, coalesce(c, 0) AS c, 1 + CAST(1000000000::HUGEINT * (coalesce(c, 0) + 1) // (coalesce(n, 0) + v) AS BIGINT) AS p
  FROM grp JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN cnt USING (lang, source, term) LEFT JOIN n USING (lang, source)
), q AS (
  SELECT lang, term, 1 + CAST(1000000000::HUGEINT * (sum(c) + 1) // (any_value(n) + any_value(v)) AS BIGINT) AS q
  FROM cnt JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS n FROM n GROUP BY lang) USING (lang) GROUP BY lang, term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT x.lang, x.source, y.source AS other, CAST(sum((x.p - y.p) * (x.p - y.p) // y.p) AS BIGINT) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
), term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM term
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
