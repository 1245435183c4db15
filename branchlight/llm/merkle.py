"""Merkle manifest of a dataset: a digest for each row, a tree for each group of rows, one tree over the groups, and for
each row the siblings on its way to the root, from which anyone can fold the root again.

A leaf is the SHA-256 of the row's fields, each `-` if null, else UTF-8 byte count, `:` and value. In a group leaves stand in order
of the key; while more than one node is left, runs of `BRANCH` consecutive nodes (the last may be shorter, even one) become the digest of their
concatenation. What is left is the group's subroot; the subroots, by group, give the root the same way. Digests are concatenated as lowercase hex.

How it is spread: positions come from a range partitioning and counts per partition and group. Blocks of `BRANCH ** height`
consecutive leaves are reduced each in one task. Their roots, the lower end of the upper tree, are few: at most `TOP_NODES` go to the driver, which builds
the upper tree and broadcasts the suffix paths (as the levels that they run through, so that shared parts are sent once). Executors put
in front of a suffix the siblings from within the block. If there are more block roots than that (very many groups, say), the upper tree is
built level by level as DataFrames and paths are joined to the blocks. `height` is 4, 5 or 6, the least for which n / BRANCH ** height
is at most TOP_NODES / 4; the rows do not depend on it.

Defined results: nulls are fields of their own kind and a null group or key comes first; an empty text is `0:`; a very long text is hashed whole
on the JVM; leaves with equal keys stand in order of their digest, so repeated rows have one leaf, and places next to each other; an empty table has no rows;
other columns of the input, of any name, are not read and are not part of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import session_ready, stored, table

BRANCH = 8
TOP_NODES = 1 << 18
HEIGHTS = (4, 5, 6)
#: Rows of (group, partition) counts that are broadcast; more of them are joined by shuffle.
BROADCAST_ROWS = 1 << 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PROOF = "array<struct<left:string,right:string>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(*fields: Column) -> Column:
    """The leaf of a row with these fields."""
    coded = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in fields]
    return F.sha2(F.concat(*coded).cast("binary"), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda at, level: F.sha2(F.concat(level["left"], at, level["right"]).cast("binary"), 256))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings, left to right, level by level."""
    return F.sha2(F.array_join(F.transform(proof, lambda level: F.concat(level["left"], level["right"])), "").cast("binary"), 256)


def levels_of(nodes: list[str], height: int | None = None) -> list[list[str]]:
    """Nodes and all levels above: as many as it takes to one node, or `height`."""
    found = [nodes]
    while len(found) <= height if height is not None else len(found[-1]) > 1:
        below = found[-1]
        found.append([sha("".join(below[i : i + BRANCH])) for i in range(0, len(below), BRANCH)])
    return found


def siblings(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """Left and right siblings of node `at` of the lowest level, on each level but the last."""
    found = []
    for level in levels[:-1]:
        first = at - at % BRANCH
        found.append(("".join(level[first:at]), "".join(level[at + 1 : first + BRANCH])))
        at //= BRANCH
    return found


class Upper:
    """The upper tree as the driver builds it from (group, block, digest), blocks of each group in order, groups in order."""

    def __init__(self, roots: list[tuple[str | None, int, str]]):
        self.groups: dict[str | None, list[list[str]]] = {}
        for group, _, digest in roots:
            self.groups.setdefault(group, [[]])[0].append(digest)
        self.groups = {g: levels_of(v[0]) for g, v in self.groups.items()}
        self.place = {g: i for i, g in enumerate(self.groups)}
        self.top = levels_of([v[-1][0] for v in self.groups.values()])

    def suffix(self, group: str | None, block: int) -> list[tuple[str, str]]:
        return siblings(self.groups[group], block) + siblings(self.top, self.place[group])


def _positions(leaves: DataFrame) -> DataFrame:
    """leaves (group, key, leaf, ...) with `at`, the place within the group, and `n`, the group's size."""
    # The salt deals out rows that repeat each other; they are interchangeable.
    order = ["group", "key", "leaf", "salt"]
    placed = stored(leaves.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt").withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()))
    spans = placed.groupBy("group", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = stored(spans.select(F.col("group").alias("g"), F.col("part").alias("p"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(Window.partitionBy("group")).alias("n")))
    few = spans.count() <= BROADCAST_ROWS
    joined = placed.join(F.broadcast(spans) if few else spans, F.col("group").eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")))
    return joined.withColumn("at", F.col("row") + F.col("shift")).drop("g", "p", "part", "row", "shift")


def _blocks(leaves: DataFrame, height: int) -> DataFrame:
    """(group, block, n, rows, digest): the rows of each block in order, and its root."""
    size = BRANCH**height
    own = [c for c in leaves.columns if c not in ("group", "n")]
    rows = F.sort_array(F.collect_list(F.struct("at", *[c for c in own if c != "at"])))
    dealt = leaves.groupBy("group", F.floor(F.col("at") / size).alias("block"), "n").agg(rows.alias("rows"))

    @F.arrow_udf("string")
    def reduced(leaves: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array([levels_of(nodes, height if total > size else None)[-1][0] for nodes, total in zip(leaves.to_pylist(), n.to_pylist(), strict=True)], pa.string())

    return stored(dealt.withColumn("digest", reduced(F.col("rows.leaf"), F.col("n"))))


def _climb(nodes: DataFrame) -> DataFrame:
    """For any number of nodes (group, block, digest, n of the group) (group, block, path, top): the siblings above each and what is left of its group."""
    levels = [stored(nodes.withColumnRenamed("block", "at"))]
    while levels[-1].filter("n > 1").limit(1).count():
        run = F.transform(F.sort_array(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"])
        above = levels[-1].groupBy("group", F.floor(F.col("at") / BRANCH).alias("at"), "n").agg(run.alias("run"))
        digest = F.when(F.col("n") > 1, F.sha2(F.array_join("run", "").cast("binary"), 256)).otherwise(F.col("run")[0])
        levels.append(stored(above.select("group", "at", digest.alias("digest"), F.ceil(F.col("n") / BRANCH).alias("n"))))
    paths = levels[-1].select("group", "at", F.array().cast(_PROOF).alias("path"), F.col("digest").alias("top"))
    for level in reversed(levels[:-1]):
        run = Window.partitionBy("group", "up").orderBy("at")
        of = lambda span: F.array_join(F.collect_list("digest").over(span), "")
        sides = F.struct(of(run.rowsBetween(Window.unboundedPreceding, -1)).alias("left"), of(run.rowsBetween(1, Window.unboundedFollowing)).alias("right"))
        here = level.withColumn("up", F.floor(F.col("at") / BRANCH)).select("group", "at", "up", F.when(F.col("n") > 1, F.array(sides)).otherwise(F.array().cast(_PROOF)).alias("own"))
        above = paths.select(F.col("group").alias("g"), F.col("at").alias("a"), "path", "top")
        paths = stored(here.join(above, F.col("group").eqNullSafe(F.col("g")) & (F.col("up") == F.col("a"))).select("group", "at", F.concat("own", "path").alias("path"), "top"))
    return paths.withColumnRenamed("at", "block")


def _joined_suffixes(blocks: DataFrame, size: int) -> DataFrame:
    """blocks with suffix, subroot and root, from an upper tree that no machine holds."""
    groups = _climb(blocks.select("group", "block", "digest", F.ceil(F.col("n") / size).alias("n")))
    tops = groups.filter("block = 0").select("group", F.col("group").alias("key"), F.col("top").alias("leaf"), F.lit(0).alias("salt"))
    placed = _positions(tops.withColumn("group", F.lit(None).cast("string")))
    over = _climb(placed.select("group", F.col("at").alias("block"), F.col("leaf").alias("digest"), "n")).select(F.col("block").alias("at"), F.col("path").alias("rest"), F.col("top").alias("root"))
    over = placed.join(over, "at").select(F.col("key").alias("k"), "rest", "root", F.col("leaf").alias("subroot"))
    full = groups.join(over, F.col("group").eqNullSafe(F.col("k"))).select(F.col("group").alias("g"), F.col("block").alias("b"), F.concat("path", "rest").alias("suffix"), "subroot", "root")
    return blocks.join(full, F.col("group").eqNullSafe(F.col("g")) & (F.col("block") == F.col("b"))).drop("g", "b")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", key: str = "doc_id", carry: dict[str, Column] | None = None, top_nodes: int = TOP_NODES, heights: tuple[int, ...] = HEIGHTS) -> DataFrame:
    """(group, key, leaf, at, proof, subroot, root) for each row of docs, and the columns of `carry`, made of docs.

    proof is an array of (left, right), the joined siblings on each level from the leaf up; see fold() and proof_digest().
    """
    spark = session_ready(docs.sparkSession)
    carry = carry or {}
    leaves = docs.select(F.col(group).cast("string").alias("group"), F.col(key).alias("key"), leaf_of(*[F.col(f) for f in fields]).alias("leaf"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"), F.struct(F.lit(0).alias("_"), *[c.alias(n) for n, c in carry.items()]).alias("carry"))
    leaves = stored(leaves)
    total = leaves.count()
    height = next((h for h in heights if total <= BRANCH**h * top_nodes // 4), heights[-1])
    size = BRANCH**height
    blocks = _blocks(_positions(leaves), height)
    if blocks.count() <= top_nodes:
        upper = Upper([tuple(r) for r in blocks.select("group", "block", "digest").orderBy("group", "block").collect()])
        sent = spark.sparkContext.broadcast(upper)
        above = blocks.select("group", "block", "n", "rows")
    else:
        sent, above = None, _joined_suffixes(blocks, size).select("group", "block", "n", "rows", "suffix", "subroot", "root")

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["at", "proof", "subroot", "root"]
        for b in batches:
            rows = b.column(3)
            leaves = rows.flatten().field("leaf").to_pylist()
            start = 0
            for k, (g, block, n, length) in enumerate(zip(*(b.column(i).to_pylist() for i in range(3)), rows.value_lengths().to_pylist(), strict=True)):
                if sent:
                    tree = sent.value
                    suffix, subroot, root = tree.suffix(g, block), tree.groups[g][-1][0], tree.top[-1][0]
                else:
                    suffix, subroot, root = [(s["left"], s["right"]) for s in b.column(4)[k].as_py()], b.column(5)[k].as_py(), b.column(6)[k].as_py()
                own = rows.slice(k, 1).flatten()
                nodes = leaves[start : start + length]
                start += length
                levels = levels_of(nodes, height if n > size else None)
                for low in range(0, length, 1024):  # proofs are the bulk of what is returned
                    part = range(low, min(length, low + 1024))
                    proofs = [[{"left": left, "right": right} for left, right in siblings(levels, i) + suffix] for i in part]
                    piece = own.slice(low, len(part))
                    made = [piece.field("at"), pa.array(proofs, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))), pa.array([subroot] * len(part)), pa.array([root] * len(part))]
                    yield pa.RecordBatch.from_arrays([pa.array([g] * len(part), pa.string()), piece.field("key"), piece.field("leaf"), piece.field("carry"), *made], names=["group", "key", "leaf", "carry", *names])

    kinds = dict(leaves.dtypes)
    done = above.mapInArrow(finished, f"group string, key {kinds['key']}, leaf string, carry {kinds['carry']}, at bigint, proof {_PROOF}, subroot string, root string")
    return done.select("group", "key", "leaf", "at", "proof", "subroot", "root", *[F.col("carry")[n].alias(n) for n in carry])


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    changed = F.translate("text", _UPPER, _LOWER)
    touched = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    altered = F.when(touched, leaf_of(*[changed if f == "text" else F.col(f) for f in FIELDS]))
    found = manifest(docs, carry={"altered": altered})
    folded = found.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), fold(F.coalesce("altered", "leaf"), F.col("proof")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The levels of each tree as a recursion; siblings by joining every row with its run on each level; folds as a second recursion.
ORACLE = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
doc AS (
  SELECT row_number() OVER () AS r, doc_id, lang, concat(CASE WHEN doc_id IS NULL THEN '-' ELSE concat(strlen(CAST(doc_id AS VARCHAR)), ':', doc_id) END, CASE WHEN source IS NULL THEN '-' ELSE concat(strlen(source), ':', source) END,
      CASE WHEN lang IS NULL THEN '-' ELSE concat(strlen(lang), ':', lang) END, CASE WHEN n_chars IS NULL THEN '-' ELSE concat(strlen(CAST(n_chars AS VARCHAR)), ':', n_chars) END) AS head, text,
    coalesce(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 3, 1) = 0 AS touched
  FROM documents, crc
), hashed AS (
  SELECT *, sha256(concat(head, CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', text) END)) AS leaf,
    CASE WHEN touched AND text IS NOT NULL THEN sha256(concat(head, strlen(text), ':', translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) END AS altered FROM doc
), placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM hashed),
low AS (
  SELECT lang, 0 AS level, pos, leaf AS digest, n FROM placed
  UNION ALL
  SELECT lang, level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 7) // 8) FROM low WHERE n > 1 GROUP BY lang, level, pos // 8
), sub AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, pos, subroot AS digest, n FROM sub
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 7) // 8) FROM high WHERE n > 1 GROUP BY level, pos // 8
), step AS (
  SELECT p.r, l.level, coalesce(string_agg(l.digest, '' ORDER BY l.pos) FILTER (l.pos < p.pos // CAST(pow(8, l.level) AS BIGINT)), '') AS before, coalesce(string_agg(l.digest, '' ORDER BY l.pos) FILTER (l.pos > p.pos // CAST(pow(8, l.level) AS BIGINT)), '') AS after
  FROM placed p JOIN low l ON p.lang IS NOT DISTINCT FROM l.lang AND l.n > 1 AND l.pos // 8 = p.pos // CAST(pow(8, l.level + 1) AS BIGINT) GROUP BY p.r, l.level
  UNION ALL
  SELECT p.r, 100 + l.level, coalesce(string_agg(l.digest, '' ORDER BY l.pos) FILTER (l.pos < s.pos // CAST(pow(8, l.level) AS BIGINT)), ''), coalesce(string_agg(l.digest, '' ORDER BY l.pos) FILTER (l.pos > s.pos // CAST(pow(8, l.level) AS BIGINT)), '')
  FROM placed p JOIN sub s ON p.lang IS NOT DISTINCT FROM s.lang JOIN high l ON l.n > 1 AND l.pos // 8 = s.pos // CAST(pow(8, l.level + 1) AS BIGINT) GROUP BY p.r, l.level
), numbered AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY level) AS k FROM step),
folds AS (
  SELECT r, 1 AS k, coalesce(altered, leaf) AS digest FROM placed
  UNION ALL
  SELECT f.r, f.k + 1, sha256(concat(s.before, f.digest, s.after)) FROM folds f JOIN numbered s ON s.r = f.r AND s.k = f.k
), folded AS (SELECT r, arg_max(digest, k) AS folded_root FROM folds GROUP BY r),
proof AS (SELECT r, sha256(string_agg(concat(before, after), '' ORDER BY level)) AS proof_sha256 FROM step GROUP BY r)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN sub ON placed.lang IS NOT DISTINCT FROM sub.lang JOIN folded USING (r) LEFT JOIN proof USING (r), (SELECT digest AS root FROM high WHERE n = 1)
"""
