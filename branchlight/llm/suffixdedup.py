"""Removal of long repeated byte strings, by merging Burrows-Wheeler transforms of shards.

A string of `LENGTH` bytes that starts at two places or more is removed wherever it lies. All suffixes of a
corpus in one index would be one task's work, so suffixes are first brought together by content:

1. Every window of LENGTH bytes has an anchor, the least hashed gram of GRAM bytes in it (the leftmost of
   equals). The windows with one anchor form a segment of their document. Equal windows have equal
   anchors, so a repeated string can only be found among the segments of one anchor.
2. Equal segments become one with a count. An anchor with one segment needs nothing further.
3. The different segments of an anchor are compared, many anchors in one batch. The batch is cut into
   shards. Of each shard the Burrows-Wheeler transform is taken (over rotations, sorted LENGTH deep).
   The transforms are merged by refining their interleave: it begins as shard after shard, and
   each pass sorts it stably by the preceding symbol, which brings it from depth h to h + STEP without
   looking at a suffix. A symbol is a gram of STEP bytes. The pass in which two neighbours first part gives
   their common prefix; neighbours that never part form an interval of a repeated string.
4. An anchor with more than `most_segments` different segments is dealt anew by more content: windows that start
   within `width` places of each other (counted from the anchor) share all but the rim of their bytes, and this core
   is the key of their piece of the segment. Pieces are counted and compared like segments; a key still crowded is
   dealt by narrower pieces, down to single windows, which need no comparison. So no task gets them all.

Defined results: a null text counts as empty; texts under LENGTH bytes lose nothing; repeated rows are
copies like any others; a null doc_id is kept, and the query reads ids as whole numbers; windows never cross documents; a very long text is cut into segments
and judged whole; there are no ties; an empty table gives none; other columns of the input, of any name, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import as_bytes, session_ready, table

LENGTH, GRAM, STEP = 400, 32, 40
PASSES = LENGTH // STEP
#: Places of a piece of a crowded segment, level by level.
WIDTHS = (48, 8, 1)
#: Bytes of one scan for anchors, of one shard, and of one batch of anchors.
SCAN, SHARD, BATCH = 1 << 19, 1 << 14, 60_000
MOST_SEGMENTS = 1500
_PLACE = np.uint64((1 << 20) - 1)
#: Odd multipliers of the gram hash, derived from the golden ratio's fraction.
_MIX = [np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 64)) for i in range(5)]


def gram_hashes(data: bytes) -> np.ndarray:
    """A hash of the GRAM bytes at each place."""
    n = len(data) - GRAM + 1
    word = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    h = np.zeros(n, np.uint64)
    for i in range(GRAM // 8):
        part = word[8 * i : 8 * i + n] * _MIX[i]
        h ^= (part ^ (part >> np.uint64(29))) * _MIX[i + 1]
    h ^= h >> np.uint64(32)
    h *= _MIX[0]
    return h ^ (h >> np.uint64(31))


def least_places(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` neighbours, from minima that run forward and back in blocks."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of short texts laid end to end: text number, first and last window of each segment, its anchor's
    hash and its place in the concatenation."""
    data = b"".join(texts)
    none = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none
    h = gram_hashes(data)
    places = np.arange(len(h), dtype=np.uint64)
    anchor = (least_places((h & ~_PLACE) | places, LENGTH - GRAM + 1) & _PLACE).astype(np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    owner = np.searchsorted(ends, np.arange(len(anchor)), side="right")
    inside = np.arange(len(anchor)) + LENGTH <= ends[owner]
    new = np.empty(len(anchor), bool)
    new[0] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new & inside)
    run = np.cumsum(new)
    last = first + np.bincount(run[inside], minlength=run[-1] + 1)[run[first]] - 1
    begin = ends[owner[first]] - sizes[owner[first]]
    return owner[first], first - begin, last - begin, h[anchor[first]].view(np.int64), first


def pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Text numbers, offsets and bytes of pieces of at most SCAN bytes together; pieces of one text overlap
    so that each window is in one of them."""
    numbers, offsets, parts, size = [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - LENGTH + 1, 0), SCAN // 2):
            part = t[at : at + SCAN // 2 + LENGTH - 1]
            if size + len(part) > SCAN and parts:
                yield numbers, offsets, parts
                numbers, offsets, parts, size = [], [], [], 0
            numbers.append(i)
            offsets.append(at)
            parts.append(part)
            size += len(part)
    if parts:
        yield numbers, offsets, parts


def ordered(column: np.ndarray) -> np.ndarray:
    """Places in the stable order of integers from 0 to 2^31; numpy sorts 16 bits by radix."""
    order = np.argsort(column.astype(np.uint16), kind="stable")
    if len(column) and int(column.max()) >> 16:
        order = order[np.argsort((column >> 16).astype(np.uint16)[order], kind="stable")]
    return order


def ranks(*columns: np.ndarray) -> np.ndarray:
    """Dense ranks of the rows of columns of small non-negative integers."""
    order = ordered(columns[-1])
    for c in columns[-2::-1]:
        order = order[ordered(c[order])]
    new = np.zeros(len(order), np.int64)
    for c in columns:
        there = c[order]
        new[1:] |= there[1:] != there[:-1]
    found = np.empty(len(order), np.int64)
    found[order] = np.cumsum(new)
    return found


def longer(shards: list[np.ndarray], width: int, wanted: int) -> list[np.ndarray]:
    """Ranks over all shards of the `wanted` bytes that start at each place, going round, from those of `width`."""
    cuts = np.cumsum([len(s) for s in shards])[:-1]
    while width < wanted:
        by = min(width, wanted - width)
        shards = np.split(ranks(np.concatenate(shards), np.concatenate([np.roll(s, -by) for s in shards])), cuts)
        width += by
    return shards


def words_of(shard: np.ndarray) -> np.ndarray:
    """The eight bytes that start at each place, going round, as one number."""
    data = np.concatenate([shard, np.resize(shard, 7)]).astype(np.uint64)
    word = np.zeros(len(shard), np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | data[i : i + len(shard)]
    return word


def sorted_rotations(grams: np.ndarray) -> np.ndarray:
    """Places in the order of their LENGTH bytes, for one shard."""
    return ordered(longer([grams], STEP, LENGTH)[0])


def merged(shards: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard and place of each rotation in merged order, and its common prefix with the one before, in
    steps of STEP bytes up to LENGTH."""
    sizes = [len(s) for s in shards]
    # Grams are ranked over the batch so that shards share an alphabet.
    eight = np.unique(np.concatenate([words_of(x) for x in shards]), return_inverse=True)[1]
    alphabet = longer(np.split(eight, np.cumsum(sizes)[:-1]), 8, STEP)
    kind = np.uint16 if max(int(a.max()) for a in alphabet) < 1 << 16 else np.int32
    orders = [sorted_rotations(a) for a in alphabet]
    transform = np.concatenate([np.roll(a, STEP)[o] for a, o in zip(alphabet, orders, strict=True)]).astype(kind)
    starts = np.cumsum([0, *sizes[:-1]])
    interleave = np.repeat(np.arange(len(shards), dtype=np.uint8 if len(shards) <= 256 else np.uint16), sizes)
    total = len(interleave)
    block = np.zeros(total, np.int32)
    common = np.full(total, PASSES, np.int32)
    common[0] = 0
    for h in range(PASSES):
        symbols = np.empty(total, kind)
        symbols[np.argsort(interleave, kind="stable")] = transform
        order = ordered(symbols)
        interleave = interleave[order]
        symbols, block = symbols[order], block[order]
        parts = np.empty(total, bool)
        parts[0] = True
        parts[1:] = (symbols[1:] != symbols[:-1]) | (block[1:] != block[:-1])
        block = np.cumsum(parts, dtype=np.int32)
        common[parts & (common > h)] = h
        if int(block[-1]) == total:
            break
    by_shard = np.argsort(interleave, kind="stable")
    places = np.empty(total, np.int64)
    places[by_shard] = np.concatenate(orders)
    return interleave, places + starts[interleave], common


def repeated_windows(texts: list[bytes], counts: list[int]) -> list[np.ndarray]:
    """Of segments with the number of times each occurs: the windows that start at two places or more."""
    shards, shard, size = [], [], 0
    for t in texts:
        shard.append(t)
        size += len(t)
        if size >= SHARD:
            shards.append(np.frombuffer(b"".join(shard), np.uint8))
            shard, size = [], 0
    if shard:
        shards.append(np.frombuffer(b"".join(shard), np.uint8))
    _, places, common = merged(shards)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    weight = np.repeat(np.array(counts, np.int64), sizes)
    weight[np.arange(len(weight)) + LENGTH > np.repeat(ends, sizes)] = 0  # no window: it would leave the segment
    weight = weight[places]
    interval = np.cumsum(common < PASSES) - 1
    many = np.bincount(interval, weights=weight)[interval] >= 2
    hit = np.zeros(len(places), bool)
    hit[places] = many & (weight > 0)
    return [np.flatnonzero(x) for x in np.split(hit, ends[:-1])]


def runs(windows: np.ndarray) -> list[tuple[int, int]]:
    """First and last of neighbouring windows."""
    if not len(windows):
        return []
    cut = np.flatnonzero(np.diff(windows) > 1)
    return list(zip(windows[np.concatenate(([0], cut + 1))].tolist(), windows[np.concatenate((cut, [len(windows) - 1]))].tolist(), strict=True))


_RUNS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
_KEY = ("doc", "same")


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [t or b"" for t in as_bytes(b.column(2))]
        for numbers, offsets, parts in pieces(texts):
            owner, first, last, anchor, at = segments(parts)
            data = b"".join(parts)
            names = [xxhash.xxh3_128_digest(data[p : p + n]) for p, n in zip(at.tolist(), (last - first + LENGTH).tolist(), strict=True)]
            rows, shift = np.array(numbers)[owner], np.array(offsets)[owner]
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(names, pa.binary()), b.column(0).take(take), b.column(1).take(take), pa.array((first + shift).astype(np.int32)), pa.array((last + shift).astype(np.int32))], names=["anchor", "name", *_KEY, "first", "last"])


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the segments wanted of each text."""
    for b in batches:
        for t, wanted in zip(as_bytes(b.column(0)), b.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([w["anchor"] for w in wanted], pa.int64()), pa.array([w["name"] for w in wanted], pa.binary()), pa.array([w["n"] for w in wanted], pa.int64()), pa.array([t[w["first"] : w["last"] + LENGTH] for w in wanted], pa.binary())], names=["anchor", "name", "n", "bytes"])


def _compare_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of repeated windows; a row has all segments of an anchor, and rows are compared many at once."""
    held: list[tuple] = []
    size = 0

    def compared(rows: list[tuple]) -> pa.RecordBatch:
        found = [runs(w) for w in repeated_windows([r[3] for r in rows], [r[2] for r in rows])]
        keep = [(r, f) for r, f in zip(rows, found, strict=True) if f]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r, _ in keep], pa.int64()), pa.array([r[1] for r, _ in keep], pa.binary()), pa.array([[{"a": a, "b": b} for a, b in f] for _, f in keep], _RUNS)], names=["anchor", "name", "runs"])

    for b in batches:
        for anchor, of_anchor in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if size >= BATCH:
                yield compared(held)
                held, size = [], 0
            rows = [(anchor, *row) for row in zip(*[c.to_pylist() for c in of_anchor.values.flatten()], strict=True)]
            held += rows
            size += sum(len(r[3]) for r in rows)
    if held:
        yield compared(held)


def _piece_rows(width: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of crowded segments: windows by their distance from the anchor, `width` distances a piece."""
        for b in batches:
            out = []
            for anchor, name, n, data in zip(*[c.to_pylist() for c in b.columns], strict=True):
                last = len(data) - LENGTH
                h = gram_hashes(data)
                place = int(np.argmin((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)))
                for part in range((place - last) // width, place // width + 1):
                    # Windows whose distance to the anchor is in [part * width, (part + 1) * width).
                    first, final = max(0, place - (part + 1) * width + 1), min(last, place - part * width)
                    core = data[max(0, place - part * width) : place - (part + 1) * width + 1 + LENGTH]
                    piece = data[first : final + LENGTH]
                    key = xxhash.xxh3_64_intdigest(core, seed=(part + 1000) & 0xFFFF) - (1 << 63)
                    out.append((anchor, name, first, key, xxhash.xxh3_128_digest(piece), n, piece))
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["of", "whose", "base", "anchor", "name", "n", "bytes"])

    return cut


_RUN_DDL = "anchor long, name binary, runs array<struct<a:int,b:int>>"


def repeated_runs(docs: DataFrame, most_segments: int = MOST_SEGMENTS) -> DataFrame:
    """(doc, same, runs): first and last windows, in document places, of strings that occur elsewhere too.

    docs: doc, same (a hash that tells texts under one doc apart), text.
    """
    found = docs.select(*_KEY, "text").mapInArrow(_segment_rows, "anchor long, name binary, doc long, same long, first int, last int")
    unique = found.groupBy("anchor", "name").agg(F.count("*").alias("n"), F.min(F.struct("doc", "same", "first", "last")).alias("at"))
    # The same columns of unique in both places, so that one exchange serves them.
    per_anchor = unique.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("n").alias("all"), F.min("at").alias("at")).filter("all > 1 and at is not null")
    unique = unique.join(per_anchor.select(F.col("anchor").alias("k"), "kinds"), F.col("anchor") == F.col("k")).drop("k").checkpoint()

    compare = unique.filter("kinds > 1").select("kinds", F.struct("anchor", "name", "n", F.col("at.first").alias("first"), F.col("at.last").alias("last")).alias("w"), F.col("at.doc").alias("d"), F.col("at.same").alias("s"))
    wanted = compare.groupBy("d", "s").agg(F.collect_list("w").alias("wanted"))
    cut = docs.join(wanted, F.col("doc").eqNullSafe(F.col("d")) & (F.col("same") == F.col("s"))).select("text", "wanted")
    cut = cut.mapInArrow(_cut_rows, "anchor long, name binary, n long, bytes binary").checkpoint()
    # A segment that occurs twice is repeated as a whole, whatever else is.
    whole = unique.filter("n > 1").select("anchor", "name", F.array(F.struct(F.lit(0).alias("a"), (F.col("at.last") - F.col("at.first")).alias("b"))).alias("runs"))
    answers = compared(cut, most_segments, WIDTHS).unionByName(whole).groupBy("anchor", "name").agg(F.flatten(F.collect_list("runs")).alias("runs")).checkpoint()
    placed = found.join(answers, ["anchor", "name"]).withColumn("mine", F.transform("runs", lambda r: F.struct((r["a"] + F.col("first")).alias("a"), (r["b"] + F.col("first")).alias("b"))))
    return placed.groupBy(*_KEY).agg(F.flatten(F.collect_set("mine")).alias("runs"))


def compared(cut: DataFrame, most_segments: int, widths: tuple[int, ...]) -> DataFrame:
    """(anchor, name, runs) of the segments cut (anchor, name, n, bytes): windows of one that are in another too."""
    crowded = cut.groupBy("anchor").count().filter(F.col("count") > most_segments).select("anchor").checkpoint()
    if not widths or crowded.isEmpty():
        # Grouped, not dealt by repartition: behind a join on the anchor Spark drops that, and may then read or split the join's partitions at will.
        grouped = cut.groupBy("anchor").agg(F.collect_list(F.struct("name", "n", "bytes")).alias("of_anchor"))
        return grouped.mapInArrow(_compare_rows, _RUN_DDL)
    few = compared(cut.join(crowded, "anchor", "left_anti"), most_segments, ())
    rows = cut.join(crowded, "anchor", "left_semi").mapInArrow(_piece_rows(widths[0]), "of long, whose binary, base int, anchor long, name binary, n long, bytes binary").checkpoint()
    unique = rows.groupBy("anchor", "name").agg(F.sum("n").alias("n"), F.first("bytes").alias("bytes")).checkpoint()
    whole = unique.filter("n > 1").select("anchor", "name", F.array(F.struct(F.lit(0).alias("a"), (F.length("bytes") - LENGTH).alias("b"))).alias("runs"))
    found = whole if widths[0] == 1 else compared(unique, most_segments, widths[1:]).unionByName(whole)
    back = rows.select("of", "whose", "base", "anchor", "name").join(found, ["anchor", "name"])
    shifted = F.transform("runs", lambda r: F.struct((r["a"] + F.col("base")).alias("a"), (r["b"] + F.col("base")).alias("b")))
    return few.unionByName(back.select(F.col("of").alias("anchor"), F.col("whose").alias("name"), shifted.alias("runs")))


def spans_of(found: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal byte spans that runs of windows cover."""
    spans: list[list[int]] = []
    for a, b in sorted((r["a"], r["b"] + LENGTH) for r in found or ()):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return [(a, b) for a, b in spans]


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for t, found in zip(as_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
            t = t or b""
            spans = spans_of(found)
            ends = [0, *[e for _, e in spans]]
            kept = b"".join(t[e:s] for e, s in zip(ends, [*[s for s, _ in spans], len(t)], strict=True))
            out.append((len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_segments: int = MOST_SEGMENTS) -> DataFrame:
    """doc (the id), text and runs of every row: windows of LENGTH bytes that are repeated (null: none)."""
    session_ready(docs.sparkSession)
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(F.col(text).cast("string")).alias("same"), F.col(text).cast("string").alias("text"))
    found = repeated_runs(keyed, most_segments).withColumnsRenamed({"doc": "d", "same": "s"})
    return keyed.join(found, F.col("doc").eqNullSafe(F.col("d")) & (F.col("same") == F.col("s")), "left").select("doc", "text", "runs")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.mapInArrow(_kept_rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


ORACLE = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT r, a, substr(h, 2 * a + 1, 1198) AS h, least(200, len(h) // 2 - 399 - a) AS n FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 399, 200)) AS a FROM d WHERE len(h) >= 800)),
w AS (SELECT r, a + i AS p, hash(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT r, a, h, unnest(range(n)) AS i FROM c)),
many AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
hit AS (SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= 400 THEN 0 ELSE 1 END AS new FROM w SEMI JOIN many USING (k)),
span AS (SELECT r, min(p) AS s, max(p) + 400 AS e FROM (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS g FROM hit) GROUP BY r, g),
cut AS (SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS b FROM span),
kept AS (SELECT r, sum(e - s) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * b + 1, 2 * (s - b)), '' ORDER BY s) || substr(any_value(h), 2 * max(e) + 1) AS x FROM cut JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(x, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
