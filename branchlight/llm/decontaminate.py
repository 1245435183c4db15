"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Texts are lower-cased (A-Z only) and cut into words: runs of a-z, 0-9 and every non-ASCII
byte. Each window of `window` consecutive words of a benchmark item is a pattern; an item with
fewer words, but some, is one pattern of its own length. Patterns of one length form a searcher:

* the block is the last two words of a window (one word for one-word patterns); the shift table
  gives for each block the smallest distance from its rightmost place in any pattern to the
  pattern's end, so that positions which cannot end an occurrence are skipped;
* blocks with shift zero lead to a bucket of patterns with that suffix;
* bucket members are compared word by word, which confirms the occurrence.

The benchmark is a stated query set. It is read in blocks of at most `block_bytes`, each broadcast by itself, so neither the driver nor a
worker holds more of it at once than that (its tables take some hundred times the bytes; workers keep those of `HELD` blocks). Documents are
read once: a task takes some `BUFFER` bytes of texts and searches them for one block after the other.

Defined results: a null text has no words; an empty benchmark hits nothing; items without words
are ignored; a null item id is searched for but not listed; repeated item rows count once;
repeated document rows each get a row; a very long text is searched whole; an empty table gives none; columns of documents of any name are
kept, but one named as the result is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ._shared import as_bytes, session_ready, struct_of, table

WINDOW = 10
#: Bytes of items in one broadcast, blocks whose tables a worker keeps, and bytes of texts that it searches for all blocks in turn.
BLOCK_BYTES, HELD, BUFFER = 1 << 20, 8, 16 << 20
_WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: A-Z become a-z, every byte that is in no word becomes a blank.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _WORD_BYTES else 0x20 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class Searcher:
    """Wu-Manber tables for patterns of one length, in words."""

    def __init__(self, patterns: dict[tuple[bytes, ...], frozenset]):
        self.size = size = len(next(iter(patterns)))
        self.block = block = min(2, size)
        self.farthest = size - block + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, list[tuple[tuple[bytes, ...], frozenset]]] = {}
        for words, owners in patterns.items():
            for end in range(block, size + 1):
                key = b" ".join(words[end - block : end])
                self.shift[key] = min(self.shift.get(key, self.farthest), size - end)
            self.buckets.setdefault(b" ".join(words[size - block :]), []).append((words, owners))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, frozenset]]:
        """Start of each occurrence and its items."""
        size, shift_of, far, n = self.size, self.shift.get, self.farthest, len(words)
        at = size - 1  # the last word of the window looked at
        pair = self.block == 2
        while at < n:
            key = words[at - 1] + b" " + words[at] if pair else words[at]
            shift = shift_of(key, far)
            if shift:
                at += shift
                continue
            start = at - size + 1
            here = None
            for pattern, owners in self.buckets[key]:
                if here is None:
                    here = tuple(words[start : at + 1])
                if here == pattern:
                    yield start, owners
            at += 1


def searchers(items: Iterable[tuple[str | None, bytes | None]], window: int = WINDOW) -> list[Searcher]:
    by_size: dict[int, dict[tuple[bytes, ...], frozenset]] = {}
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        mine = frozenset((item,))  # one object for all windows of an item
        for i in range(len(words) - size + 1 if size else 0):
            held = by_size.setdefault(size, {})
            key = tuple(words[i : i + size])
            held[key] = mine | held[key] if key in held else mine
    return [Searcher(p) for _, p in sorted(by_size.items())]


def merged(found: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the maximal runs of hit words."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(found):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _blocks(rows: Iterable, limit: int) -> Iterator[list[tuple[str | None, bytes | None]]]:
    block: list[tuple[str | None, bytes | None]] = []
    size = 0
    for item, text in rows:
        text = bytes(text) if text is not None else None
        block.append((item, text))
        size += len(text or b"") + 16
        if size > limit:
            yield block
            block, size = [], 0
    if block:
        yield block


#: Tables that this worker keeps, by content of the block and window.
_KEPT: dict[tuple[str, int], list[Searcher]] = {}


def _tables(key: str, window: int, items) -> list[Searcher]:
    if (key, window) not in _KEPT:
        # Blocks come round in one order, so the last one in is the one to give way.
        while len(_KEPT) >= HELD:
            _KEPT.popitem()
        _KEPT[key, window] = searchers(items.value, window)
    return _KEPT[key, window]


_HITS = "struct<n_words:bigint,starts:array<bigint>,ends:array<bigint>,items:array<string>>"


def find_contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, into: str = "leak", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with a column `into`: n_words, starts and ends of hit word runs, items (sorted strings)."""
    session_ready(spark)
    rows = benchmark.select(F.col(item_id).cast("string"), F.col(item_text).cast("binary")).toLocalIterator()
    blocks = [(hashlib.sha256(repr(items).encode()).hexdigest(), spark.sparkContext.broadcast(items)) for items in _blocks(rows, block_bytes)]
    rest = docs.drop(into)
    at = rest.columns.index(text)

    def searched(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [words_of(t) for b in held for t in as_bytes(b.column(at))]
        found: list[list[tuple[int, int]]] = [[] for _ in words]
        items: list[set] = [set() for _ in words]
        for key, block in blocks:
            tables = _tables(key, window, block)
            for w, spans, names in zip(words, found, items, strict=True):
                for s in tables:
                    for start, owners in s.find(w):
                        spans.append((start, start + s.size))
                        names |= owners
        first = 0
        for b in held:
            part = slice(first, first + len(b))
            runs = [merged(x) for x in found[part]]
            leak = struct_of(
                {
                    "n_words": (pa.int64(), list(map(len, words[part]))),
                    "starts": (pa.list_(pa.int64()), [x for x, _ in runs]),
                    "ends": (pa.list_(pa.int64()), [x for _, x in runs]),
                    "items": (pa.list_(pa.string()), [sorted(x - {None}) for x in items[part]]),
                }
            )
            yield pa.RecordBatch.from_arrays([*b.columns, leak], names=[*b.schema.names, into])
            first += len(b)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += b.column(at).nbytes
            if size >= BUFFER:
                yield from searched(held)
                held, size = [], 0
        yield from searched(held)

    return rest.mapInArrow(search, StructType([*rest.schema.fields, StructField(into, _parse_datatype_string(_HITS))]))


def n_hit(leak: str = "leak"):
    return F.aggregate(F.zip_with(f"{leak}.starts", f"{leak}.ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(spark, docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("leak.n_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("leak.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("leak.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("leak.starts") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), pat AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM iw WHERE len(w) > 0)
), occ AS (
  SELECT DISTINCT d.doc_id, d.i, p.m, p.item_id
  FROM (SELECT doc_id, s.m AS m, i, array_to_string(w[i : i + s.m - 1], ' ') AS k
        FROM (SELECT DISTINCT m FROM pat) s, (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM dw) t
        WHERE i + s.m - 1 <= len(w)) d JOIN pat p ON d.m = p.m AND d.k = p.k
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM occ) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
