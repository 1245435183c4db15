"""SimHash near-duplicates by tiled exact comparison.

A text is lower-cased (A-Z only) and cut into words at ASCII blanks; its shingles are three words
joined by a blank (all words if fewer; none: fingerprint zero). A bit of the fingerprint is set if it
is set in more than half of the shingles' XXH64 (seed 42), repeats counted.

Equal fingerprints are one node. Nodes are dealt into cells by the population counts of five lanes of
bits. Differing bits change lane counts by one each, so two cells whose counts differ by more than
the radius altogether cannot hold a link: the pair is skipped (by a binomial estimate 1.5 % of pairs of random fingerprints
are in cells that remain; four lanes leave 5 %, a single count 60 %). All other pairs of cells are compared
whole, by numpy exclusive-or and bit counts. There are at most 14^4 * 13 cells whatever the
input; a crowded one is split into several tiles. From each comparison only a spanning forest of the
links found goes on, never all pairs of a group, and components join the forests exactly.

near_duplicates(similar=True) also links texts whose sets of five-word shingles have a Jaccard similarity of `SIMILAR` or more, which three differing bits rarely
reach: `BANDS` hashes of `ROWS` minima each bring texts together, in each group every text is paired with one of it (another for each band), and each pair is
decided on the sets themselves. That finds a pair at the threshold with a probability of 0.9998, were all pairs of a group looked at; README has the measured recall.
Such links join fingerprints, so they add to the components and take nothing away; a text without an id takes no part in them.

Defined results: a null text has no words; repeated rows share fingerprint and component; a null
doc_id takes part but is never a component's id unless the component has no other; empty tables give none;
a very long text is read whole; columns of documents of any name are kept, but one named as the result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._graph import connected_components
from ._shared import as_bytes, free, session_ready, struct_of, table

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Bits of each lane; a cell is its counts as digits to the base 32, so that neighbours differ by a fixed number and none borrows.
LANES, DIGIT = (13, 13, 13, 13, 12), 32
#: Fingerprints of a tile, tiles of a visiting column, and cells of one numpy comparison.
TILE, VISITORS, CELLS = 2048, 8, 1 << 20
_LINKS = "u long, v long"
#: Words of a shingle, similarity and minima of the links by shingles.
WIDE, SIMILAR, BANDS, ROWS = 5, 0.8, 16, 4
_ODD = np.random.default_rng(SEED).integers(1, 1 << 63, (2, BANDS * ROWS), np.uint64) | np.uint64(1)


def fingerprint(text: bytes | None) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = min(SHINGLE, len(words)) - 1
    spans = zip(starts[: len(words) - last].tolist(), ends[last:].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * votes > len(hashes)).tolist()))


def shingles(text: bytes | None) -> np.ndarray:
    """Distinct hashes of the runs of five words (all words if fewer; none without words)."""
    words = (text or b"").lower().split()
    n = min(WIDE, len(words))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), SEED) for i in range(len(words) - n + 1)), np.uint64)) if words else np.empty(0, np.uint64)


def bands(text: bytes | None) -> list[int]:
    """One hash for each band of minima; none for a text without words."""
    have = shingles(text)
    if not len(have):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(have), 1 << 12):
        mixed = have[at : at + (1 << 12), None] * _ODD[0] + _ODD[1]
        np.minimum(least, (mixed ^ (mixed >> np.uint64(29))).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) - (1 << 63) for i in range(BANDS)]


def similar_links(docs: DataFrame, prints: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(u, v): fingerprints of texts that are similar by their five-word shingles. prints: (u, first, bands) of one text for each fingerprint."""
    at = prints.filter("first is not null").select("u", F.posexplode("bands").alias("i", "band"))
    # In each group the text that a hash of fingerprint and band puts first; a crowd is one row there.
    first = at.groupBy("i", "band").agg(F.min(F.struct(F.xxhash64("u", "i"), "u")).alias("f"), F.count("*").alias("n")).filter("n > 1").select(F.col("i").alias("i_"), F.col("band").alias("band_"), F.col("f.u").alias("v"))
    pairs = at.join(first, (F.col("i") == F.col("i_")) & (F.col("band") == F.col("band_"))).filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    asked = pairs.select(F.explode(F.array("u", "v")).alias("u")).distinct().join(prints.select("u", "first"), "u")

    @F.arrow_udf("struct<u:bigint,set:binary>")
    def sets(column: pa.Array) -> pa.Array:
        texts = as_bytes(column)
        return struct_of({"u": (pa.int64(), np.array([fingerprint(t) for t in texts], np.uint64).astype(np.int64).tolist()), "set": (pa.binary(), [shingles(t).tobytes() for t in texts])})

    read = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).join(asked, F.col("id") == F.col("first"))
    held = read.withColumn("s", sets.asNondeterministic()("t")).filter("s.u = u").groupBy("u").agg(F.min("s.set").alias("set")).checkpoint()

    @F.arrow_udf("boolean")
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        found = []
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            found.append(both >= SIMILAR * (len(x) + len(y) - both))
        return pa.array(found)

    met = pairs.join(held.withColumnRenamed("set", "a"), "u").join(held.select(F.col("u").alias("v"), F.col("set").alias("b")), "v")
    return met.filter(alike(F.col("a"), F.col("b"))).select("u", "v")


def with_fingerprint(docs: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """docs with the 64 bits of the fingerprint as a long."""
    session_ready(docs.sparkSession)

    @F.arrow_udf("bigint")
    def bits(column: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t) for t in as_bytes(column)], np.uint64).astype(np.int64))

    return docs.withColumn(into, bits.asNondeterministic()(F.col(text)))


def _cell():
    """Population counts of the lanes of u as one number."""
    cell, at = F.lit(0).cast("long"), 0
    for i, bits in enumerate(LANES):
        count = F.bit_count(F.shiftrightunsigned("u", at).bitwiseAND(F.lit((1 << bits) - 1).cast("long")))
        cell, at = cell + count * F.lit(DIGIT**i).cast("long"), at + bits
    return cell


def _steps() -> list[int]:
    """Differences of cells within the radius; of two opposite ones the one that sorts last, and zero."""
    near = [d for d in product(range(-RADIUS, RADIUS + 1), repeat=len(LANES)) if sum(map(abs, d)) <= RADIUS and d >= (0,) * len(LANES)]
    return [sum(x * DIGIT**i for i, x in enumerate(d)) for d in near]


def forest(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between a and b (uint64 each)."""
    edges: list[tuple[int, int]] = []
    root = of_a = of_b = None
    height = max(1, CELLS // max(1, len(b)))
    for top in range(0, len(a), height):
        part = a[top : top + height]
        near = np.bitwise_count(part[:, None] ^ b[None, :]) <= radius
        near &= part[:, None] != b[None, :]
        rows = np.flatnonzero(near.any(axis=1)).tolist()
        if rows and root is None:
            place = np.unique(np.concatenate((a, b)), return_inverse=True)[1]
            root, of_a, of_b = np.arange(len(a) + len(b)), place[: len(a)], place[len(a) :]
        for i in rows:
            there = np.flatnonzero(near[i])
            # One partner of each group that this one is not in yet.
            groups, first = np.unique(root[of_b[there]], return_index=True)
            for group, y in zip(groups.tolist(), there[first].tolist(), strict=True):
                mine = root[of_a[top + i]]
                if group != mine:
                    edges.append((int(part[i]), int(b[y])))
                    root[root == group] = mine
    return edges


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each home tile with the tiles that visit it; rows come spot by spot, the home tile first."""

    def linked(rows: pa.Table) -> pa.RecordBatch:
        spots = np.stack([rows.column(i).to_numpy() for i in range(3)])
        bits = rows.column("bits").combine_chunks()
        values, offsets = bits.values.to_numpy().view(np.uint64), bits.offsets.to_numpy()
        home = rows.column("home").to_numpy()
        cuts = [0, *(np.flatnonzero((spots[:, 1:] != spots[:, :-1]).any(axis=0)) + 1).tolist(), len(home)]
        edges = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            # A part of a crowded cell may have got no fingerprint, and then no home tile.
            if home[a] and b - a > 1:
                edges += forest(values[offsets[a] : offsets[a + 1]], values[offsets[a + 1] : offsets[b]])
        found = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])

    held: list[pa.RecordBatch] = []
    spot = None
    for b in batches:
        if not len(b):
            continue
        spots = np.stack([b.column(i).to_numpy() for i in range(3)])
        last = len(b) - int(np.argmax((spots[:, ::-1] != spots[:, -1:]).any(axis=0))) if (spots != spots[:, -1:]).any() else 0
        if held and (last or (spots[:, 0] != spot).any()):
            yield linked(pa.Table.from_batches([*held, b.slice(0, last)]))
            held = []
        elif last:
            yield linked(pa.Table.from_batches([b.slice(0, last)]))
        held.append(b.slice(last))
        spot = spots[:, -1]
    if held:
        yield linked(pa.Table.from_batches(held))


def links(prints: DataFrame) -> DataFrame:
    """Spanning forests of the links among the distinct fingerprints u."""
    prints = prints.select("u", _cell().alias("cell"))
    # At most 14^4 * 13 rows of two numbers, whatever the input.
    keys = prints.groupBy("cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    tiles = prints.join(F.broadcast(keys), "cell").withColumn("part", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int"))
    tiles = tiles.groupBy("cell", "part").agg(F.collect_list("u").alias("bits"))
    # Where a tile goes as a guest: to every tile of an existing cell within the radius, each pair once.
    visits = tiles.withColumn("d", F.explode(F.array(*[F.lit(d).cast("long") for d in _steps()]))).withColumn("h", F.col("cell") + F.col("d")).drop("d")
    visits = visits.join(F.broadcast(keys.withColumnRenamed("cell", "h")), "h").withColumn("h_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    visits = visits.filter("h <> cell or part >= h_part").withColumn("column", F.floor(F.col("part") / VISITORS).cast("int"))
    spot = ["h", "h_part", "column"]
    widest = keys.agg(F.max("parts")).first()[0] or 1
    homes = tiles.select(F.col("cell").alias("h"), F.col("part").alias("h_part"), F.explode(F.sequence(F.lit(0), F.lit((widest - 1) // VISITORS))).alias("column"), "bits", F.lit(True).alias("home"))
    dealt = homes.unionByName(visits.select(*spot, "bits", F.lit(False).alias("home")))
    return dealt.repartition(*spot).sortWithinPartitions(*spot, F.desc("home")).mapInArrow(_compare, _LINKS)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", into: str = "near", keep_text: bool = True, similar: bool = False) -> DataFrame:
    """docs with a struct `into` of fingerprint (16 hex digits) and component (its smallest doc_id). With `similar`, texts with similar five-word shingles are linked, too.

    Without the text, fingerprints are computed once and kept; with it, once more at the end,
    which costs less than keeping a second copy of the texts.
    """
    session_ready(docs.sparkSession)
    docs = docs.drop(into)
    bits, u, component = (free(n, docs) for n in ("bits", "u", "component_of"))
    dense = with_fingerprint(docs, text, bits)
    if not keep_text:
        dense = dense.drop(text).checkpoint()
    if similar:

        # One function for both, so that a text goes to one Python worker, not to two in a row.
        @F.arrow_udf("struct<u:bigint,bands:array<bigint>>")
        def sketched(column: pa.Array) -> pa.Array:
            texts = as_bytes(column)
            return struct_of({"u": (pa.int64(), np.array([fingerprint(t) for t in texts], np.uint64).astype(np.int64).tolist()), "bands": (pa.list_(pa.int64()), [bands(t) for t in texts])})

        sketch = docs.select(F.col(doc_id).alias("id"), sketched.asNondeterministic()(F.col(text)).alias("s")).select("id", "s.u", "s.bands")
        # Of rows that share a fingerprint the one with the smallest id is looked at; its bands are the same for all copies.
        prints = sketch.groupBy("u").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "bands"))).alias("f")).select("u", F.col("f.id").alias("first"), F.coalesce("f.bands", F.array().cast("array<bigint>")).alias("bands")).checkpoint()
        found = links(prints.select("u")).unionByName(similar_links(docs, prints, doc_id, text))
    else:
        prints = dense.groupBy(F.col(bits).alias("u")).agg(F.min(F.col(doc_id)).alias("first")).checkpoint()
        found = links(prints.select("u"))
    roots = connected_components(found.checkpoint())
    named = prints.select("u", "first").join(roots.withColumnRenamed("node", "u"), "u", "left").withColumn("root", F.coalesce("root", "u"))
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    lookup = named.join(least, "root").select(F.col("u").alias(u), F.col("component").alias(component))
    joined = dense.join(lookup, F.col(bits) == F.col(u), "left")
    return joined.withColumn(into, F.struct(F.lpad(F.lower(F.hex(bits)), 16, "0").alias("fingerprint"), F.col(component).alias("component"))).drop(bits, u, component)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_duplicates(docs, keep_text=False)
    return found.select("doc_id", F.col("near.fingerprint").alias("fingerprint"), F.col("near.component").alias("component_id"))
