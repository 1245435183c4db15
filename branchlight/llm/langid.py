"""Language identification by cross-parsing entropy.

For each language a bounded reference text is taken from labelled training documents, and its
suffix automaton is built. A text is then parsed greedily against each language: a phrase is the
longest prefix of what remains that occurs somewhere in the reference; a byte that occurs nowhere
is a phrase by itself. The language that needs the fewest phrases per byte wins.

Parsing needs the automaton's forward arcs only: where the next byte has no arc, the phrase ends and
the next one starts with that byte at the root. So arcs and restarts make one dense table, and many
blocks of text step through it together. A text is cut into blocks of `block` bytes, each parsed from
the root; every byte of the text is parsed.

Texts are lower-cased; every ASCII character but a letter becomes a blank and runs of blanks become one. The
sample is a stated one: of the training documents of each language whose text has at most `TEXT_BYTES` bytes, taken in the order of a hash of
their id, whole texts up to `sample_docs` documents, until they fill `reference_bytes` bytes. A language that has only
longer texts gives its shortest one, up to `reference_bytes` bytes.

Defined results: a null text, a text without a letter, and any text when nothing can be learned get
`und` with score 0; a very long text is parsed whole; ties go to the language that sorts first; a null lang is never learned; each row
is judged by itself; an empty table gives none; columns of documents of any name are kept, but one named as the result is replaced. The score is the winner's lead, (second - first) / second in phrases per byte,
carried to 0..1; with one language alone it is 1.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import session_ready, struct_of, table, training_bucket

UNDETERMINED = "und"
SAMPLE_DOCS = 64
REFERENCE_BYTES, TEXT_BYTES = 32 << 10, 4 << 10
BLOCK = 1024
MODULUS, HELD_OUT = 4, 2
#: Every ASCII byte that is no letter becomes a blank.
_FOLD = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))
_LETTER = re.compile(rb"[a-z]")


def folded(text: str | None) -> bytes:
    """The text in lower case, ASCII letters and other characters kept, single blanks between."""
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(_FOLD).split())


def has_letter(data: bytes) -> bool:
    return bool(_LETTER.search(data)) or any(map(str.isalpha, data.decode("utf-8", "replace")))


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Forward arcs of the suffix automaton of data; state 0 is the root."""
    arcs: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in data:
        state = len(arcs)
        arcs.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in arcs[p]:
            arcs[p][c] = state
            p = link[p]
        if p >= 0:
            q = arcs[p][c]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                copy = len(arcs)
                arcs.append(dict(arcs[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and arcs[p].get(c) == q:
                    arcs[p][c] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    return arcs


class CrossParser:
    """Dense parsing tables of all languages, one below the other."""

    def __init__(self, references: dict[str, bytes]):
        self.names = sorted(references)
        used = sorted(set(b"".join(references.values())))
        self.classes = np.full(256, len(used), np.uint8)
        self.classes[used] = np.arange(len(used), dtype=np.uint8)
        width = self.width = len(used) + 1
        tables, self.roots = [], []
        base = 0
        for name in self.names:
            arcs = suffix_automaton(references[name])
            goto = np.full((len(arcs), width), -1, np.int32)
            for state, row in enumerate(arcs):
                if row:
                    goto[state, self.classes[list(row)]] = list(row.values())
            # A missing arc starts a phrase, marked by the sign bit; at the root every byte does.
            restart = ~(np.where(goto[0] >= 0, goto[0], 0) + base)
            step = np.where(goto >= 0, goto + base, restart)
            step[0] = restart
            tables.append(step.astype(np.int32))
            self.roots.append(base)
            base += len(arcs)
        # Rows are addressed by state * width.
        self.flat = np.concatenate(tables).ravel() if tables else np.empty(0, np.int32)
        ends = self.flat < 0
        self.flat[ends] = ~self.flat[ends]
        self.flat *= width
        self.flat[ends] = ~self.flat[ends]
        self.starts = np.array(self.roots, np.int32) * width

    def phrases(self, texts: list[bytes], block: int = BLOCK) -> np.ndarray:
        """Phrases of each text (row) against each language (column)."""
        sizes = np.array([len(t) for t in texts], np.int64)
        pieces = -(-sizes // block)
        owner = np.repeat(np.arange(len(texts)), pieces)
        total = np.zeros((len(texts), len(self.names)), np.int64)
        if not len(owner) or not self.names:
            return total
        data = self.classes[np.frombuffer(b"".join(texts), np.uint8)]
        first = np.repeat(np.cumsum(sizes) - sizes, pieces) + block * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        length = np.minimum(block, np.repeat(np.cumsum(sizes), pieces) - first)
        order = np.argsort(-length, kind="stable")  # lanes end from the right
        first, length, owner = first[order], length[order], owner[order]
        for column, start in enumerate(self.starts):
            state = np.full(len(first), start, np.int32)
            count = np.zeros(len(first), np.int32)
            alive = np.searchsorted(-length, -np.arange(int(length[0])), side="left")
            for at in range(int(length[0])):
                n = alive[at]
                step = self.flat[state[:n] + data[first[:n] + at]]
                ended = step < 0
                count[:n] += ended
                state[:n] = np.where(ended, ~step, step)
            total[:, column] += np.bincount(owner, weights=count, minlength=len(texts)).astype(np.int64)
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        data = [folded(t) for t in texts]
        counts = self.phrases(data)
        names, scores = [], []
        for text, row in zip(data, counts, strict=True):
            if not len(row) or not has_letter(text):
                names.append(UNDETERMINED)
                scores.append(0.0)
                continue
            best = int(np.argmin(row))
            rest = np.delete(row, best)
            names.append(self.names[best])
            scores.append(1.0 if not len(rest) else float((rest.min() - row[best]) / max(rest.min(), 1)))
        return names, scores


@lru_cache(maxsize=1)
def _parser(references: tuple[tuple[str, bytes], ...]) -> CrossParser:
    return CrossParser(dict(references))


def reference_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS, reference_bytes: int = REFERENCE_BYTES) -> dict[str, bytes]:
    """Reference text of each language from a bounded, repeatable sample of training documents."""
    learn = docs.filter((training_bucket(doc_id, MODULUS) != HELD_OUT) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    size = F.octet_length(F.col(text).cast("string"))
    fits = size <= TEXT_BYTES
    rows = learn.select(F.col(lang).cast("string").alias("l"), fits.alias("fits"), F.when(fits, 0).otherwise(size).alias("size"), F.xxhash64(F.col(doc_id).cast("string")).alias("h"), F.when(fits, F.col(text)).otherwise(F.substring(text, 1, reference_bytes)).alias("t"))
    sample = rows.withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy("size", "h", "t"))).filter(F.col("n") <= sample_docs)
    parts: dict[str, list[bytes]] = {}
    for r in sample.select("l", "n", "fits", "t").orderBy("l", "n").collect():
        got = folded(r["t"])[:reference_bytes]
        if has_letter(got) and (r["l"] not in parts or r["fits"] and sum(map(len, parts[r["l"]])) < reference_bytes):
            parts.setdefault(r["l"], []).append(got)
    return {k: b" ".join(v) for k, v in parts.items()}


def identify_language(docs: DataFrame, references: dict[str, bytes], text: str = "text", into: str = "language") -> DataFrame:
    """docs with a struct `into` of lang and score, judged from the text alone."""
    session_ready(docs.sparkSession)
    held = tuple(sorted(references.items()))

    @F.arrow_udf("struct<lang:string,score:double>")
    def judged(column: pa.Array) -> pa.Array:
        names, scores = _parser(held).predict(column.to_pylist())
        return struct_of({"lang": (pa.string(), names), "score": (pa.float64(), scores)})

    # Marked so that a filter on the result does not make Spark judge each text twice.
    return docs.withColumn(into, judged.asNondeterministic()(F.col(text)))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    session_ready(spark)
    docs = table(spark, sf_dir, "documents")
    found = identify_language(docs.select("doc_id", "text"), reference_texts(docs))
    return found.select("doc_id", (training_bucket("doc_id", MODULUS) == HELD_OUT).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
