"""Quality by compression: a text that a dictionary of good text compresses better than a dictionary of bad text is likely good.

Two zstandard dictionaries are trained on blocks of labelled text, one per label. A text is cut into blocks of `BLOCK` bytes, so that a dictionary
counts at the end of a long text as it does at its start; every block is compressed with both, and sizes add up. Two numbers
come of it: the normalised difference (bad - good) / (bad + good), and the logarithm of the mean compressed share, which places text that compresses
itself (stutter), where either dictionary is of little use. A logistic fit turns them into a score from 0 to 1.

The sample is a stated one: `SAMPLE_DOCS` labelled documents with the lowest hash of their id; one bit of another hash deals them to the
dictionaries or to the fit, so no text is scored by a dictionary that holds it. Each dictionary learns from at most `BLOCKS` blocks (those with
the lowest hash, from anywhere in a text) and has at most `DICT_BYTES` bytes. Where there are too few blocks to train on, they are
the dictionary as they are. Scores cover all rows and whole texts.

Defined results: a null text is an empty one, which compresses to nothing more than a frame; an empty text gets the score of its two numbers like any other.
Rows are judged one by one, so repeated rows get equal scores. Labels with a null quality or id are not learned; of repeated labels the lowest counts, of
repeated documents the text with the lowest hash. If one label is missing in either half, every score is the smoothed share of label 1. An empty table gives no
rows; columns of documents of any name are kept, but one named as the result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import as_bytes, free, session_ready, struct_of, table, training_bucket

SAMPLE_DOCS = 6000
BLOCK, BLOCKS = 512, 8000
DICT_BYTES = 112 << 10
LEVEL = 3
MODULUS, HELD_OUT = 3, 1
_FRAME = 16


def blocks_of(text: bytes | None) -> list[bytes]:
    text = text or b""
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


def dictionary(blocks: list[bytes]) -> tuple[bytes, bool]:
    """The dictionary for these blocks, and whether it was trained (or is plain content)."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, blocks, level=LEVEL).as_bytes(), True
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICT_BYTES:], False


@lru_cache(maxsize=8)
def _compressor(content: bytes, trained: bool) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


def measures(text: bytes | None, dictionaries: list[tuple[bytes, bool]]) -> tuple[float, float]:
    """Normalised size difference, and log of the compressed share, for dictionaries of (bad, good) text."""
    bad, good = (sum(len(c.compress(b)) for b in blocks_of(text) or [b""]) for c in (_compressor(*d) for d in dictionaries))
    return (bad - good) / (bad + good), float(np.log((bad + good) / (2 * len(text or b"") + _FRAME)))


class Model:
    """Dictionaries and the fitted scale, or without dictionaries one score for all."""

    def __init__(self, dictionaries: list[tuple[bytes, bool]], share: float, x: np.ndarray | None = None, y: np.ndarray | None = None):
        self.dictionaries, self.share = dictionaries, share
        if dictionaries:
            self.middle, self.spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
            z, w = self._z(x), np.zeros(x.shape[1] + 1)
            for _ in range(60):  # Newton steps of the logistic fit, with a slight pull to zero
                p = 1 / (1 + np.exp(-z @ w))
                w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w)), z.T @ (p - y) + 1e-2 * w)
            self.w = w

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([(x - self.middle) / self.spread, np.ones((len(x), 1))])

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if not self.dictionaries or not texts:
            return np.full(len(texts), self.share)
        return 1 / (1 + np.exp(-self._z(np.array([measures(t, self.dictionaries) for t in texts])) @ self.w))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", sample_docs: int = SAMPLE_DOCS) -> Model:
    known = labels.filter(F.col(quality).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg((F.min(quality) > 0).cast("int").alias("__good"))
    sample = known.orderBy(F.xxhash64("__id"), "__id").limit(sample_docs)  # the size bound of the broadcast below
    texts = docs.select(F.col(doc_id).alias("__key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text")).join(F.broadcast(sample), F.col("__key") == F.col("__id"))
    one = texts.groupBy("__id", "__good").agg(F.min(F.struct(F.xxhash64("__text"), "__text")).alias("t"))
    rows = one.select("__good", (F.pmod(F.xxhash64(F.lit("half"), "__id"), F.lit(2)) == 0).alias("__fits"), F.col("t.__text").alias("__text")).checkpoint()
    counts = {(r["__good"], r["__fits"]): r["count"] for r in rows.groupBy("__good", "__fits").count().collect()}
    share = (1 + sum(v for (good, _), v in counts.items() if good)) / (2 + sum(counts.values()))
    if len(counts) < 4:
        return Model([], share)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in as_bytes(b.column(0)):
                for low in range(0, len(t), BLOCK * 4096):
                    found = blocks_of(t[low : low + BLOCK * 4096])
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["block"])

    dictionaries = []
    for good in (0, 1):
        pieces = rows.filter((F.col("__good") == good) & ~F.col("__fits")).select("__text").mapInArrow(cut, "block binary")
        dictionaries.append(dictionary([bytes(r["block"]) for r in pieces.orderBy(F.xxhash64("block"), "block").limit(BLOCKS).collect()]))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([measures(t, dictionaries) for t in as_bytes(b.column(1))], pa.list_(pa.float64()))], names=["good", "x"])

    got = sorted(rows.filter("__fits").select("__good", "__text").mapInArrow(measured, "good int, x array<double>").collect())
    return Model(dictionaries, share, np.array([r["x"] for r in got]), np.array([r["good"] for r in got]))


def score_quality(docs: DataFrame, model: Model, text: str = "text", into: str = "quality_score") -> DataFrame:
    """docs with a struct `into` of score (0 to 1) and bytes (of the text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<score:double,bytes:bigint>")
    def judged(column: pa.Array) -> pa.Array:
        texts = as_bytes(column)
        return struct_of({"score": (pa.float64(), sent.value.scores(texts).tolist()), "bytes": (pa.int64(), [len(t or b"") for t in texts])})

    return docs.withColumn(into, judged.asNondeterministic()(F.col(text).cast("string")))


def op11_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    session_ready(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = docs.filter(training_bucket("doc_id", MODULUS) != HELD_OUT)
    into = free("quality_score", docs)
    scored = score_quality(docs, fit(learned, table(spark, sf_dir, "labels")), into=into)
    score = F.col(into)["score"]
    return scored.select("doc_id", (training_bucket("doc_id", MODULUS) == HELD_OUT).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
