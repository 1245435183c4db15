"""Mixing to target weights with soft domain membership.

A softmax classifier, fitted on a bounded sample of the labelled table, gives each document posteriors over
three domains: `high` (quality 1, not toxic), `low` (quality 0, not toxic) and `toxic`. Its features are
the share of words from lists learned per domain, and marks of form (symbols, bars, exclamations,
capitals, distinct words, stutter).

Rates are fitted by distributed projected-gradient least squares: with m the document's share of all tokens and p its
posteriors, the distance of the domain totals sum(rate * m * p) from the targets is minimised over rates >= 0. The steps add up from rates of
one and their sum is projected: rate = max(0, 1 - p * sum of steps), which of all rates that meet the targets leads to those nearest to one.
The distance is measured in the inverse of the Gram matrix sum(m * p p') of the documents with a rate above zero; in the metric m the gradient
of a document is then p * direction, with one direction for all. So all that goes round are the residual and the Gram matrix, a few
numbers: each iteration is one pass over the posteriors, and a document's state is no more than the sum of steps. A step that does not
bring the totals nearer is taken again with more damping. It ends when each total is within `SETTLED` of its target, or when `TRIALS`
steps in a row do not help (targets out of reach).
The posteriors are written once and read again by each pass, without the texts.

Defined results: a null text has no tokens and weighs nothing, but has a rate; repeated rows weigh as often as
they occur; a very long text weighs by its tokens; labels with nulls are ignored, of repeated ones the worst counts; with fewer than two
domains labelled, posteriors are uniform; an empty table gives none; columns of documents of any name are kept, but one named as
the result is replaced. The sample are the `sample_docs` labelled documents with the lowest hash of their id; everything else covers
all rows. A list holds every word of the sample whose share of a domain's documents exceeds that of the others by `SURE` standard errors.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import as_bytes, session_ready, stored, struct_of, table

DOMAINS = ("high", "low", "toxic")
TARGETS = (0.92, 0.06, 0.02)
SAMPLE_DOCS = 6000
SETTLED, TRIALS = 1e-6, 12
#: Standard errors by which a listed word's share of a domain's documents exceeds its share of the others.
SURE = 4.5
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of letters and non-ASCII bytes, A-Z in lower case."""
    return (text or b"").translate(_FOLD).split()


def features(text: bytes | None, lists: list[frozenset[bytes]]) -> list[float]:
    text = text or b""
    words = words_of(text)
    n, size = max(1, len(words)), max(1, len(text))
    listed = [sum(map(words_in.__contains__, words)) for words_in in lists]
    letters = max(1, sum(map(len, words)))
    upper = letters - sum(map(len, text.translate(None, bytes(range(0x41, 0x5B))).translate(_FOLD).split()))
    return [
        *[np.sqrt(x / n) for x in listed],
        *[float(x > 0) for x in listed],
        np.sqrt(sum(map(text.count, (b"#", b"*", b"$", b"%", b"&"))) / size),
        np.sqrt(text.count(b"|") / size),
        np.sqrt(text.count(b"!") / size),
        upper / letters,
        len(set(words)) / n,
        np.sqrt(sum(map(eq, words, words[1:])) / n),
        np.log1p(len(words)),
    ]


class Softmax:
    def __init__(self, x: np.ndarray, y: np.ndarray, kinds: int, decay: float = 1e-3, steps: int = 1500):
        self.middle, self.spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        z = self._z(x)
        share = np.maximum(np.bincount(y, minlength=kinds), 1) / len(y)
        aim = np.eye(kinds)[y]
        w = np.zeros((z.shape[1], kinds))
        w[-1] = np.log(share)
        ahead, last = w, w
        rate = 2 / max(1e-9, np.linalg.norm(z, 2) ** 2 / len(z) + decay)
        for t in range(steps):  # gradient steps with momentum
            step = ahead - rate * (z.T @ (self._softmax(z @ ahead) - aim) / len(z) + decay * ahead)
            ahead = step + t / (t + 3) * (step - last)
            last = step
        self.w = last

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([(x - self.middle) / self.spread, np.ones((len(x), 1))])

    @staticmethod
    def _softmax(s: np.ndarray) -> np.ndarray:
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        return self._softmax(self._z(x) @ self.w)


class Classifier:
    """Word lists and, if at least two domains were labelled, the fitted weights."""

    def __init__(self, lists: list[frozenset[bytes]], model: Softmax | None):
        self.lists, self.model = lists, model

    def posteriors(self, texts: list[bytes | None]) -> np.ndarray:
        if self.model is None or not texts:
            return np.full((len(texts), len(DOMAINS)), 1 / len(DOMAINS))
        return self.model.posteriors(np.array([features(t, self.lists) for t in texts]))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS) -> Classifier:
    known = labels.filter("quality is not null and toxic is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").alias("t"), F.min("quality").alias("q"))
    known = known.select("__id", F.when(F.col("t") > 0, 2).when(F.col("q") > 0, 0).otherwise(1).alias("__domain"))
    sample = known.orderBy(F.xxhash64("__id"), "__id").limit(sample_docs)  # the size bound of the broadcast below
    rows = docs.select(F.col(doc_id).alias("__key"), F.col(text).cast("string").alias("__text")).join(F.broadcast(sample), F.col("__key") == F.col("__id")).select("__domain", "__text").checkpoint()
    sizes = np.zeros(len(DOMAINS), np.int64)
    for r in rows.groupBy("__domain").count().collect():
        sizes[r["__domain"]] = r["count"]
    if (sizes > 0).sum() < 2:
        return Classifier([], None)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(w, d) for d, t in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True) for w in set(words_of(t))]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.binary()), pa.array([d for _, d in found], pa.int32())], names=["word", "domain"])

    seen = rows.mapInArrow(present, "word binary, domain int").groupBy("word").agg(*[F.count_if(F.col("domain") == i).alias(f"n{i}") for i in range(len(DOMAINS))])
    lists = []
    for i in (1, 2):
        rest = sum(F.col(f"n{j}") for j in range(len(DOMAINS)) if j != i)
        others, here = max(1, int(sizes.sum() - sizes[i])), max(1, int(sizes[i]))
        pooled = (F.col(f"n{i}") + rest) / (here + others)
        # Of all words of the sample those whose share of the domain's documents is far above that elsewhere.
        error = F.sqrt(pooled * (1 - pooled) * (1 / here + 1 / others))
        best = seen.filter(F.col(f"n{i}") / here - rest / others > SURE * error)
        lists.append(frozenset(bytes(r["word"]) for r in best.select("word").collect()))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t, lists) for t in as_bytes(b.column(1))], pa.list_(pa.float64()))], names=["domain", "x"])

    got = sorted(rows.mapInArrow(measured, "domain int, x array<double>").collect())
    return Classifier(lists, Softmax(np.array([r["x"] for r in got]), np.array([r["domain"] for r in got]), len(DOMAINS)))


def with_posteriors(docs: DataFrame, classifier: Classifier, text: str = "text", into: str = "domains") -> DataFrame:
    """docs with a struct `into` of n_tokens and p (the posteriors in the order of DOMAINS)."""

    @F.arrow_udf("struct<n_tokens:bigint,p:array<double>>")
    def judged(column: pa.Array) -> pa.Array:
        texts = as_bytes(column)
        return struct_of({"n_tokens": (pa.int64(), [len((t or b"").split()) for t in texts]), "p": (pa.list_(pa.float64()), classifier.posteriors(texts).tolist())})

    return docs.withColumn(into, judged.asNondeterministic()(F.col(text)))


def rates(p: np.ndarray, steps: np.ndarray) -> np.ndarray:
    return np.maximum(0, 1 - p @ steps)


def fit_rates(weights: DataFrame, targets: tuple[float, ...] = TARGETS) -> np.ndarray:
    """The sum of steps over weights (n_tokens, p); rates() turns it into rates."""
    aim = np.array(targets, float) / sum(targets)
    k = len(aim)
    total = weights.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    best = np.zeros(k)
    if not total:
        return best

    def state(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Residual and Gram matrix of the rates after these steps: one pass."""

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = np.zeros((k + 1, k))
            for b in batches:
                if len(b):
                    p = b.column(1).flatten().to_numpy().reshape(len(b), -1)
                    rate, m = rates(p, steps), b.column(0).to_numpy() / total
                    at[0] += (rate * m) @ p
                    at[1:] += (p * (m * (rate > 0))[:, None]).T @ p
            yield pa.RecordBatch.from_arrays([pa.array(range(at.size), pa.int32()), pa.array(at.ravel())], names=["k", "v"])

        got = weights.mapInArrow(sums, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        at = np.array([r["v"] for r in sorted(got)]).reshape(k + 1, k)
        return at[0] - aim, at[1:]

    residual, gram = state(best)
    damping, failed = 1e-3, 0
    while np.abs(residual).max() >= SETTLED and failed < TRIALS:
        step = np.linalg.solve(gram + (damping * np.trace(gram) + 1e-15) * np.eye(k), residual)
        there, gram_there = state(best + step)
        if np.linalg.norm(there) < np.linalg.norm(residual):
            best, residual, gram, failed, damping = best + step, there, gram_there, 0, damping / 8
        else:
            failed, damping = failed + 1, damping * 4
    return best


def mix(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", targets: tuple[float, ...] = TARGETS, into: str = "mix", keep_text: bool = True) -> DataFrame:
    """docs with a struct `into` of n_tokens, p and rate; without the text, if it is not kept."""
    session_ready(docs.sparkSession)
    judged = with_posteriors(docs.drop(into), fit(docs, labels, doc_id, text), text, into)
    judged = stored(judged if keep_text else judged.drop(text))
    steps = fit_rates(judged.select(f"{into}.n_tokens", f"{into}.p"), targets)

    @F.arrow_udf("double")
    def rate(p: pa.Array) -> pa.Array:
        return pa.array(rates(p.flatten().to_numpy().reshape(len(p), -1), steps))

    return judged.withColumn(into, F.struct(F.col(into)["n_tokens"].alias("n_tokens"), F.col(into)["p"].alias("p"), rate(F.col(into)["p"]).alias("rate")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = mix(docs, table(spark, sf_dir, "labels"), keep_text=False)
    return found.select("doc_id", F.col("mix.n_tokens").alias("n_tokens"), *[F.col("mix.p")[i].alias(f"p_{k}") for i, k in enumerate(DOMAINS)], F.col("mix.rate").alias("rate"))
