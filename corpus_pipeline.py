"""Corpus pipeline: five stages over documents, each fed what the one before kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. Every stage keeps extra columns, whatever their names, and gives no rows for an empty table.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from branchlight.llm import decontaminate, langid, mixing, secrets, simhash
from branchlight.llm._shared import free, session_ready, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the learned languages, with lang as predicted; the rest go.

    Null texts, texts without a letter, and all texts where no language can be learned (no row with a lang) go. A null doc_id is a training
    document; a very long text is judged whole; ties go to the language that sorts first; repeated rows are judged alike.
    """
    session_ready(spark)
    name = free("language", docs)
    found = langid.identify_language(docs, langid.reference_texts(docs), into=name)
    return found.withColumn("lang", F.col(name)["lang"]).filter(F.col("lang") != langid.UNDETERMINED).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id. Near copies are texts whose fingerprints differ in at most three
    bits, and those whose five-word shingles have a similarity of 0.8 or more.

    All texts without a word, nulls included, are one group. Of rows that share that smallest id and a fingerprint one stays, of rows
    that share the id alone (near copies under one id) one of each fingerprint. A group in which every id is null keeps one row of each fingerprint.
    """
    session_ready(spark)
    name = free("near", docs)
    found = simhash.near_duplicates(docs, into=name, similar=True)
    # Rows that repeat a document meet under one id and component, never a whole group of copies.
    key = free("component", docs)
    first = found.filter(F.col("doc_id").eqNullSafe(F.col(name)["component"])).withColumn(key, F.concat_ws(":", F.col(name)["fingerprint"], F.col("doc_id").cast("string")))
    return first.dropDuplicates([key]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage. A null or empty text has none and stays; so does everything where the benchmark is
    empty; a very long text is searched whole; repeated rows stay or go together."""
    name = free("leak", docs)
    found = decontaminate.find_contamination(spark, docs, table(spark, sf_dir, "benchmark"), into=name)
    return found.filter(F.size(F.col(name)["starts"]) == 0).select(*docs.columns)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in them replaced by [REDACTED]; n_chars follows the text.

    A null text stays null with null n_chars; a null doc_id and repeated rows are redacted like any other; overlapping or touching
    secrets become one mark; a very long text is scanned whole.
    """
    session_ready(spark)
    hashed, key, same, spans = (free(n, docs) for n in ("hash", "id", "same", "spans"))
    found = secrets.find_secrets(docs, [F.col("doc_id").alias(key), F.xxhash64("text").alias(same)])
    found = found.filter(F.size("parts") > 0).dropDuplicates([key, same]).withColumnRenamed("parts", spans)
    joined = docs.withColumn(hashed, F.xxhash64("text")).join(found, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(hashed) == F.col(same)), "left")
    clean = F.when(F.col(spans).isNotNull(), secrets.redact(F.col("text"), F.col(spans))).otherwise(F.col("text"))
    return joined.withColumn("text", clean).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the rate that brings the domains to their target weights, and the number of times to
    take each: the rate, rounded up with the probability of its fraction by a hash of the id. Documents to be taken no time go.

    A null text weighs nothing but has a rate; rows with one id, null ids among them, share the draw; without labels of two domains all
    posteriors are equal. Columns of documents named as one of the results (n_tokens, p_high, p_low, p_toxic, rate, n_copies) give way to it.
    """
    session_ready(spark)
    name = free("mix", docs)
    found = mixing.mix(docs, table(spark, sf_dir, "labels"), into=name)
    rate = F.col(name)["rate"]
    draw = F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    copies = (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long")
    made = {"n_tokens": F.col(name)["n_tokens"], **{f"p_{k}": F.col(name)["p"][i] for i, k in enumerate(mixing.DOMAINS)}, "rate": rate, "n_copies": copies}
    kept = [c for c in docs.columns if c.lower() not in made]
    return found.select(*kept, *[c.alias(n) for n, c in made.items()]).filter("n_copies > 0")


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_redaction),
    ("mixing sources to target weights", source_mixing),
]

#: SQL expresses neither the cross-parsing, the fingerprints nor the fit.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet and read again for the next."""
    session_ready(spark)
    base = spark.sparkContext.getCheckpointDir()
    run_id = uuid4()
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{base}/pipeline-{run_id}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
