"""Retrieval: benchmark items ask the documents; embeddings ask each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as R
from .registry import query
from .relations import r6, table

_TERMS = r"list_filter(string_split_regex(lower({x}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda t: t <> '')"
_BM25 = f"""w AS (SELECT item_id AS query_id, unnest(list_distinct({_TERMS.format(x='text')})) AS term FROM benchmark),
d AS (SELECT doc_id, {_TERMS.format(x='text')} AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM w) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 0.9 * (1 - 0.4 + 0.4 * dl / avgdl))), 6) AS score FROM tf JOIN df USING (term) JOIN w USING (term), s GROUP BY ALL),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= 10)"""


def _lexical(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.bm25(asked, table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("bm25_top_k", f"WITH {_BM25} SELECT query_id, CAST(rank AS INT) AS rank, doc_id, score FROM lex")
def bm25_top_k(spark, sf_dir):
    return _lexical(spark, sf_dir).select("query_id", "rank", "doc_id", "score")


_DENSE = """q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
sc AS (SELECT query_id, vec_id AS doc_id, round(list_dot_product(q::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM embeddings, q),
den AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= 10)"""


def _vectors(spark, sf_dir):
    docs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return R.dense(docs.filter("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"), docs)


@query("dense_top_k", f"WITH {_DENSE} SELECT query_id, CAST(rank AS INT) AS rank, doc_id, score FROM den")
def dense_top_k(spark, sf_dir):
    """Every fiftieth vector asks all vectors."""
    return _vectors(spark, sf_dir).select("query_id", "rank", "doc_id", "score")


@query(
    "hybrid_top_k",
    f"""WITH {_BM25.replace('QUALIFY rank <= 10', '')}, q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings JOIN benchmark ON item_id = vec_id), v AS (SELECT vec_id AS doc_id, embedding FROM embeddings JOIN documents ON doc_id = vec_id),
den AS (SELECT query_id, doc_id, round(list_dot_product(q::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM v, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM den),
l AS (SELECT lex.query_id, lex.doc_id, lex.score FROM lex JOIN q USING (query_id)), la AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, max(score) OVER (PARTITION BY query_id) AS best FROM l),
c AS (SELECT query_id, doc_id FROM la WHERE rank <= 50 UNION SELECT query_id, doc_id FROM r WHERE rank <= 50),
f AS (SELECT c.query_id, c.doc_id, round((4.0 * coalesce(la.score / (SELECT max(score) FROM la x WHERE x.query_id = c.query_id), 0) + coalesce(r.score / m.best, 0)) / 5, 5) AS score FROM c LEFT JOIN r ON r.query_id = c.query_id AND r.doc_id = c.doc_id JOIN (SELECT query_id, max(score) AS best FROM r GROUP BY 1) m ON m.query_id = c.query_id LEFT JOIN la ON la.query_id = c.query_id AND la.doc_id = c.doc_id)
SELECT query_id, doc_id, score FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10""",
)
def hybrid_top_k(spark, sf_dir):
    """Lexical and dense scores fused four to one (an extension; the weights come without a formula), of the fifty best documents on either side. All
    items ask; the vector with a document's number stands for its encoding, that with an item's number for the item's."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text").join(vectors, F.col("query_id") == F.col("vec_id")).drop("vec_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    every = R.hybrid(asked, docs.join(vectors, F.col("doc_id") == F.col("vec_id"), "left").drop("vec_id"), depth=50, digits=5)
    return every.select("query_id", "doc_id", "score")


@query("fetch_documents", f"WITH {_BM25} SELECT query_id, string_agg(lex.doc_id || ':' || length(documents.text), ',' ORDER BY rank) AS results FROM lex JOIN documents USING (doc_id) GROUP BY query_id")
def fetch_documents(spark, sf_dir):
    """Documents of each result list, in rank order, nested."""
    texts = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
    got = _lexical(spark, sf_dir).join(texts, "doc_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "n"))).alias("r"))
    return got.select("query_id", F.array_join(F.transform("r", lambda x: F.concat_ws(":", x["doc_id"].cast("string"), x["n"].cast("string"))), ",").alias("results"))


@query("pooling", "WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL) SELECT label, round(max(x) / sqrt(sum(x * x)), 5) AS top, round(sum(x) / sqrt(sum(x * x)), 4) + 0.0 AS total FROM m GROUP BY label")
def pooling(spark, sf_dir):
    """Unit vector of the mean of each label's vectors."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    v = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select("label", R.unit(F.col("v.x")).alias("v"))
    return v.select("label", F.round(F.array_max("v"), 5).alias("top"), (F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4) + F.lit(0.0)).alias("total"))
