"""Ranking of documents for batches of queries `(query_id, query)`: lnc.ltc cosine and Okapi BM25, and the top of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mimansa.functions import text as tx
from mimansa.operators import blocks
from mimansa.operators.index import Index
from mimansa.plans.support import small


def log_tf(tf: Column) -> Column:
    return F.when(tf > 0, 1.0 + F.log10(tf)).otherwise(0.0)


def query_terms(queries: DataFrame, stopwords: list[str] | None = None) -> DataFrame:
    """query_id, term, qtf of a (small, given) batch of queries; ones with a `tokens` column are taken as analysed."""
    words = F.col("tokens") if "tokens" in queries.columns else tx.tokenize("query", stopwords)
    return queries.select("query_id", F.explode(words).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def doc_norms(index: Index) -> DataFrame:
    return index.rows.where(F.size("terms") > 0).select("doc_id", "norm")


def query_weights(index: Index, queries: DataFrame) -> DataFrame:
    """query_id, term, weight: log tf times idf, normalised. Unknown terms and terms of every document weigh nothing.

    Documents are counted for the terms of the batch only.
    """
    asked = small(query_terms(queries))
    known = asked.join(index.posts.join(small(asked.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df")), "term")
    raw = known.withColumn("raw", log_tf(F.col("qtf")) * F.log10(F.lit(float(index.n_docs)) / F.col("df")))
    norm = F.sqrt(F.sum(F.pow("raw", F.lit(2))).over(Window.partitionBy("query_id")))
    return raw.withColumn("norm", norm).select("query_id", "term", "raw", F.when(F.col("norm") > 0, F.col("raw") / F.col("norm")).otherwise(0.0).alias("weight"))


def contributions(index: Index, queries: DataFrame) -> DataFrame:
    """query_id, doc_id, term, tf, query_weight, doc_weight, product: a cosine taken apart, term by term.

    A document brings its norm with it, so only the terms of the batch are joined and nothing else is shuffled.
    """
    hits = index.posts.join(small(query_weights(index, queries).where(F.col("weight") > 0)), "term")
    weight = log_tf(F.col("tf")) / F.col("norm")
    return hits.select("query_id", "doc_id", "term", "tf", F.col("weight").alias("query_weight"), weight.alias("doc_weight"), (F.col("weight") * weight).alias("product"))


def cosine_scores(index: Index, queries: DataFrame, zeros: bool = False) -> DataFrame:
    """query_id, doc_id, score: positive ones, or one for every document and query of a stated batch."""
    scored = contributions(index, queries).groupBy("query_id", "doc_id").agg(F.sum("product").alias("score"))
    if not zeros:
        return scored.where(F.col("score") > 0)
    every = index.rows.select("doc_id").join(small(queries.select("query_id"), 10_000))
    return every.join(scored, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def top_k(scored: DataFrame, k: int, by: str = "query_id", score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The k best of each query by score, ties by id; `rank` counts from 1. k = 0 gives nothing, k < 0 is an error."""
    if isinstance(k, bool) or not isinstance(k, int):
        raise TypeError(f"k must be an int, not {type(k).__name__}")
    if k < 0:
        raise ValueError("k must not be negative")
    order = Window.partitionBy(by).orderBy(F.desc(score), F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25_idf(index: Index, epsilon: float = 0.25) -> DataFrame:
    """term, idf. A negative idf becomes epsilon times the mean over the whole vocabulary, which may be negative too."""
    raw = index.terms.select("term", (F.log(F.lit(float(index.n_docs)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    floor = F.lit(epsilon * (raw.agg(F.avg("raw")).first()[0] or 0.0))  # one figure of the collection
    return raw.select("term", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf"))


def bm25_contributions(index: Index, queries: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """query_id, doc_id, term, qtf, tf, length, idf, product: a BM25 score taken apart, term by term.

    A collection without any token is an error, an empty one gives no rows.
    """
    if index.n_docs and not index.avg_length:
        raise ValueError("no document has a token")
    idf = bm25_idf(index, epsilon).join(small(query_terms(queries)), "term")
    hits = index.posts.join(small(idf), "term")
    share = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(index.avg_length or 1.0)))
    return hits.select("query_id", "doc_id", "term", "qtf", "tf", "length", "idf", (F.col("qtf") * F.col("idf") * share).alias("product"))


def cosine_best(index: Index, queries: DataFrame, k: int, digits: int | None = None, mix: tuple | None = None, rows: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, score, found: what `top_k` needs of the cosines, or of a `mix` of them (see `blocks.best`).

    The same scores as `cosine_scores`, of all documents or of those of `rows`, but no row for each pair.
    """
    value = F.transform("terms", lambda t: log_tf(t["tf"]) / F.col("norm"))
    asked = query_weights(index, queries).where(F.col("weight") > 0).select("query_id", "term", "weight", F.lit(1.0).alias("norm"))
    return blocks.best(blocks.table_of(rows or index.rows, value, [*(mix[1] if mix else []), *([mix[2]] if mix and mix[2] else [])]), asked, k, digits, mix)


def bm25_best(index: Index, queries: DataFrame, k: int, digits: int | None = None, rows: DataFrame | None = None, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """query_id, doc_id, score, found: what `top_k` needs of `bm25_scores`, without a row for each pair."""
    if index.n_docs and not index.avg_length:
        raise ValueError("no document has a token")
    value = F.transform("terms", lambda t: t["tf"] * (k1 + 1) / (t["tf"] + k1 * (1 - b + b * F.col("length") / F.lit(index.avg_length or 1.0))))
    asked = bm25_idf(index, epsilon).join(small(query_terms(queries)), "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"), F.lit(1.0).alias("norm"))
    return blocks.best(blocks.table_of(rows or index.rows, value, []), asked, k, digits)


def bm25_scores(index: Index, queries: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """query_id, doc_id, score of documents with a query term; negative and zero scores stay, repeated terms count again."""
    return bm25_contributions(index, queries, k1, b, epsilon).groupBy("query_id", "doc_id").agg(F.sum("product").alias("score"))
