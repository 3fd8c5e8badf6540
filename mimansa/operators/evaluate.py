"""Retrieval quality: precision, recall, macro averages, method comparison, ablations, confusion counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KS = (5, 10)


def first_mentions(ranked: DataFrame, by: list[str]) -> DataFrame:
    """A ranked list without repeated documents, numbered anew."""
    once = ranked.groupBy(*by, "doc_id").agg(F.min("rank").alias("rank"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("rank", "doc_id")))


def ranked_metrics(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = KS, by: tuple[str, ...] = ()) -> DataFrame:
    """Per query (and each of `by`, such as a method): p_at_k, recall_at_k, top1, set_precision, set_recall, counts.

    The denominator of P@k is always k. Recall is null without relevant documents; queries that returned nothing are in
    the result, with precision 0, for every value of `by` that occurs.
    """
    keys = [*by, "query_id"]
    truth = relevant.select("query_id", "doc_id").distinct()
    counts = truth.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    hits = first_mentions(ranked, keys).join(truth.withColumn("_rel", F.lit(True)), ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("_rel", F.lit(False)))
    sums = {f"_p{k}": F.count_if(F.col("rel") & (F.col("rank") <= k)) for k in ks} | {"_top": F.count_if(F.col("rel") & (F.col("rank") == 1)), "_rel": F.count_if("rel"), "n_returned": F.count("*")}
    per = hits.groupBy(*keys).agg(*[v.alias(k) for k, v in sums.items()])
    every = counts.join(F.broadcast(ranked.select(*by).distinct())) if by else counts
    rows = every.join(per, keys, "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    out = [*keys]
    for k in ks:
        out += [(z(f"_p{k}") / k).alias(f"p_at_{k}"), (z(f"_p{k}") / F.nullif("n_relevant", F.lit(0))).alias(f"recall_at_{k}")]
    precision = F.when(z("n_returned") > 0, z("_rel") / z("n_returned")).otherwise(0.0)
    return rows.select(*out, z("_top").alias("top1"), precision.alias("set_precision"), (z("_rel") / F.nullif("n_relevant", F.lit(0))).alias("set_recall"), z("n_returned").cast("bigint").alias("n_returned"), "n_relevant")


def macro(per_query: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Unweighted means over queries; undefined values do not count."""
    numbers = [c for c, t in per_query.dtypes if t == "double" and c not in by]
    return per_query.groupBy(*by).agg(*[F.avg(c).alias(c) for c in numbers], F.count("*").alias("n_queries"))


def compare_methods(results: dict[str, DataFrame], relevant: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Macro metrics of each method's ranked lists."""
    every = reduce(DataFrame.unionByName, [r.select("query_id", "doc_id", "rank").withColumn("method", F.lit(m)) for m, r in results.items()])
    return macro(ranked_metrics(every, relevant, ks, ("method",)), ("method",))


def ablation(scored: dict[str, DataFrame], relevant: DataFrame, full: str = "full", k: int = 5) -> DataFrame:
    """method, p_at_k, delta against the full system; delta is what leaving a part out costs."""
    means = compare_methods(scored, relevant, (k,)).select("method", f"p_at_{k}")
    base = means.where(F.col("method") == full).select(F.col(f"p_at_{k}").alias("_full"))
    return means.join(F.broadcast(base)).select("method", f"p_at_{k}", (F.col("_full") - F.col(f"p_at_{k}")).alias("delta"))


def confusion(judged: DataFrame, positive: str, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """tp, fp, fn, tn, precision and recall of one class; blank gold labels do not count, undefined ratios are null."""
    rows = judged.where(F.trim(F.coalesce(F.col(gold), F.lit(""))) != "")
    g, p = F.upper(F.trim(gold)) == positive, F.coalesce(F.upper(F.trim(predicted)) == positive, F.lit(False))
    sums = rows.agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))
    ratio = lambda a, b: (F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0)))
    return sums.select("*", ratio("tp", "fp").alias("precision"), ratio("tp", "fn").alias("recall"))


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n_rows of every table."""
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("name"), "n_rows") for n, t in tables.items()])
