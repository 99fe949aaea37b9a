"""Where results go: JSON, the console, Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import text as X

METHOD_ORDER = ("tfidf", "word2vec", "bert")


def response_json(hits: DataFrame, methods: DataFrame) -> DataFrame:
    """``(query_id, response)``: each query's hits by method as one JSON text. A query's hits number k per method."""
    entry = F.struct("rank", "score", "doc_id", "url", "snippet", F.col("text").alias("abstract"))
    by_method = hits.groupBy("query_id", "method").agg(F.array_sort(F.collect_list(entry)).alias("results"))
    labelled = by_method.join(F.broadcast(methods), by_method.method == methods.key, "left")
    entry = F.struct(
        F.coalesce("method_order", F.lit(99)).alias("method_order"), F.col("method").alias("key"), F.coalesce("label", "method").alias("label"), "description", "results"
    )
    return labelled.groupBy("query_id").agg(
        F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(entry)), lambda m: m.dropFields("method_order")).alias("methods"))).alias("response")
    )


def hit_json(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "method", "rank", F.to_json(F.struct("rank", "score", "doc_id", "url", "snippet")).alias("hit"))


def report(hits: DataFrame, title: str) -> str:
    """The console's ranked text of one query and method (k rows at most)."""
    rows = hits.select("rank", X.score_text(F.col("score")).alias("score"), "doc_id", "url", X.snippet_cli(F.col("text")).alias("snippet")).orderBy("rank").collect()
    if not rows:
        return f"== {title} ==\nNo results."
    return "\n".join([f"== {title} ==", *(f"{r['rank']}. [{r['score']}] {r['doc_id']} {r['url']}\n   {r['snippet']}" for r in rows)])
