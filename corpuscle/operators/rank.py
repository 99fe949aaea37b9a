"""Ranked hits: attributes, overlap of methods, side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import text as X

METHODS = [
    (0, "tfidf", "TF-IDF", "Weighted words that query and document share."),
    (1, "word2vec", "Word2Vec", "Mean of the words' vectors, trained on the corpus."),
    (2, "bert", "Sentence encoder", "Contextual embeddings of whole texts."),
]


def methods(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(METHODS, "method_order int, key string, label string, description string")


def hits(ranked: DataFrame, corpus: DataFrame) -> DataFrame:
    """Top-k rows with url, snippet and text. Attributes are joined after the limit, so few texts move.

    The ranked side is broadcast only where the plan's own statistics allow it.
    """
    return ranked.join(corpus.select("doc_id", "text"), "doc_id").withColumns(
        {"url": X.result_url(F.col("doc_id")), "snippet": X.snippet(F.col("text")), "is_cut": X.is_cut(F.col("text"), X.snippet(F.col("text")))}
    )


def side_by_side(**arms: DataFrame) -> DataFrame:
    """All arms' rows ``(query_id, doc_id, score, rank)`` with method and method_order, in the order given."""
    out = None
    for i, (name, rows) in enumerate(arms.items()):
        part = rows.select("query_id", "doc_id", "score", F.col("rank").cast("int").alias("rank"), F.lit(name).alias("method"), F.lit(i).alias("method_order"))
        out = part if out is None else out.unionByName(part)
    return out


def overlap(results: DataFrame) -> DataFrame:
    """``(query_id, doc_id, methods, n_methods)``: which methods found a document."""
    found = results.groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_set("method")).alias("methods"))
    return found.withColumn("n_methods", F.size("methods"))


def also_in(results: DataFrame) -> DataFrame:
    """Each result with the other methods that found it, comma-joined."""
    return results.join(overlap(results), ["query_id", "doc_id"]).withColumn("also_in", F.array_join(F.array_except("methods", F.array("method")), ",")).drop("methods", "n_methods")


def overlap_count(results: DataFrame) -> DataFrame:
    """How many documents of each query more than one method found."""
    return overlap(results).groupBy("query_id").agg(F.count_if(F.col("n_methods") > 1).alias("n_shared"))
