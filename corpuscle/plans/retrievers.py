"""Retrieval methods behind one protocol: fitted to a corpus once, they answer queries with ranked documents."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.operators import dense, embed, lexical


class Retriever(Protocol):
    """A method of search. ``key`` names it among the results."""

    key: str

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """``(query_id, doc_id, score, rank)`` of ``(query_id, query)`` rows, k documents a query."""
        ...


@dataclass
class Lexical:
    """TF-IDF over a fitted index."""

    index: lexical.LexicalIndex
    key: str = "tfidf"

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return lexical.search(self.index, queries, k)


@dataclass
class WordVectors:
    """Means of word vectors: ``words`` (word, vector) of ``width`` numbers, ``docs`` (doc_id, vector).

    Queries are cut into words as those of ``index`` are, if there is one.
    """

    words: DataFrame
    docs: DataFrame
    width: int
    index: lexical.LexicalIndex | None = None
    key: str = "word2vec"

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        texts = queries.select(F.col("query_id").alias("doc_id"), F.col("query").alias("text"))
        tokens = lexical.tokens_long(texts) if self.index is None else self.index.tokens(texts, "text", "doc_id", grams=False)
        means = dense.mean_vectors(tokens, self.words, texts, self.width)
        return dense.cosine_topk(self.docs, means.withColumnRenamed("doc_id", "query_id"), k)


@dataclass
class Encoded:
    """A sentence encoder; ``docs`` (doc_id, vector) holds its vectors of the corpus."""

    encoder: embed.Encoder
    docs: DataFrame
    key: str = "bert"

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        asked = embed.encode(queries, self.encoder, "query").select("query_id", "vector")
        return dense.cosine_topk(self.docs, asked, k)
