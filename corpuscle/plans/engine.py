"""The search engine: an index built once, kept as Parquet by fingerprint, and searched by all methods."""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.operators import corpus as C
from corpuscle.operators import dense, embed, lexical
from corpuscle.operators import rank as R

from . import retrievers, validate

log = logging.getLogger(__name__)


@dataclass
class Options:
    """How texts are cut into terms, for all arms, the corpus and queries alike, and how vectors are learned.

    ``tag``, used with ``lemmatise``, and ``tokenise`` are told apart by ``repr``, or by name if they are functions: give
    a function another name when it changes.
    """

    sublinear: bool = True
    ngram_range: tuple[int, int] = (1, 1)
    max_features: int | None = None
    lemmatise: bool = False
    tag: lexical.SequenceTagger | None = None
    stop_words: list[str] | None = None
    tokenise: lexical.Tokeniser | None = None
    vector_size: int = 100
    window: int = 5
    min_count: int = 2
    epochs: int = 5
    seed: int = 42


def _named(value) -> object:
    """What tells options apart, the same in every process."""
    return f"{value.__module__}.{value.__qualname__}" if hasattr(value, "__qualname__") else value


class SearchEngine:
    """Builds the arms over ``(doc_id, text)`` rows and searches them.

    Tables are written under ``<cache>/<key>``; the key covers ids, lengths, texts, options, the encoder and given word
    vectors. A table whose writing did not end is built anew; errors of reading are raised. Without an encoder there
    is no third arm. ``more``: further retrievers, asked beside the engine's own.
    """

    def __init__(
        self,
        docs: DataFrame,
        cache: str,
        options: Options | None = None,
        encoder: embed.Encoder | None = None,
        word_vectors: DataFrame | None = None,
        more: list[retrievers.Retriever] | None = None,
        device: str | None = None,
    ):
        self.spark: SparkSession = docs.sparkSession
        self.options, self.encoder = options or Options(), encoder
        clean = C.dedup_first(docs.select("doc_id", "text"))
        self.device = embed.device() if device is None else device
        given = None if word_vectors is None else C.table_key(word_vectors.select("word", "vector"))
        self.key = C.content_key(clean, **{k: _named(v) for k, v in vars(self.options).items()}, encoder=embed.encoder_key(encoder), words=given)
        self.root = f"{cache.rstrip('/')}/{self.key}"
        self.corpus = self._kept("corpus", lambda: clean)
        self.n_docs = self.corpus.count()
        o = self.options
        how = (o.sublinear, o.ngram_range, o.max_features, o.lemmatise)
        fitted: list[lexical.LexicalIndex] = []

        def fit() -> lexical.LexicalIndex:  # not on a full cache: it reads all texts
            if not fitted:
                fitted.append(lexical.fit(self.corpus, *how, self.n_docs, o.stop_words, o.tokenise, tag=o.tag))
            return fitted[0]

        weights = self._kept("weights", lambda: fit().weights, "term")
        norms = self._kept("norms", lambda: weights.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")))
        known = self._kept("vocabulary", lambda: fit().vocabulary) if o.lemmatise else None
        terms = self._kept("terms", lambda: fit().terms)
        self.index = lexical.LexicalIndex(self.corpus, terms, weights, norms, *how[:2], o.lemmatise, known, None, o.stop_words, o.tokenise, o.tag)
        for own in fitted:
            own.drop()
        tokens = self.index.tokens(self.corpus, "text", "doc_id", grams=False)

        def trained() -> DataFrame:
            return embed.word_vectors(embed.train_word2vec(tokens, o.vector_size, o.window, o.min_count, o.epochs, seed=o.seed))

        self.word_vectors = self._kept("word_vectors", lambda: word_vectors if word_vectors is not None else trained())
        self.width = self.word_vectors.select(F.max(F.size("vector"))).first()[0] or o.vector_size
        self.doc_vectors = self._kept("doc_vectors", lambda: dense.mean_vectors(tokens, self.word_vectors, self.corpus, self.width))
        self.encoded = self._kept("encoded", lambda: embed.encode(self.corpus, encoder).select("doc_id", "vector")) if encoder else None
        self.retrievers = [retrievers.Lexical(self.index), retrievers.WordVectors(self.word_vectors, self.doc_vectors, self.width, self.index)]
        self.retrievers += [retrievers.Encoded(encoder, self.encoded)] if encoder else []
        self.retrievers += more or []

    @property
    def methods(self) -> list[str]:
        return [r.key for r in self.retrievers]

    def _kept(self, name: str, build, by: str | None = None) -> DataFrame:
        path = f"{self.root}/{name}.parquet"
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done):
            return self.spark.read.parquet(path)
        log.info("building %s", path)
        made = build()
        if by:
            made = made.repartitionByRange(by).sortWithinPartitions(by)  # row groups can be skipped by term
        made.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def search_batch(self, queries: DataFrame, k: int = validate.DEFAULT_K) -> DataFrame:
        """Hits of all methods for ``(query_id, query)`` rows."""
        return R.hits(R.side_by_side(**{r.key: r.search(queries, k) for r in self.retrievers}), self.corpus)

    def search(self, query: str, k: int = validate.DEFAULT_K) -> dict:
        """One query's response: took_ms and each method's hits in rank order, an empty list where it has none."""
        began, query = time.perf_counter(), validate.check(query, k)
        rows = self.search_batch(self.spark.createDataFrame([(0, query)], "query_id long, query string"), k).orderBy("method_order", "rank").collect()
        out = []
        told = {key: (label, description) for _, key, label, description in R.METHODS}
        for key in self.methods:
            label, description = told.get(key, (key, ""))
            own = [{"rank": r["rank"], "score": r["score"], "doc_id": r["doc_id"], "url": r["url"], "snippet": r["snippet"], "abstract": r["text"]} for r in rows if r["method"] == key]
            out.append({"key": key, "label": label, "description": description, "results": own})
        return {"query": query, "took_ms": round((time.perf_counter() - began) * 1000, 1), "methods": out}

    def status(self) -> DataFrame:
        return C.status(self.corpus, self.device, len(self.retrievers))


def repl(engine: SearchEngine, read=input, write=print, k: int = 3) -> None:
    """The console loop: blank asks again, ``exit`` or the end of input stops."""
    while True:
        try:
            query = read("query> ").strip()
        except (EOFError, KeyboardInterrupt):
            return
        if query.lower() == "exit":
            return
        if not query:
            continue
        for m in engine.search(query, k)["methods"]:
            write(f"== {m['label']} ==")
            for h in m["results"]:
                write(f"{h['rank']}. [{h['score']:.4f}] {h['doc_id']} {h['url']}")
