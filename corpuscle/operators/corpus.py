"""The corpus: load, deduplicate, identify, describe."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import text as X
from corpuscle.session import ship, written


#: Hashes of repeated texts are broadcast up to so many; beyond, rows are joined with them by shuffle.
BROADCAST_ROWS = 500_000


def dedup_first(docs: DataFrame, text: str = "text", key: str = "doc_id", deal: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row per distinct non-null text: the one with the smallest key (null keys come last).

    Hashes and keys alone are grouped, in part before each shuffle; of these, only texts that repeat are written, and
    whole rows are neither sorted nor, where few texts repeat, shuffled. Of rows equal in text and key any one is taken.
    ``docs`` is read twice. ``deal`` (``readers.spread``) lays rows out anew before they are kept.
    """
    live, h = docs.where(F.col(text).isNotNull()), F.sha2(text, 256)
    by_key = live.select(h.alias("__h"), F.col(key).alias("__k")).groupBy("__h", "__k").agg(F.count(F.lit(1)).alias("__n"))
    groups = by_key.groupBy("__h").agg(F.min("__k").alias("__first"), F.sum("__n").alias("__n"), F.max("__n").alias("__same"))
    repeated = written(groups.where("__n > 1"), "repeated")
    few = F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated
    rows = (live if deal is None else deal(live)).withColumn("__h", h).join(few, "__h", "left")
    kept = rows.where(F.col("__n").isNull() | F.col(key).eqNullSafe(F.col("__first")))
    if repeated.where("__same > 1").isEmpty():
        return kept.select(*docs.columns)
    alone = F.coalesce(F.col("__same"), F.lit(1)) == 1
    return kept.where(alone).unionByName(kept.where(~alone).dropDuplicates(["__h"])).select(*docs.columns)


def with_doc_idx(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``doc_idx`` from 0 in order of the key; null keys come first, rows of one key in any order.

    Rows are range-sorted and numbered by partition (no single task). Partition and number are written beside them,
    so that sizes and rows cannot come from two sorts that parted the rows differently.
    """
    ordered = written(docs.orderBy(key).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()), "ordered")
    sizes = ordered.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"), F.min("__i").alias("__first"))
    starts = sizes.withColumn("__start", F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).drop("__n")  # a row per partition
    return ordered.join(F.broadcast(starts), "__p").withColumn("doc_idx", F.col("__start") + F.col("__i") - F.col("__first")).drop("__p", "__i", "__start", "__first")


def fingerprint(docs: DataFrame, text: str = "text", key: str = "doc_id") -> str:
    """The first 16 hex digits of the SHA-1 over all texts in order of the key.

    SHA-1 is sequential: texts are dealt to ranges of the key side by side, then stream through one task in that order,
    a batch at a time; the driver sees the digest only. For cache keys of large corpora use ``content_key``.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha1()
        for batch in batches:
            for t in batch.column(0):
                sha.update(t.as_buffer() or b"")
        yield pa.RecordBatch.from_arrays([pa.array([sha.hexdigest()[:16]])], names=["digest"])

    ship(docs.sparkSession)
    bound = F.encode(F.col(text), "UTF-8").alias("t")
    ordered = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), bound).orderBy("k").select("t")
    return ordered.coalesce(1).mapInArrow(digest, "digest string").first()[0]


def content_key(docs: DataFrame, text: str = "text", key: str = "doc_id", **params) -> str:
    """A cache key of ids, lengths, texts and parameters that is computed in parallel, in any order of rows."""
    h = F.xxhash64(key, F.length(text), text)
    n, xor, total = docs.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first()
    return hashlib.sha1(repr((n, xor, total, sorted(params.items()))).encode()).hexdigest()[:16]


def table_key(rows: DataFrame) -> str:
    """A key of a table's rows, in any order, computed in parallel."""
    h = F.xxhash64(*rows.columns)
    return repr(tuple(rows.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first()))


def status(docs: DataFrame, device: str = "cpu", methods: int = 3) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("corpus_size")).select(F.lit("ok").alias("status"), "corpus_size", F.lit(device).alias("device"), F.lit(methods).alias("n_methods"))


def token_reduction(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """How many of a text's words are left as tokens, and the share that is not, in percent."""
    words, kept = X.word_count(F.col(text)).cast("long"), F.size(X.tokens(F.col(text))).cast("long")
    counted = docs.select(key, words.alias("raw_words"), kept.alias("n_tokens"))
    return counted.withColumn("reduction_pct", F.round(100 * (1 - F.try_divide(F.col("n_tokens"), F.col("raw_words"))), 4))
