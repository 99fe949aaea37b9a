"""The training-data pipeline: each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.

Stages are written as Parquet and read again, so each starts from a table and a lost executor costs work of one
stage only. All but the last return the columns of documents; the last adds shard and slot.

In every stage: an empty table stays empty; texts count whole, however long; columns beside those of documents are
left out, whatever their names; null ids and other nulls are values like any others, unless a stage says more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import decontaminate, mixing, nearcopies, quality, sharding
from corpuscle.llm.common import save, shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go.

    Each row is judged by itself, null texts as empty ones; repeated rows stay or go together. A score at the border
    stays. Without labels that teach anything all stay.
    """
    return quality.keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8) the document with the smallest doc_id stays.

    Candidates are SimHash links, checked by the shingles, and an exact prefix join finds those beyond the radius.
    Null and blank texts are copies of each other; a null doc_id comes last; of repeated rows one stays.
    """
    return nearcopies.keep_first(docs.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go: 80 % of some 16 words of it, or of all it has.

    Null and empty texts overlap nothing; repeated rows go together. An empty benchmark keeps all.
    """
    return decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document comes once per copy that its source's quota has room for.

    A null source is one of its own; null texts count one token. Repeated rows are taken together.
    """
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A uniform shuffle into eight shards whose sizes differ by one row at most, with gapless slots.

    Rows that are equal in all columns are interchangeable; all come.
    """
    return sharding.shard(docs.select(*COLUMNS))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: No stage but the last could be told in SQL: they train, hash with XXH64, or draw at random.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the stages' tables stay in the shared folder."""
    folder = f"{shared_dir(spark)}/corpuscle/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        save(stage(spark, docs, sf_dir), f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
