"""Where corpora, vectors and queries come from."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.session import written

ANNOTATIONS = T.StructType(
    [
        T.StructField("arxiv_id", T.StringType()),  # read as text: a number would lose trailing zeros
        T.StructField("abstract", T.StringType()),
        T.StructField("start_idx", T.IntegerType()),
        T.StructField("end_idx", T.IntegerType()),
        T.StructField("label", T.StringType()),
    ]
)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """The sentence-level CSV with a header; quoted abstracts may hold line breaks."""
    return spark.read.schema(ANNOTATIONS).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def in_file_order(rows: DataFrame) -> DataFrame:
    """``rows`` as read from files, with ``place``: file, offset of the block and number in it, ascending as the rows stand.

    Nothing is sorted; rows and places are written to the shared folder, so every later pass sees the same. Files come
    in the order of their paths.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return written(rows.select("*", place.alias("place")), "placed")


def first_existing(spark: SparkSession, paths: Iterable[str]) -> str:
    """The first path that exists, on any file system that Spark knows. Raises FileNotFoundError."""
    paths = list(paths)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        place = jvm.org.apache.hadoop.fs.Path(p)
        if place.getFileSystem(conf).exists(place):
            return p
    raise FileNotFoundError(f"none of {', '.join(paths)}")


def corpus_of(spark: SparkSession, texts: Iterable[str | None], ids: Iterable[str] | None = None) -> DataFrame:
    """A corpus ``(doc_id, text)`` of texts in memory; ids are places where none are given."""
    texts = list(texts)
    keys = list(range(len(texts))) if ids is None else list(ids)
    kind = T.LongType() if ids is None else T.StringType()
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("text", T.StringType())])
    return spark.createDataFrame(list(zip(keys, texts, strict=True)), schema)


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``(word, vector)`` from Parquet, or from text lines ``word v1 v2 ...`` with or without a header line."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path).select("word", "vector")
    lines = spark.read.text(path)
    return lines.selectExpr("split(trim(value), ' ') AS parts").where("size(parts) > 2").selectExpr(
        "parts[0] AS word", "transform(slice(parts, 2, size(parts) - 1), x -> cast(x AS float)) AS vector"
    )


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan has fewer partitions than these: a small file is often one row group."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
