"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix.

Logical partitions are hash buckets of the rows, so they are the same whatever the physical layout
and however often a lost task is repeated. The driver draws, for each partition, how many of its rows
each shard gets (multivariate hypergeometric over the capacities that are left: only partitions x
shards numbers). Each partition permutes its rows and deals them by these counts; after the
exchange each shard permutes again, in random blocks whose sizes give the offsets of the slots.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, fresh, row_key, rows_of, written

#: numpy's hypergeometric sampler takes no population beyond this.
NUMPY_MOST = 10**9
#: A logical partition with so many times the usual rows has many equal ones.
CROWD = 8


def communication_matrix(counts: list[int], capacities: list[int], seed: int) -> np.ndarray:
    """``[partition, shard]`` counts of a uniform random deal; rows sum to ``counts``, columns to ``capacities``."""
    if sum(counts) != sum(capacities):
        raise ValueError(f"{sum(counts)} rows for {sum(capacities)} places")
    rng = np.random.default_rng(seed)
    left = np.array(capacities, dtype=np.int64)
    matrix = np.zeros((len(counts), len(capacities)), dtype=np.int64)
    for p, n in enumerate(counts):
        if left.sum() < NUMPY_MOST:
            drawn = rng.multivariate_hypergeometric(left, n, method="marginals")
        else:
            drawn = _distinct_places(rng, left, n)
        matrix[p] = drawn
        left -= drawn
    return matrix


def _distinct_places(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """The same draw for large populations: ``n`` distinct places, counted by shard."""
    ends, places = np.cumsum(left), np.empty(0, dtype=np.int64)
    while len(places) < n:
        drawn = np.concatenate([places, rng.integers(0, ends[-1], n - len(places))])
        _, first = np.unique(drawn, return_index=True)
        places = drawn[np.sort(first)]
    return np.bincount(np.searchsorted(ends, places, side="right"), minlength=len(left))


def shard(
    df: DataFrame,
    shards: int = 8,
    seed: int = 1,
    rows_per_part: int = 512,
    max_parts: int = 16384,
    rows_per_block: int = 1024,
    max_blocks: int = 16384,
) -> DataFrame:
    """All rows of ``df`` with ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in each shard).

    Shard sizes differ by one at most; the first ``n mod shards`` shards are the larger ones. Any values,
    nulls included, are allowed, and texts of any length: rows are told apart by a hash of all columns. Rows that are
    equal in all columns are interchangeable; where they crowd a partition, the table is written once more with a
    number for each row, by which these are spread. An empty table gives an empty result. Columns of ``df`` named ``shard``
    or ``slot`` are replaced; all others are kept.
    """
    if shards < 1:
        raise ValueError("shards must be 1 at least")
    df = df.drop("shard", "slot")
    spark, kept = df.sparkSession, df.columns
    key, part, rank, ends, block, offset, out_shard = fresh(df, "key", "part", "rank", "ends", "block", "offset", "shard")
    n = df.count()
    parts = max(1, min(max_parts, math.ceil(n / rows_per_part)))
    blocks = max(1, min(max_blocks, math.ceil(n / shards / rows_per_block)))

    def random(salt: int):
        return F.xxhash64(F.lit(f"{seed}/{salt}"), col(key))

    def parted(rows: DataFrame) -> tuple[DataFrame, dict[int, int]]:
        rows = rows.withColumn(part, F.pmod(random(0), F.lit(parts)).cast("int"))
        return rows, {r[0]: r[1] for r in rows.groupBy(part).count().collect()}  # max_parts rows at most

    keyed, counted = parted(df.withColumn(key, row_key(df)))
    crowded = [p for p, c in counted.items() if c > CROWD * max(rows_per_part, n // parts)]  # under parts / CROWD
    if crowded:
        numbered = written(df.withColumn(rank, F.monotonically_increasing_id()), "shard")
        own = row_key(numbered.drop(rank))
        keyed = numbered.withColumn(key, own).withColumn(part, F.pmod(random(0), F.lit(parts)).cast("int"))
        spread = F.when(col(part).isin(crowded), F.xxhash64(col(key), col(rank))).otherwise(col(key))
        keyed, counted = parted(keyed.withColumn(key, spread).drop(rank))
    counts = [counted.get(p, 0) for p in range(parts)]
    total = sum(counts)
    capacities = [total // shards + (s < total % shards) for s in range(shards)]
    dealt = np.cumsum(communication_matrix(counts, capacities, seed), axis=1)
    deal = rows_of(spark, [(p, dealt[p].tolist()) for p in range(parts)], f"{part} int, {ends} array<bigint>")

    permuted = keyed.withColumn(rank, F.row_number().over(Window.partitionBy(part).orderBy(random(1), col(key))))
    placed = (
        permuted.join(F.broadcast(deal), part)  # max_parts rows of `shards` numbers at most
        .withColumn(out_shard, F.size(F.filter(col(ends), lambda e: e < col(rank))).cast("int"))
        .withColumn(block, F.pmod(random(2), F.lit(blocks)).cast("int"))
    )
    in_order = Window.partitionBy(out_shard).orderBy(block)
    offsets = (
        placed.groupBy(out_shard, block)
        .agg(F.count(F.lit(1)).alias(offset))
        .withColumn(offset, F.sum(offset).over(in_order) - col(offset))
    )
    again = Window.partitionBy(out_shard, block).orderBy(random(3), col(key))
    return (
        placed.withColumn(rank, F.row_number().over(again))
        .join(F.broadcast(offsets), [out_shard, block])  # shards x max_blocks rows at most
        .select(*[col(c) for c in kept], col(out_shard).alias("shard"), (col(offset) + col(rank) - 1).alias("slot"))
    )


def shard_digest(documents: DataFrame, shards: int = 8, seed: int = 1) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of all documents (null text: no bytes).

    Null doc_ids, repeated rows, texts of any length and empty tables are as in ``shard``; other columns may have any
    name, as only doc_id and text are read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = documents.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    return shard(narrow, shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
