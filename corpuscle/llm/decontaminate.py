"""Benchmark decontamination through spaced seeds.

A seed hashes the words at the marked places of a mask and ignores the others, so a substituted word
hides only the seeds that look at it. Seeds of all document windows are joined with those of the
benchmark; around each hit the two texts are laid over one another and compared word by word. The masks of
an item's length are lossless: wherever the substitutions stand that the threshold allows, one of them is hit.
Columns only: no Python runs on the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, hot_join, let, written

#: Words that are compared at once, and the share of them that must be equal.
WINDOW, SIMILARITY = 16, 0.8
#: By the number of words that are compared (from the key up to the next): masks, marked places are 1. Each set
#: was found by a greedy search, and hits every placement of the substitutions that SIMILARITY allows.
MASKS = {
    1: ("1",),
    2: ("11",),
    3: ("111",),
    4: ("1111",),
    5: ("111", "1101"),
    7: ("11011",),
    10: ("111011", "11010011", "11111"),
    15: ("1111011", "11001000111", "11010110001"),
}
#: Hits of a document that are taken together.
TOGETHER = 4096


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits, in order; null text: none."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(df: DataFrame, hashes: str, groups: list[int], *kept: str) -> DataFrame:
    """A row ``(*kept, place, seed)`` per window and mask of the groups."""
    masks = [(g, i, [k for k, m in enumerate(mask) if m == "1"]) for g in groups for i, mask in enumerate(MASKS[g])]
    used = sorted({k for _, _, marked in masks for k in marked})
    shortest = min(marked[-1] for _, _, marked in masks)

    def windows(h: Column) -> Column:
        n = F.greatest(F.size(h) - shortest, F.lit(0))
        return F.arrays_zip(*[F.slice(h, k + 1, n) for k in used])

    # arrays_zip names its fields by their number, and has nulls beyond the text's end
    wide = df.select(*kept, F.posexplode(let(F.col(hashes), windows)).alias("place", "window"))
    at = lambda k: F.col("window").getField(str(used.index(k)))
    seeds = [F.when(at(marked[-1]).isNotNull(), F.xxhash64(F.lit(g), F.lit(i), *map(at, marked))) for g, i, marked in masks]
    return wide.select(*kept, "place", F.explode(F.array(*seeds)).alias("seed")).where("seed is not null")


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    item: str = "item_id",
    item_text: str = "text",
    similarity: float = SIMILARITY,
    broadcast_rows: int = 500_000,
) -> DataFrame:
    """Each pair of a document and a benchmark item that overlap, with the best overlap.

    Returns row (a hash of key and text), ``key``, ``item`` (the smallest id of the items with these words), n_items
    (their number), doc_start and item_start (words from 0), n_words and n_same. A pair overlaps if, on one
    alignment, some stretch of 16 words of the item (all its words, where it has fewer) has ``similarity`` of its
    words equal in the document; words beyond the document's ends are not equal. Items and documents of any length
    count, and none is missed. Null and empty texts overlap nothing. Rows of equal key and text give one row.
    The benchmark's seeds and the hits are broadcast only up to counted bounds; beyond them the joins shuffle.
    """
    if not SIMILARITY <= similarity <= 1:
        raise ValueError(f"the masks are laid out for a similarity of {SIMILARITY} or more")

    def small(df: DataFrame, n: int) -> DataFrame:
        return F.broadcast(df) if n <= broadcast_rows else df

    items = written(
        benchmark.select(col(item).alias("item"), word_hashes(col(item_text)).alias("item_words"))
        .groupBy("item_words")
        .agg(F.min("item").alias("item"), F.count(F.lit(1)).alias("n_items"))
        .where(F.size("item_words") > 0)
        .withColumn("class", F.xxhash64("item_words"))
        .withColumn("n_item", F.size("item_words"))
        .withColumn("width", F.least(F.lit(WINDOW), "n_item")),
        "items",
    )
    n_items = items.count()
    group = F.lit(1)
    for g in MASKS:
        group = F.when(F.col("width") >= g, g).otherwise(group)
    groups = sorted(r[0] for r in items.select(group.alias("g")).distinct().collect())  # as many as MASKS at most
    base = docs.select(col(key).alias("key"), col(text).alias("text")).withColumn("row", F.xxhash64("key", "text"))
    if not groups:
        groups, items = [max(MASKS)], items.where("false")
    parts = [_seeds(items.where(group == g), "item_words", [g], "class", "n_item").withColumnRenamed("place", "item_place") for g in groups]
    index = written(reduce(DataFrame.unionByName, parts), "seeds")
    seeds = _seeds(base.select("row", word_hashes(F.col("text")).alias("words")), "words", groups, "row")
    hits = written(
        seeds.join(small(index, index.count()), "seed")
        .select("row", F.struct("class", "n_item", (F.col("place") - F.col("item_place")).alias("shift")).alias("hit"))
        .distinct(),
        "hits",
    )
    n_hits = hits.count()
    counted = hot_join(hits, hits.groupBy("row").agg(F.count(F.lit(1)).alias("n")).withColumn("of", F.col("n")), "row", n_hits)
    chunk = F.pmod(F.xxhash64("hit"), F.ceil(F.col("of") / TOGETHER))
    by_row = written(counted.groupBy("row", chunk.alias("chunk")).agg(F.collect_list("hit").alias("hits")), "hits")

    def beside(words: Column) -> Column:
        """Of each hit, the document's words that lie over the item's."""
        return F.transform(
            F.col("hits"),
            lambda h: F.struct(
                h["class"].alias("class"),
                h["shift"].alias("shift"),
                F.slice(words, F.greatest(h["shift"], F.lit(0)) + 1, h["n_item"] + F.least(h["shift"], F.lit(0))).alias("over"),
            ),
        )

    aligned = (
        base.join(small(by_row, n_hits // 4), "row")
        .select("row", "key", F.explode(let(word_hashes(F.col("text")), beside)).alias("hit"))
        .select("row", "key", "hit.*")
        .join(small(items, n_items), "class")
    )
    first = F.greatest(-F.col("shift"), F.lit(0))
    equal = F.zip_with("over", F.slice("item_words", first + 1, F.size("over")), lambda a, b: (a == b).cast("int"))
    same = F.concat(F.array_repeat(F.lit(0), first), equal, F.array_repeat(F.lit(0), F.col("n_item") - first - F.size("over")))

    def best(same: Column) -> Column:
        """The stretch with the most equal words, the first of these."""
        starts = F.sequence(F.lit(0), F.col("n_item") - F.col("width"))
        counts = F.transform(
            starts, lambda s: F.struct(F.aggregate(F.slice(same, s + 1, F.col("width")), F.lit(0), lambda x, y: x + y).alias("n_same"), (-s).alias("at"))
        )
        return F.array_max(counts)

    return (
        aligned.withColumn("best", let(same, best))
        .where(F.col("best.n_same") >= F.ceil(F.col("width") * similarity))
        .select(
            "row", "key", "class", "item", "n_items",
            F.struct(
                "best.n_same",
                (-F.greatest(F.col("shift") - F.col("best.at"), F.lit(0))).alias("doc_at"),
                F.col("best.at").alias("item_at"),
                F.col("width").alias("n_words"),
            ).alias("best"),
        )
        .groupBy("row", "key", "class")
        .agg(F.first("item").alias("item"), F.first("n_items").alias("n_items"), F.max("best").alias("best"))
        .select(
            "row",
            F.col("key").alias(key),
            F.col("item").alias(item),
            "n_items",
            (-F.col("best.doc_at")).alias("doc_start"),
            (-F.col("best.item_at")).alias("item_start"),
            F.col("best.n_words").alias("n_words"),
            F.col("best.n_same").alias("n_same"),
        )
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", broadcast_rows: int = 500_000) -> DataFrame:
    """The documents that overlap a benchmark item, one row each, with the best of their overlaps.

    Columns and cases as of ``overlaps``, but n_items numbers all items that the document overlaps, so a passage
    that documents and items share costs a row a document. The best overlap has the largest share of equal words,
    then the most of them, then the first place in the document; ties go to the smallest item.
    """
    found = overlaps(docs, benchmark, text, key, item, broadcast_rows=broadcast_rows)
    order = F.struct((-F.col("n_same") / F.col("n_words")).alias("share"), (-F.col("n_same")).alias("same"), "doc_start", col(item).alias("item"), "item_start", "n_words", "n_same")
    best = found.groupBy("row").agg(F.first(col(key)).alias("key"), F.min(order).alias("best"), F.sum("n_items").alias("n_items"))
    return best.select("row", F.col("key").alias(key), F.col("best.item").alias(item), "n_items", "best.doc_start", "best.item_start", "best.n_words", "best.n_same")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", broadcast_rows: int = 500_000) -> DataFrame:
    """The documents that overlap no benchmark item, with their columns as they are.

    Null and empty texts and those of any length are kept or go by the rule of ``overlaps``; equal rows go together.
    Null keys are keys like others. An empty benchmark keeps all; an empty table stays empty.
    """
    (bad,) = fresh(docs, "bad")
    found = overlaps(docs, benchmark, text, key, broadcast_rows=broadcast_rows)
    rows = written(found.select(F.col("row").alias(bad)).distinct(), "contaminated")
    rows = F.broadcast(rows) if rows.count() <= broadcast_rows else rows
    return docs.join(rows, F.xxhash64(col(key), col(text)) == col(bad), "left_anti")


def contamination_report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contaminated documents of a table: doc_id, item_id, n_items, doc_start, item_start, n_words and n_same.

    Null and empty texts and items overlap nothing; texts count whole, however long. Rows of equal doc_id and text are one;
    ties between overlaps go to the first place in the document, then to the smallest item. A null doc_id is a value like
    others. Other columns are left out, whatever their names; an empty table or benchmark gives an empty result.
    """
    return contaminated(documents, benchmark).drop("row")
