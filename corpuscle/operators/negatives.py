"""Negative samples: words drawn by their frequency from an alias table, by a hash of the pair they are drawn for."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.session import ship, written

from . import embed
from .lexical import exploded, hashes_apart, term_frequency
from .order import accumulate

#: Weights are whole numbers: so many times a count's power.
SCALE = 1_000
#: An alias table is broadcast up to so many words; beyond, draws are joined with it by shuffle.
BROADCAST_ROWS = 200_000
#: All tasks are told so many words' hashes and buckets, sixteen bytes each, and count draws in eight bytes a word.
TOLD_WORDS = 32_000_000
#: Words whose pairs are hashed at once, digests that are made at once, and buckets whose counts are a row.
PAIRED_WORDS, DIGESTS, SLICE = 50_000, 16_384, 1 << 16


def alias_table(frequency: DataFrame, power: float = 0.75) -> DataFrame:
    """``(bucket, term, keep, other, n, total)`` of ``(term, cnt)``: a table in the shared folder, a row a word.

    A word's weight is its count's ``power`` (0: all alike). Of ``n`` buckets of ``total`` each, ``bucket`` holds ``keep``
    of its own word and for the rest another, so a draw is one bucket and one coin. Words below the mean are filled up by
    words above it, in order; two running totals tell which: a light word takes from the first heavy one whose excess
    is not used up, a heavy word that gives too much is filled up by the next. All in whole numbers, so exact.
    """
    weights = written(frequency.select("term", F.greatest(F.lit(1), F.round(F.pow(F.col("cnt").cast("double"), F.lit(power)) * SCALE)).cast("long").alias("w")), "weights")
    n, total = weights.agg(F.count(F.lit(1)), F.coalesce(F.sum("w"), F.lit(0))).first()
    mass = weights.select("term", (F.col("w") * n - total).alias("over"))
    light = written(accumulate(mass.where("over <= 0").select("term", (-F.col("over")).alias("lacks")), ["term"], {"d": "lacks"}), "light")
    heavy = written(accumulate(mass.where("over > 0"), ["term"], {"e": "over"}), "heavy")

    def first_beyond(of: DataFrame, x: Column, among: DataFrame, y: str) -> DataFrame:
        """Of each row the ``place`` of the first of ``among`` beyond it: how many of these come before, ties included as ``among`` comes."""
        asked = of.select(x.alias("x"), "term", F.lit(0).alias("one"))
        events = asked.unionByName(among.select(F.col(y).alias("x"), "term", F.lit(1).alias("one")))
        order = ["x", "last", "term"]
        events = events.withColumn("last", F.col("one") if y == "d" else -F.col("one"))
        return accumulate(events, order, {"ahead": "one"}).where("one = 0").select("term", F.col("ahead").cast("long").alias("at"))

    giver = first_beyond(light, F.col("d") - F.col("lacks"), heavy, "e")
    heavies = heavy.select(F.col("place").alias("at"), F.col("term").alias("other"))
    lights = light.join(giver, "term").join(heavies, "at", "left").select(F.col("place").alias("bucket"), "term", (F.lit(total) - F.col("lacks")).alias("keep"), "other")
    taker = first_beyond(heavy, F.col("e"), light, "d")
    taken = light.select(F.col("place").alias("at"), "d")
    after = heavies.select((F.col("at") - 1).alias("place"), "other")
    filled = heavy.join(taker, "term").join(taken, "at", "left").join(after, "place", "left")
    shares = filled.select((F.col("place") + light.count()).alias("bucket"), "term", (F.lit(total) + F.col("e") - F.coalesce("d", "e")).alias("keep"), "other")
    both = lights.unionByName(shares).withColumn("other", F.coalesce("other", "term"))
    return written(both.select("*", F.lit(n).cast("long").alias("n"), F.lit(total).cast("long").alias("total")), "alias")


def _number(digest: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def _placed(pairs: DataFrame, size, negatives: int, seed: int) -> DataFrame:
    """``pairs`` with each draw's ``bucket`` and ``__coin``."""
    asked = pairs.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(negatives - 1))))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), "pos", "at", "__k"))
    return asked.withColumn("__h", digest).withColumns({"bucket": _number(F.col("__h"), 1, 8) % size["n"], "__coin": _number(F.col("__h"), 9, 15) % size["total"]})


def draws(pairs: DataFrame, table: DataFrame, negatives: int = 1, seed: int = 42) -> DataFrame:
    """``pairs`` with ``drawn``, ``negatives`` rows each: words drawn by the MD5 of seed, document, both places and number.

    Nothing but these bears on a draw, so a repeated task, another layout or another run draws the same. ``pairs`` has
    ``doc_id``, ``pos`` and ``at`` (``embed.skipgram_pairs``). An empty table draws nothing.
    """
    size = table.select("n", "total").first()
    if size is None:
        return pairs.withColumn("drawn", F.lit(None).cast("string")).where("false")
    drawn = _placed(pairs, size, negatives, seed)
    buckets = table.select("bucket", "term", "keep", "other")
    found = drawn.join(F.broadcast(buckets) if size["n"] <= BROADCAST_ROWS else buckets, "bucket")
    return found.select(*pairs.columns, F.when(F.col("__coin") < F.col("keep"), F.col("term")).otherwise(F.col("other")).alias("drawn"))


def draw_counts(pairs: DataFrame, table: DataFrame, negatives: int = 1, seed: int = 42) -> DataFrame:
    """``(term, cnt)``: how often ``draws`` draws each word. Only its bucket and coin bear on a draw, so nothing else of a pair moves."""
    size = table.select("n", "total").first()
    if size is None:
        return table.select("term", F.lit(0).cast("long").alias("cnt"))
    buckets = table.select("bucket", "term", "keep", "other")
    drawn = _placed(pairs.select("doc_id", "pos", "at"), size, negatives, seed).select("bucket", "__coin")
    found = drawn.join(F.broadcast(buckets) if size["n"] <= BROADCAST_ROWS else buckets, "bucket")
    word = F.when(F.col("__coin") < F.col("keep"), F.col("term")).otherwise(F.col("other")).alias("term")
    return found.select(word).groupBy("term").agg(F.count(F.lit(1)).alias("cnt"))


def packed_draw_counts(rows: DataFrame, window: int = 5, min_count: int = 2, negatives: int = 1, seed: int = 42) -> DataFrame:
    """``draw_counts`` of the skip-gram pairs of documents ``(doc_id, terms)`` (``lexical.cut``), a table with a row a document.

    Tasks are told the hashes of the words that occur ``min_count`` times and what each bucket keeps, so draws are made and counted
    where documents lie: neither words nor pairs nor draws move, but a task's counts, packed. Two words of one hash, or more
    words than TOLD_WORDS, leave it to ``draw_counts``.
    """
    spark, told = rows.sparkSession, exploded(rows, F.col("terms"), "term")
    frequency = written(term_frequency(told), "frequency")
    table = alias_table(frequency.where(F.col("cnt") >= min_count))
    size = table.select("n", "total").first()
    if size is None:
        return table.select("term", F.lit(0).cast("long").alias("cnt"))
    if size["n"] > TOLD_WORDS or not hashes_apart(frequency.select("term")):
        return draw_counts(embed.skipgram_pairs(told, window, min_count), table, negatives, seed)
    n, total = size["n"], size["total"]
    ship(spark)
    kept = table.select("bucket", "keep").toArrow()
    keep = np.empty(n, np.int64)
    keep[kept["bucket"].to_numpy()] = kept["keep"].to_numpy()
    shared = spark.sparkContext.broadcast((np.sort(table.select(F.xxhash64("term").alias("h")).toArrow()["h"].to_numpy()), keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (hashes, keep), drawn = shared.value, np.zeros(2 * n, np.int32)
        for got in batches:
            lists = got.column("keys")
            long = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
            keys, row = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(long)), long)
            known = np.flatnonzero(hashes[np.minimum(np.searchsorted(hashes, keys), n - 1)] == keys)
            row, place = row[known], known - np.append(0, np.cumsum(long))[row[known]]
            for x in range(0, len(row), PAIRED_WORDS):
                i = [x + np.flatnonzero(row[x : min(x + PAIRED_WORDS, len(row) - k)] == row[x + k : x + PAIRED_WORDS + k]) for k in range(1, window + 1) if x + k < len(row)]
                if not i:
                    continue
                here, there = np.concatenate(i), np.concatenate([own + k for k, own in enumerate(i, 1)])
                here, there = np.concatenate([here, there]), np.concatenate([there, here])
                for k in range(negatives):
                    for a, b, c in _digests(got.column("head"), row[here], place[here], place[there], k):
                        bucket, coin = a.byteswap().astype(np.int64) % n, (b.byteswap().astype(np.int64) << 28 | c.byteswap().astype(np.int64) >> 4) % total
                        np.add.at(drawn, 2 * bucket + (coin >= keep[bucket]), 1)
        for i in range(0, n, SLICE):
            own = drawn[2 * i : 2 * (i + SLICE)]
            if most := int(own.max()):
                width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
                yield pa.RecordBatch.from_arrays([pa.array([i // SLICE], pa.int32()), pa.array([width], pa.int32()), pa.array([own.astype(f"u{width}").tobytes()])], ["slice", "width", "counts"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, of = None, None

        def done() -> Iterator[pa.RecordBatch]:
            at = np.flatnonzero(sums.reshape(-1, 2).any(axis=1))
            own, rest = sums.reshape(-1, 2)[at].T
            yield pa.RecordBatch.from_arrays([pa.array(at + of * SLICE), pa.array(np.ascontiguousarray(own)), pa.array(np.ascontiguousarray(rest))], ["bucket", "own", "rest"])

        for got in batches:
            for i, width, counts in zip(*(got.column(c).to_pylist() for c in ("slice", "width", "counts")), strict=True):
                if i != of:
                    if of is not None:
                        yield from done()
                    sums, of = np.zeros(len(counts) // width, np.int64), i
                sums += np.frombuffer(counts, f"u{width}")
        if of is not None:
            yield from done()

    cores = spark.sparkContext.defaultParallelism
    head = F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")).alias("head")
    asked = rows.select(head, F.transform("terms", lambda t: F.xxhash64(t)).alias("keys")).coalesce(4 * cores)
    packed = asked.mapInArrow(run, "slice int, width int, counts binary").repartitionById(min(4 * cores, -(-n // SLICE)), F.pmod("slice", F.lit(min(4 * cores, -(-n // SLICE)))))
    found = packed.sortWithinPartitions("slice").mapInArrow(added, "bucket long, own long, rest long").join(table, "bucket")
    both = F.explode(F.array(F.struct("term", F.col("own").alias("cnt")), F.struct(F.col("other").alias("term"), F.col("rest").alias("cnt"))))
    return found.select(both.alias("w")).where("w.cnt > 0").groupBy("w.term").agg(F.sum("w.cnt").alias("cnt"))


#: MD5's constants (RFC 1321).
SINES = np.array([int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)], np.uint32)
TURNS = [t for turns in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in turns * 4]
BEGIN = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _md5(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first three words of the MD5 of many padded messages of one block, ``words``: 16 rows of a number a message."""
    a, b, c, d = (np.full(words.shape[1], x) for x in BEGIN)
    for i in range(64):
        if i < 16:
            f, at = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, at = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, at = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, at = c ^ (b | ~d), 7 * i % 16
        f += a
        f += SINES[i]
        f += words[at]
        a, d, c = d, c, b
        b = b + (f << np.uint32(TURNS[i]) | f >> np.uint32(32 - TURNS[i]))
    return a + BEGIN[0], b + BEGIN[1], c + BEGIN[2]


def _digests(heads: pa.Array, row: np.ndarray, pos: np.ndarray, at: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The first three words of the MD5 of ``head:pos:at:k``, in any order: messages of one layout together."""
    heads = [h.encode() for h in heads.to_pylist()]
    size, powers, end = np.array([len(h) for h in heads]), 10 ** np.arange(1, 19), f":{k}".encode()
    digits = [1 + np.searchsorted(powers, x, side="right") for x in (pos, at)]
    layout = (size[row] * 32 + digits[0]) * 32 + digits[1]
    order = np.argsort(layout, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(layout[order])) + 1):
        if not len(own):
            continue
        long, *wide = int(size[row[own[0]]]), int(digits[0][own[0]]), int(digits[1][own[0]])
        whole = long + sum(wide) + 2 + len(end)
        if whole > 55:  # more than a block
            made = [np.frombuffer(hashlib.md5(heads[r] + b":%d:%d" % (p, q) + end, usedforsecurity=False).digest(), "<u4") for r, p, q in zip(row[own], pos[own].tolist(), at[own].tolist(), strict=True)]
            yield tuple(np.array(made)[:, :3].T.copy())
            continue
        letters = np.array([list(h) if len(h) == long else [0] * long for h in heads], np.uint8).reshape(len(heads), long)
        for x in range(0, len(own), DIGESTS):
            here = own[x : x + DIGESTS]
            text = np.zeros((len(here), 64), np.uint8)
            text[:, :long] = letters[row[here]]
            start = long
            for values, many in ((pos[here], wide[0]), (at[here], wide[1])):
                text[:, start] = ord(":")
                for d in range(many):
                    values, text[:, start + many - d] = values // 10, values % 10 + ord("0")
                start += many + 1
            text[:, start : whole] = list(end)
            text[:, whole], text[:, 56], text[:, 57] = 0x80, 8 * whole & 255, 8 * whole >> 8
            yield _md5(np.ascontiguousarray(text.view("<u4").T))


def with_negatives(pairs: DataFrame, table: DataFrame, negatives: int = 1, seed: int = 42) -> DataFrame:
    """``(center, context, label)``: each pair (1) and the same centre with words drawn from ``table`` (0).

    The drawn word may be the true context.
    """
    drawn = draws(pairs, table, negatives, seed).select("center", F.col("drawn").alias("context"))
    return pairs.select("center", "context").withColumn("label", F.lit(1)).unionByName(drawn.withColumn("label", F.lit(0)))


def subsample(tokens: DataFrame, frequency: DataFrame, threshold: float = 1e-3, seed: int = 42) -> DataFrame:
    """``tokens`` less some of the frequent words': of a share f of all, sqrt(t / f) + t / f stay, chosen by a hash of the place."""
    total = frequency.agg(F.sum("cnt")).first()[0] or 1
    ratio = F.lit(threshold * total) / F.col("cnt")
    often = frequency.where(F.col("cnt") > threshold * total).select("term", (F.sqrt(ratio) + ratio).alias("__stay"))  # fewer than 1 / threshold
    coin = _number(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), "pos")), 1, 13) / float(16**13)
    return tokens.join(F.broadcast(often), "term", "left").where(F.col("__stay").isNull() | (coin < F.col("__stay"))).select(*tokens.columns)
