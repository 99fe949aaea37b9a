"""Sentences: boundaries told by what the corpus itself shows of abbreviations, collocations and words that start sentences.

A period after a word ends a sentence unless the word is an abbreviation. Abbreviations are words that stand before a
period far more often than chance has it, the shorter the likelier (a log likelihood ratio, after Kiss and Strunk 2006).
After one, a sentence ends only before a capital that is a usual start of sentences or a word also seen in lower case,
and not within a collocation. All statistics are counts of types, aggregated in part before each shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import text as X
from corpuscle.session import ship, written

#: Fixed values of the published method: the share of periods after an abbreviation, and the ratios' thresholds.
ABBREVIATION_SHARE, ABBREVIATION, STARTER, COLLOCATION = 0.99, 0.3, 30.0, 7.88
#: Marks around a word, and marks of a clause after it.
AROUND = r"""^[^\p{L}\p{N}]+|["'”’»)\]}]+$"""
AFTER = r"[.!?,;:]+$"
#: Tables of types are broadcast up to so many rows; beyond, they are joined by shuffle.
BROADCAST_ROWS = 200_000


def few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def words(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, words)``: the words between blanks, without tags and URLs, case kept."""

    def parted(texts: pa.Array) -> pa.Array:
        plain = pc.replace_substring_regex(pc.replace_substring_regex(pc.fill_null(texts, ""), X.TAG, " "), X.URL, " ")
        lists = pc.split_pattern(pc.replace_substring_regex(plain, f"[{X.SPACES[1:]}]", " "), " ")
        flat = lists.flatten()
        said = pc.not_equal(flat, "")
        before = np.append(0, np.cumsum(said.to_numpy(zero_copy_only=False)))
        ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
        return pa.ListArray.from_arrays(pa.array(before[ends], pa.int32()), flat.filter(said))

    ship(docs.sparkSession)
    return docs.select(F.col(key).alias("doc_id"), F.arrow_udf(parted, "array<string>")(F.col(text)).alias("words"))


#: The marks that end a word, by their numbers.
MARKS = ["!", "..", "."]


def marked(told: DataFrame) -> DataFrame:
    """``(doc_id, i, type, lower, mark, next, upper, n)``: each word that a mark ends, its type, the next word's type and case; n is 1.

    Of other words, which are most, each batch tells type, case and how many they are (n) only. mark: ``!`` (or ?), ``.``, ``..``
    (several periods) or none. ``next`` is null at the end of a document. Each distinct word of a batch is looked at once.
    """
    ship(told.sparkSession)
    fields = f"doc_id {told.schema['doc_id'].dataType.simpleString()}, i int, type string, lower boolean, mark string, next string, upper boolean, n bigint"
    names = ["doc_id", "i", "type", "lower", "mark", "next", "upper", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            lists = got.column("words")
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            coded = lists.flatten().dictionary_encode()
            ids, core = coded.indices.to_numpy(zero_copy_only=False), pc.replace_substring_regex(coded.dictionary, AROUND, "")
            kind = pc.utf8_lower(pc.replace_substring_regex(core, AFTER, ""))
            starts = lambda p: pc.match_substring_regex(core, p)
            lower, upper = starts(r"^\p{Ll}"), starts(r"^\p{Lu}")
            has = [starts(p).to_numpy(zero_copy_only=False) for p in (r"[!?]$", r"\.\.$", r"\.$")]
            mark = np.select(has, [0, 1, 2], -1)[ids]
            at = np.flatnonzero(mark >= 0)
            row, ends = np.repeat(np.arange(len(size)), size)[at], np.cumsum(size)
            last = at + 1 == ends[row]
            here, after = pa.array(ids[at]), pa.array(ids[np.minimum(at + 1, len(ids) - 1)] if len(at) else ids[at], mask=last)
            place = pa.array(at - (ends - size)[row], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [got.column("doc_id").take(pa.array(row)), place, kind.take(here), lower.take(here), pa.array(MARKS).take(pa.array(mark[at])), kind.take(after), upper.take(after), pa.array(np.ones(len(at), np.int64))], names
            )
            often = np.bincount(ids[mark < 0], minlength=len(core))
            of = pa.array(np.flatnonzero(often))
            none = lambda t: pa.nulls(len(of), t)
            yield pa.RecordBatch.from_arrays(
                [none(got.column("doc_id").type), none(pa.int32()), kind.take(of), lower.take(of), none(pa.string()), none(pa.string()), none(pa.bool_()), pa.array(often[often > 0], pa.int64())], names
            )

    return told.mapInArrow(run, fields)


def _xlogy(x: Column, y: Column) -> Column:
    return F.when(x == 0, 0.0).otherwise(x * F.log(y))


def types(rows: DataFrame) -> DataFrame:
    """``(type, a, ab, seen_lower)``: how often each type stands, how often before a period, and whether in lower case; ``rows`` as of ``marked``."""
    return rows.groupBy("type").agg(F.sum("n").alias("a"), F.count_if(F.coalesce(F.col("mark") == ".", F.lit(False))).alias("ab"), F.max("lower").alias("seen_lower"))


def abbreviations(rows: DataFrame) -> DataFrame:
    """``(type, score)`` of types that a period belongs to; ``rows`` as of ``marked``, or their ``types``."""
    kinds = rows if "seen_lower" in rows.columns else types(rows)
    n, periods = kinds.agg(F.sum("a"), F.sum("ab")).first()
    if not periods:
        return kinds.select("type", F.lit(0.0).alias("score")).where("false")
    counted = kinds.where(F.col("type").rlike(r"\p{L}")).select("type", F.col("ab").cast("double").alias("ab"), F.col("a").cast("double").alias("a"))
    p, q, ab, rest = periods / n, ABBREVIATION_SHARE, F.col("ab"), F.col("a") - F.col("ab")
    ratio = -2 * (_xlogy(ab, F.lit(p)) + _xlogy(rest, F.lit(1 - p)) - _xlogy(ab, F.lit(q)) - _xlogy(rest, F.lit(1 - q)))
    bare = F.length(F.replace("type", F.lit("."), F.lit("")))
    score = ratio * F.exp(-bare) * (F.length("type") - bare + 1) * F.pow(F.greatest(bare, F.lit(1)).cast("double"), -rest)
    return counted.where("ab > 0").select("type", score.alias("score")).where(F.col("score") >= ABBREVIATION)


def likelihood_ratio(a: Column, b: Column, ab: Column, n: float) -> Column:
    """How unlikely it is that b comes with a (``ab`` of ``a`` times) as often as everywhere (``b`` of ``n`` times)."""
    p, p1, p2, out = b / n, ab / a, F.try_divide(b - ab, n - a), n - a - b + ab
    alone = _xlogy(ab, p) + _xlogy(a - ab, 1 - p) + _xlogy(b - ab, p) + _xlogy(out, 1 - p)
    return -2 * (alone - _xlogy(ab, p1) - _xlogy(a - ab, 1 - p1) - _xlogy(b - ab, p2) - _xlogy(out, 1 - p2))


def boundaries(rows: DataFrame) -> DataFrame:
    """``(doc_id, i)``: the words that end a sentence; ``rows`` as of ``marked``, a table."""
    kinds = written(types(rows), "types")
    short = written(abbreviations(kinds).select("type", F.lit(True).alias("short")), "abbreviations")
    ends = written(rows.where("mark is not null").join(few(short), "type", "left").fillna(False, ["short"]), "ends")
    sure = ends.where((F.col("mark") == "!") | ((F.col("mark") == ".") & ~F.col("short")))
    total = float(kinds.agg(F.sum("a")).first()[0] or 0)
    known = kinds.where("type <> ''").select("type", F.col("a").cast("double").alias("b"), "seen_lower")
    began = sure.where("next is not null").groupBy(F.col("next").alias("type")).agg(F.count(F.lit(1)).cast("double").alias("ab"))
    breaks = float(sure.where("next is not null").count())
    starters = began.join(known, "type").where(F.col("ab") * total > F.col("b") * breaks)
    starters = starters.where(likelihood_ratio(F.lit(breaks), F.col("b"), F.col("ab"), total) >= STARTER).select(F.col("type").alias("next"), F.lit(True).alias("starts"))
    asked = ends.where((F.col("mark") == ".") & F.col("short"))
    met = asked.where("next is not null").groupBy("type", "next").agg(F.count(F.lit(1)).cast("double").alias("ab"))
    both = met.join(known.select("type", F.col("b").alias("a")), "type").join(known.select(F.col("type").alias("next"), "b"), "next")
    bound = both.where((F.col("ab") * total > F.col("a") * F.col("b")) & (likelihood_ratio(F.col("a"), F.col("b"), F.col("ab"), total) >= COLLOCATION)).select("type", "next", F.lit(True).alias("bound"))
    lower = known.where("seen_lower").select(F.col("type").alias("next"), "seen_lower")
    tried = asked.join(bound, ["type", "next"], "left").join(starters, "next", "left").join(lower, "next", "left").fillna(False, ["bound", "starts", "seen_lower"])
    after = tried.where(F.col("next").isNull() | (F.col("upper") & ~F.col("bound") & (F.col("starts") | F.col("seen_lower"))))
    trailing = ends.where((F.col("mark") == "..") & (F.col("next").isNull() | F.col("upper")))
    return sure.select("doc_id", "i").unionByName(after.select("doc_id", "i")).unionByName(trailing.select("doc_id", "i"))


def sentences(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, sentence, start, n_words, text)``: sentences numbered from 0, with the place of their first word.

    Keys are unique. Null and blank texts have none. What follows the last boundary is a sentence, too.
    """
    told = written(words(docs, text, key), "words")
    ends = boundaries(written(marked(told), "marked")).groupBy("doc_id").agg(F.array_sort(F.collect_list("i")).alias("ends"))
    rows = told.join(ends, "doc_id", "left").select("doc_id", "words", F.coalesce("ends", F.array().cast("array<int>")).alias("ends"))
    last = F.size("words") - 1
    stops = F.when(F.size("words") == 0, F.array().cast("array<int>")).otherwise(F.array_distinct(F.concat("ends", F.array(last))))
    cut = X.let(stops, lambda own: F.transform(own, lambda stop, k: F.struct(F.when(k == 0, 0).otherwise(F.get(own, k - 1) + 1).alias("start"), stop.alias("stop"))))
    parts = rows.select("doc_id", "words", F.posexplode(cut).alias("sentence", "s"))
    n = F.col("s.stop") - F.col("s.start") + 1
    return parts.select("doc_id", "sentence", F.col("s.start").alias("start"), n.alias("n_words"), F.array_join(F.slice("words", F.col("s.start") + 1, n), " ").alias("text"))
