"""Licence scan with a positional index of rare tokens.

The licence words' IDF over all files ranks the words of each template. Of each file the words of highest IDF that
it shares with a template are looked up in the templates' postings; occurrences that agree on the relative position
vote for a template at a place. A place with votes enough is a licence notice if one of the template's mandatory
phrases stands there. Columns only: no Python runs on the executors.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import license_texts
from .common import col, let, rows_of, written

#: Phrases that give a label wherever they stand.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: (label, wording of the licence or notice, mandatory phrases), and of each wording its words.
TEMPLATES = [(label, " ".join(text.split()), phrases) for label, text, phrases in license_texts.TEMPLATES]
#: So many of a file's words of highest IDF are looked up for each template.
RARE = 8
#: Every phrase above holds one of these; files without any need no look at their places.
STEMS = ("licen", "redistribution", "permission", "creative", "unencumbered", "altered source")
#: Between words: the ASCII characters that are neither letters nor digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text (null: none) in lower case. That of other letters than A-Z moves no border of a word."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _phrase_at(words: Column, i: Column, phrase: str) -> Column:
    return reduce(lambda a, b: a & b, [F.get(words, i + k).eqNullSafe(F.lit(w)) for k, w in enumerate(phrase.split())])


def _places(words: Column) -> Column:
    """``(at, label)`` of every place where a phrase stands."""

    def label(i: Column) -> Column:
        first = F.when(_phrase_at(words, i, next(iter(PHRASES))), next(iter(PHRASES.values())))
        for phrase, name in list(PHRASES.items())[1:]:
            first = first.when(_phrase_at(words, i, phrase), name)
        return first

    labelled = F.transform(words, lambda _, i: F.struct(i.alias("at"), label(i).alias("label")))
    return F.filter(labelled, lambda x: x["label"].isNotNull())


def _mandatory(words: Column) -> Column:
    """``(phrase, at)`` of every place where a mandatory phrase stands."""

    def places_of(phrase: str) -> Column:
        at = F.transform(words, lambda _, i: F.struct(F.lit(phrase).alias("phrase"), i.alias("at")))
        return F.filter(at, lambda x: _phrase_at(words, x["at"], phrase))

    return F.flatten(F.array(*[places_of(p) for p in sorted({p for _, _, ps in TEMPLATES for p in ps})]))


def vocabulary() -> list[str]:
    return sorted({w for _, text, _ in TEMPLATES for w in text.split()})


def rules(spark: SparkSession) -> DataFrame:
    """``(template, label, phrase, phrase_place)`` of each template's mandatory phrases."""
    rows = []
    for t, (label, text, phrases) in enumerate(TEMPLATES):
        words = text.split()
        for p in phrases:
            n = len(p.split())
            rows += [(t, label, p, i) for i in range(len(words)) if " ".join(words[i : i + n]) == p]
    return rows_of(spark, rows, "template int, label string, phrase string, phrase_place int")


def postings(spark: SparkSession, idf: dict[str, float]) -> DataFrame:
    """``(template, word, place, idf)``: where the words of each template stand in it."""
    rows = [(t, w, i, idf[w]) for t, (_, text, _) in enumerate(TEMPLATES) for i, w in enumerate(text.split())]
    return rows_of(spark, rows, "template int, word string, place int, idf double")


def by_rarity(template: int, idf: dict[str, float]) -> list[str]:
    """A template's words, those of highest IDF first, ties by word."""
    return sorted(set(TEMPLATES[template][1].split()), key=lambda w: (-idf[w], w))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", votes: float = 0.6) -> DataFrame:
    """A row per document: ``key``, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of the base phrases; first_word and last_word are the least and the largest of
    their starts (null: none). For each template the file's RARE words of highest IDF that the template has are
    looked up. A notice of the method needs, on one alignment, ``votes`` of the IDF that the template's own RARE
    highest words have, and a mandatory phrase there; so a notice with some of these altered is found by its next
    ones. ``score`` is the largest such share (0: no notice). Labels are distinct, sorted and comma-joined, '' if there
    are none. Null and empty texts have no words. Texts count whole, however long. Equal rows give equal rows, an
    empty table an empty result; other columns may have any name.
    """
    spark = docs.sparkSession
    vocab = F.array(*[F.lit(w) for w in vocabulary()])
    base = docs.select(col(key).alias("key"), col(text).alias("text"))
    may = reduce(lambda a, b: a | b, [F.lower("text").contains(s) for s in STEMS])

    def all_of(words: Column) -> Column:
        at = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: F.array_contains(vocab, x["word"]))
        seen = F.struct(_places(words).alias("base"), at.alias("at"), _mandatory(words).alias("phrases"))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.array_intersect(words, vocab).alias("present"),
            F.when(may, seen).alias("seen"),
        )

    scanned = written(
        base.select("key", F.xxhash64("key", "text").alias("row"), let(words_of(F.col("text")), all_of).alias("x")).select("key", "row", "x.*"),
        "licences",
    )
    n = max(1, scanned.count())
    df = {r[0]: r[1] for r in scanned.select(F.explode("present").alias("word")).groupBy("word").count().collect()}  # the vocabulary at most
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1e-9 for w in vocabulary()}
    where = F.broadcast(postings(spark, idf))  # the words of the templates
    ranked = [by_rarity(t, idf) for t in range(len(TEMPLATES))]
    mass = rows_of(spark, [(t, sum(idf[w] for w in words[:RARE])) for t, words in enumerate(ranked)], "template int, mass double")
    seen = scanned.where("seen is not null").dropDuplicates(["row"])

    def looked_up(template: int) -> Column:
        """The places of the file's rarest words of a template."""
        chosen = F.slice(F.array_intersect(F.array(*map(F.lit, ranked[template])), "present"), 1, RARE)
        at = F.filter("seen.at", lambda x: F.array_contains(chosen, x["word"]))
        return F.transform(at, lambda x: F.struct(F.lit(template).alias("template"), x["word"].alias("word"), x["at"].alias("at")))

    voted = (
        seen.select("row", F.explode(F.flatten(F.array(*map(looked_up, range(len(TEMPLATES)))))).alias("at"))
        .select("row", "at.*")
        .join(where, ["template", "word"])
        .select("row", "template", "word", "idf", (F.col("at") - F.col("place")).alias("shift"))
        .distinct()
        .groupBy("row", "template", "shift")
        .agg(F.sum("idf").alias("votes"))
        .join(F.broadcast(mass), "template")
        .withColumn("share", F.col("votes") / F.col("mass"))
        .where(F.col("share") >= votes)
    )
    phrases = seen.select("row", F.explode("seen.phrases").alias("p")).select("row", "p.phrase", F.col("p.at").alias("phrase_at"))
    notices = (
        voted.join(F.broadcast(rules(spark)), "template")
        .withColumn("phrase_at", F.col("shift") + F.col("phrase_place"))
        .join(phrases, ["row", "phrase", "phrase_at"], "left_semi")
        .groupBy("row")
        .agg(F.collect_set("label").alias("found"), F.max("share").alias("score"))
    )
    places = F.coalesce("seen.base", F.array().cast("array<struct<at:int,label:string>>"))
    labelled = F.array_distinct(F.transform(places, lambda x: x["label"]))
    at = F.transform(places, lambda x: x["at"].cast("long"))
    return (
        scanned.join(notices, "row", "left")
        .select(
            F.col("key").alias(key),
            "n_words",
            F.size(places).cast("long").alias("n_base"),
            F.array_min(at).alias("first_word"),
            F.array_max(at).alias("last_word"),
            F.array_join(F.array_sort(labelled), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_union(labelled, F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
            F.round(F.least(F.coalesce("score", F.lit(0.0)), F.lit(1.0)), 6).alias("score"),
        )
    )
