"""Text as columns: cleaning, tokens, n-grams, snippets. One builder serves corpus and queries alike."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from corpuscle.session import ship

from .stopwords import ENGLISH

TAG = r"<[^>]+>"
URL = r"http\S+|www\.\S+"
BLANKS = r"[\s\p{Z}]+"
#: Marks that a tokenizer sets apart from the word beside them.
APART = r"""[;@#$%&?!()\[\]{}<>"“”‘’«»…]|[.]{3}|--"""
#: A comma or colon parts words, but not digits.
COMMA = r"[:,]([^0-9])"
#: Clitics split off a word; alone they are too short to be terms.
CLITIC = r"(n't|'(s|re|ve|ll|d|m))[.]*"
#: The 32 ASCII punctuation characters.
PUNCTUATION = r"[!-/:-@\[-`{-~]"
MIN_LENGTH = 3
#: A word of letters only, long enough to be a term.
WORD = rf"^\p{{L}}{{{MIN_LENGTH},}}$"
#: The characters of BLANKS.
SPACES = " \t\n\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SNIPPET = 300
ABSTRACT_URL = "https://arxiv.org/abs/"

#: Suffix rules (suffix, replacement) of inflected English nouns, verbs and adjectives, in the order they are tried.
LEMMA_RULES = [
    ("ies", "y"), ("ses", "s"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"),
    ("ing", ""), ("ing", "e"), ("ed", ""), ("ed", "e"), ("es", ""), ("es", "e"), ("s", ""),
    ("est", ""), ("est", "e"), ("er", ""), ("er", "e"),
]
#: The parts of speech (n, v, a, r) that a suffix inflects, where these are not nouns and verbs alike.
LEMMA_POS = {"ing": "v", "ed": "v", "men": "n", "est": "a", "er": "a"}


def strip_html(text: Column) -> Column:
    return F.regexp_replace(text, TAG, " ")


def strip_urls(text: Column) -> Column:
    """Case-sensitive: to be used before lower-casing."""
    return F.regexp_replace(text, URL, " ")


def collapse(text: Column) -> Column:
    """Runs of white space, Unicode's included, become one space; none is left at the ends."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def clean_basic(text: Column) -> Column:
    """For sentence encoders: without tags, case kept."""
    return collapse(strip_html(text))


def clean_lexical(text: Column) -> Column:
    """For the lexical arms: without tags and URLs, in lower case."""
    plain = F.when(text.contains("<"), strip_html(text)).otherwise(text)  # a search for a word is faster than a pattern
    return F.lower(collapse(F.when(text.contains("http") | text.contains("www."), strip_urls(plain)).otherwise(plain)))


def tokens(text: Column, stop_words: list[str] | None = None) -> Column:
    """Content words in order, repeats kept: letters only, three at least, no stop words. Null text: none."""

    def found(texts: pa.Array) -> pa.Array:
        return content_words(texts, stop_words)

    if spark := SparkSession.getActiveSession():
        ship(spark)
    return F.arrow_udf(found, "array<string>")(text)


def content_words(texts: pa.Array, stop_words: list[str] | None = None) -> pa.Array:
    """``tokens`` of a batch. Marks are set apart in whole texts; what lies between blanks is looked at once a distinct word."""
    plain = pc.replace_substring_regex(pc.replace_substring_regex(pc.fill_null(texts, ""), TAG, " "), URL, " ")
    apart = pc.replace_substring_regex(pc.utf8_rtrim(plain, SPACES), f"{APART}|[{SPACES[1:]}]", " ")
    lists = pc.split_pattern(pc.replace_substring_regex(apart, COMMA, r" \1"), " ")
    coded = lists.flatten().dictionary_encode()
    bare = pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), CLITIC + "$", "", max_replacements=1)
    bare = pc.replace_substring_regex(bare, PUNCTUATION, "")
    stop = pa.array(ENGLISH if stop_words is None else stop_words, pa.string())
    terms = pc.if_else(pc.and_not(pc.match_substring_regex(bare, WORD), pc.is_in(bare, value_set=stop)), bare, None)
    found = terms.take(coded.indices)
    before = np.append(0, np.cumsum(found.is_valid().to_numpy(zero_copy_only=False)))
    ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
    return pa.ListArray.from_arrays(pa.array(before[ends], pa.int32()), found.drop_null())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, even where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def ngrams(terms: Column, low: int = 1, high: int = 1) -> Column:
    """Space-joined n-grams of ``low`` to ``high`` terms, shorter ones first."""

    def of(words: Column, n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))

    return terms if (low, high) == (1, 1) else let(terms, lambda w: F.concat(*[of(w, n) for n in range(low, high + 1)]))


def word_count(text: Column) -> Column:
    """Words parted by white space."""
    return F.size(F.filter(F.split(text, BLANKS), lambda w: w != ""))


def strip(text: Column) -> Column:
    """Without white space, Unicode's included, at the ends."""
    return F.regexp_replace(text, rf"^{BLANKS}|{BLANKS}$", "")


def snippet(text: Column) -> Column:
    """The first 300 characters on one line, with ``...`` if the text is longer."""
    start = strip(F.translate(F.substring(text, 1, SNIPPET), "\n", " "))
    return F.concat(start, F.when(F.length(text) > SNIPPET, "...").otherwise(""))


def snippet_cli(text: Column) -> Column:
    """The console's form: not stripped, always with ``...``."""
    return F.concat(F.translate(F.substring(text, 1, SNIPPET), "\n", " "), F.lit("..."))


def is_cut(text: Column, shown: Column) -> Column:
    """Whether there is more to read than the snippet shows."""
    return F.length(text) > F.length(shown)


def result_url(paper_id: Column) -> Column:
    return F.concat(F.lit(ABSTRACT_URL), paper_id.cast("string"))


def wordnet_pos(tag: Column) -> Column:
    """Penn tag to part of speech: J a, V v, R r, else n."""
    return F.when(tag.startswith("J"), "a").when(tag.startswith("V"), "v").when(tag.startswith("R"), "r").otherwise("n")


def penn_tag(word: Column) -> Column:
    """A word's Penn tag by its ending, where no tagger is at hand: adverbs, participles, adjectives, plurals, else NN."""
    return (
        F.when(word.rlike("...ly$"), "RB")
        .when(word.rlike("...ing$"), "VBG")
        .when(word.rlike("...ed$"), "VBD")
        .when(word.rlike("...(ous|ful|less|able|ible|ical|ive|est)$"), "JJ")
        .when(word.rlike("..[^su]s$"), "NNS")
        .otherwise("NN")
    )


def thousands(n: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(n, 0)


def plural(n: Column, noun: str) -> Column:
    """``1 paper``, ``2,538 papers``."""
    return F.concat(thousands(n), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def badge(text: Column) -> Column:
    """In upper case, as labels of a device are shown."""
    return F.upper(text)


def score_text(score: Column) -> Column:
    """The console's four decimals."""
    return F.format_string("%.4f", score)


def percent(score: Column) -> Column:
    return F.format_string("%.1f%%", score * 100)


def bar_width(score: Column) -> Column:
    """A percentage clamped to 0..100; the signed score stays beside it."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score * 100))
