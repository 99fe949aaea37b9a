import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuscle.functions import text as X
from corpuscle.plans import registry


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, []),
        ("", []),
        ("   ", []),
        ("state-of-the-art", ["stateoftheart"]),
        ("2021 3d et al e", []),
        ("don't", []),
        ("I can't. They've gone", ["gone"]),
        ("café naïve", ["café", "naïve"]),
        ("the and of with", []),
        ("Neural networks, neural (nets): fast!", ["neural", "networks", "neural", "nets", "fast"]),
        ("<br>Neural</p>  networks", ["neural", "networks"]),
        ("see http://x.y/z and www.q.r today", ["see", "today"]),
        ("“quoted” words…here", ["quoted", "words"]),
        ("a nonbreaking space", ["nonbreaking", "space"]),
    ],
)
def test_tokens(spark, text, want):
    assert one(spark, X.tokens, text) == want


def test_clean(spark):
    assert one(spark, X.clean_basic, "<br>Neural</p>  Networks  see http://x.y ") == "Neural Networks see http://x.y"
    assert one(spark, X.clean_lexical, "HTTP://X.Y stays, http://x.y goes") == "http://x.y stays, goes"


@pytest.mark.parametrize("n", [300, 301, 303, 304])
def test_snippet(spark, n):
    text = "a" * n
    shown = one(spark, X.snippet, text)
    assert shown.endswith("...") == (n > 300)
    assert one(spark, lambda c: X.is_cut(c, X.snippet(c)), text) == (n > 303)
    assert one(spark, X.snippet_cli, "x\ny") == "x y..."
    assert one(spark, X.snippet, "\n  x\ny \t") == "x y"


def test_ngrams(spark):
    grams = lambda low, high: one(spark, lambda c: X.ngrams(F.split(c, " "), low, high), "a b c")
    assert grams(1, 1) == ["a", "b", "c"]
    assert grams(2, 2) == ["a b", "b c"]
    assert grams(1, 3) == ["a", "b", "c", "a b", "b c", "a b c"]
    assert grams(4, 4) == []


def test_scalars(spark):
    df = spark.createDataFrame([(-0.5, "JJ"), (0.876, "VBD"), (1.7, "RB"), (0.0, "NN")], "s double, tag string")
    rows = df.select(X.bar_width(F.col("s")), X.percent(F.col("s")), X.score_text(F.col("s")), X.wordnet_pos(F.col("tag"))).collect()
    assert [tuple(r) for r in rows] == [(0.0, "-50.0%", "-0.5000", "a"), (87.6, "87.6%", "0.8760", "v"), (100.0, "170.0%", "1.7000", "r"), (0.0, "0.0%", "0.0000", "n")]
    assert one(spark, X.word_count, " a b\n c ") == 3
    assert one(spark, X.result_url, "2301.12340") == "https://arxiv.org/abs/2301.12340"


#: Case, blanks and marks where engines differ, or where a step leaves what the next one sees.
ODD = [
    "ΟΔΟΣ ΣΟΦΟΣ İstanbul Kelvin", "two\x0bparts one\x85line", "they don't, ", "they don't,;", "we don't:\n\n5 things", "a,,bcd,,,efg :hij", "can't's isn't... dog's.. it''s",
    "\u3000wide\u2028line\u00a0end\u202f", "<b\n>bold<b> word < 5 > six", "www.x.y\u00a0z httpfoo HTTPbar", "x--y...zzz....abc [brackets]{braces}", "", " ", "İ", "dž Ǆabc ﬁne",
]


def test_tokens_are_those_of_sql(spark):
    want = [r[0] for r in duckdb.sql(f"SELECT {registry.sql_tokens('t')} FROM (SELECT unnest(?) AS t)", params=[ODD]).fetchall()]
    rows = spark.createDataFrame(list(enumerate(ODD)), "i int, t string").select("i", X.tokens(F.col("t")).alias("w"))
    assert [r["w"] for r in rows.orderBy("i").collect()] == want
    assert X.content_words(pa.array(["the one", None, "one two"]).slice(1), ["two"]).to_pylist() == [[], ["one"]]


def test_tokens_are_cut_a_batch_at_a_time(spark):
    """Patterns of the JVM took most of a search's task seconds."""
    plan = spark.createDataFrame([("a b",)], "t string").select(X.tokens(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and "ArrowEvalPython" in plan
