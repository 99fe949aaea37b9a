from pyspark.sql import functions as F

from corpuscle.operators import corpus as C
from corpuscle.operators import lexical
from corpuscle.operators import sentences as S
from corpuscle.sources import readers

#: ``vs.`` nearly always has its period; other words end sentences now and then, and stand elsewhere, too.
TEXTS = ["We test graphs vs. trees here. The result is good! Is it? Graphs vs. trees were tried."] * 40 + [
    "Dogs run. We like cats vs. The others say no. Done", "It ends with vs.", "Wait... More came. but... no", "", None, "   ", "(One.) Two.", "one. two",
] + ["here we tried no one two and came to run with trees"] * 10


def cut(spark, texts):
    out = {}
    for r in S.sentences(readers.corpus_of(spark, texts)).orderBy("doc_id", "sentence").collect():
        out.setdefault(r["doc_id"], []).append(r["text"])
        assert len(r["text"].split(" ")) == r["n_words"]
    return out


def test_boundaries(spark):
    got = cut(spark, TEXTS)
    assert got[3] == ["We test graphs vs. trees here.", "The result is good!", "Is it?", "Graphs vs. trees were tried."]
    assert got[40] == ["Dogs run.", "We like cats vs.", "The others say no.", "Done"]  # a capital that starts sentences
    assert got[41] == ["It ends with vs."]
    assert got[42] == ["Wait...", "More came.", "but... no"]
    assert 43 not in got and 44 not in got and 45 not in got
    assert got[46] == ["(One.)", "Two."] and got[47] == ["one.", "two"]


def test_statistics(spark):
    rows = S.marked(S.words(readers.corpus_of(spark, TEXTS)))
    assert {r["type"] for r in S.abbreviations(rows).collect()} == {"vs"}
    assert S.abbreviations(rows.where("false")).collect() == []
    assert S.sentences(readers.corpus_of(spark, [])).collect() == []


def test_tokens_of_a_final_abbreviation(spark):
    """The period that ends a sentence and that of an abbreviation leave the same term."""
    docs = readers.corpus_of(spark, ["We tried Corp. Models and Corp."])
    assert [r["term"] for r in lexical.tokens_long(docs).orderBy("pos").collect()] == ["tried", "corp", "models", "corp"]


def test_file_order(spark, tmp_path):
    """The first of repeated texts is that which stands first in the files, whatever its id."""
    head = "arxiv_id,abstract,start_idx,end_idx,label\n"
    (tmp_path / "a.csv").write_text(head + '9,"two\nlines",0,1,x\n8,same,0,1,x\n7,same,0,1,x\n')
    (tmp_path / "b.csv").write_text(head + "1,same,0,1,x\n2,other,0,1,x\n0,other,0,1,x\n")
    rows = readers.in_file_order(readers.read_annotations(spark, str(tmp_path)))
    kept = C.dedup_first(rows, "abstract", "place").orderBy("place")
    assert [(r["arxiv_id"], r["abstract"]) for r in kept.collect()] == [("9", "two\nlines"), ("8", "same"), ("2", "other")]


def test_dedup_plan_has_no_sort_of_texts(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 700).cast("string").alias("text"))
    kept = C.dedup_first(docs)
    assert kept.count() == 700 and kept.agg(F.max("doc_id")).first()[0] == 699
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Exchange hash" not in plan
    same = C.dedup_first(docs.unionAll(docs))
    assert sorted(r["doc_id"] for r in same.collect()) == list(range(700))
    nulls = spark.createDataFrame([(None, "a"), (5, "a"), (None, "b"), (None, "b"), (3, None)], "doc_id long, text string")
    assert sorted(map(repr, map(tuple, C.dedup_first(nulls).collect()))) == ["(5, 'a')", "(None, 'b')"]


def test_words_without_a_mark_are_told_by_their_number(spark):
    """Rows of a word each were most of the work; each batch now tells types of such words once."""
    rows = S.marked(S.words(readers.corpus_of(spark, ["we ran. we ran! We", "we", None, ""]).coalesce(1))).collect()
    ends = [(r["doc_id"], r["i"], r["type"], r["lower"], r["mark"], r["next"], r["upper"], r["n"]) for r in rows if r["mark"]]
    assert ends == [(0, 1, "ran", True, ".", "we", False, 1), (0, 3, "ran", True, "!", "we", True, 1)]
    assert sorted((r["type"], r["lower"], r["n"]) for r in rows if not r["mark"]) == [("we", False, 1), ("we", True, 3)]
    assert {r["type"]: tuple(r)[1:] for r in S.types(S.marked(S.words(readers.corpus_of(spark, ["We ran. we ran"])))).collect()} == {"we": (2, 0, True), "ran": (2, 1, True)}
