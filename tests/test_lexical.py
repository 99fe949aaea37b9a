import math

import pytest
from pyspark.sql import functions as F

from corpuscle.functions import text as X
from corpuscle.operators import lexical
from corpuscle.plans.engine import Options, SearchEngine
from corpuscle.sources.readers import corpus_of

MICRO = ["graph neural network graph", "neural translation speech", "speech translation network network"]


@pytest.fixture(scope="module")
def index(spark):
    return lexical.fit(corpus_of(spark, MICRO))


def found(spark, index, text, k):
    rows = lexical.search(index, spark.createDataFrame([(0, text)], "query_id long, query string"), k).orderBy("rank").collect()
    return [(r["doc_id"], r["score"]) for r in rows]


def test_idf(index):
    idf = {r["term"]: r["idf"] for r in index.terms.collect()}
    assert idf["graph"] == pytest.approx(1.693147, abs=1e-6)
    assert idf["speech"] == pytest.approx(1.287682, abs=1e-6)


def test_weights(index):
    w = index.weights.join(index.norms, "doc_id").select("doc_id", "term", (F.col("w") / F.col("norm")).alias("w")).collect()
    got = {(r["doc_id"], r["term"]): r["w"] for r in w}
    assert got[0, "graph"] == pytest.approx(0.844093, abs=1e-6)
    assert got[2, "network"] == pytest.approx(0.767495, abs=1e-6)
    assert sum(x * x for (d, _), x in got.items() if d == 0) == pytest.approx(1)


def test_search(spark, index):
    assert found(spark, index, "speech graph", 3) == [(0, 0.671865), (1, 0.349498), (2, 0.274401)]
    assert found(spark, index, "quantum", 2) == [(0, 0.0), (1, 0.0)]
    assert len(found(spark, index, "speech", 20)) == 3
    assert found(spark, index, MICRO[1], 1) == [(1, 1.0)]


def test_single_document(spark):
    alone = lexical.fit(corpus_of(spark, ["one lonely document"]))
    assert {r["idf"] for r in alone.terms.collect()} == {1.0}


def test_options(spark):
    docs = corpus_of(spark, MICRO)
    raw = lexical.fit(docs, sublinear=False)
    row = raw.weights.where("doc_id = 0 and term = 'graph'").first()
    assert row["w"] == pytest.approx(2 * (math.log(4 / 2) + 1))
    top = lexical.fit(docs, max_features=2)
    assert {r["term"] for r in top.terms.collect()} == {"network", "graph"}
    grams = lexical.fit(docs, ngram_range=(1, 2))
    assert grams.terms.where("term = 'neural network'").count() == 1
    both = lexical.fit(corpus_of(spark, ["networks network", "network trained training train"]), lemmatise=True)
    assert {r["term"] for r in both.terms.collect()} == {"network", "train"}


def test_empty(spark):
    nothing = lexical.fit(corpus_of(spark, [None, "", "the of"]))
    assert nothing.terms.count() == 0
    assert found(spark, nothing, "word", 2) == [(0, 0.0), (1, 0.0)]


def test_search_with_inflected_words(spark, tmp_path):
    texts = ["networks network", "speech translation", "trained train networks"]
    for grams in ((1, 1), (1, 2)):
        both = lexical.fit(corpus_of(spark, texts), lemmatise=True, ngram_range=grams)
        assert found(spark, both, "networks", 3) == found(spark, both, "network", 3)
        assert found(spark, both, "networks", 1)[0][1] > 0
        assert found(spark, both, "trained networks", 1) == [(2, found(spark, both, "train network", 1)[0][1])]
    unseen = lexical.fit(corpus_of(spark, ["network", "speech"]), lemmatise=True)
    assert found(spark, unseen, "networks", 1) == [(0, 1.0)]
    engine = SearchEngine(corpus_of(spark, texts), str(tmp_path), Options(lemmatise=True), word_vectors=spark.createDataFrame([("network", [1.0])], "word string, vector array<float>"))
    assert found(spark, engine.index, "networks", 1) == found(spark, engine.index, "network", 1)


def test_own_tokeniser_and_stop_words(spark):
    """The same for corpus and queries."""
    docs = corpus_of(spark, ["a-b c-d", "c-d e"])
    own = lexical.fit(docs, tokenise=lambda t: F.split(F.upper(t), " "))
    assert {r["term"] for r in own.terms.collect()} == {"A-B", "C-D", "E"}
    assert found(spark, own, "e", 1)[0][0] == 1 and found(spark, own, "a b", 1) == [(0, 0.0)]
    stopped = lexical.fit(corpus_of(spark, MICRO), stop_words=["graph"])
    assert "graph" not in {r["term"] for r in stopped.terms.collect()} and found(spark, stopped, "graph", 1) == [(0, 0.0)]


def test_counts_are_used_again(spark, index):
    again = lexical.fit(corpus_of(spark, MICRO), sublinear=False, counts=index.counts)
    new = lexical.fit(corpus_of(spark, MICRO), sublinear=False)
    assert sorted(map(tuple, again.weights.collect())) == sorted(map(tuple, new.weights.collect()))


def test_dense_rows(spark, index, monkeypatch):
    rows = {r["doc_id"]: r["vector"] for r in lexical.dense_rows(index).collect()}
    terms = sorted(r["term"] for r in index.terms.collect())
    long = {(r["doc_id"], r["term"]): r["w"] for r in index.weights.collect()}
    assert rows == {d: [long.get((d, t), 0.0) for t in terms] for d in range(3)}
    monkeypatch.setattr(lexical, "DENSE_TERMS", 2)
    with pytest.raises(ValueError):
        lexical.dense_rows(index)


def test_lemmas_by_part_of_speech(spark):
    words = spark.createDataFrame([(w,) for w in "training train trains quickly quick studies study best be".split()], "term string")
    assert sorted(r["term"] for r in lexical.lemmas(words, tag=X.penn_tag).collect()) == sorted("train train train quickly quick study study best be".split())
    nouns = lexical.lemmas(words, tag=lambda w: F.lit("NN"))
    assert "training" in {r["term"] for r in nouns.collect()}  # a noun loses no -ing


def test_formats(spark):
    row = spark.range(1).select(X.thousands(F.lit(2538)), X.plural(F.lit(1), "paper"), X.plural(F.lit(2538), "paper"), X.badge(F.lit("cpu"))).first()
    assert tuple(row) == ("2,538", "1 paper", "2,538 papers", "CPU")
