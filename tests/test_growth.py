"""Steps whose cost grew faster than the input: what they move, and that their results stay."""

import hashlib

from corpuscle.operators import corpus as C
from corpuscle.operators import embed, lexical, negatives
from corpuscle.plans import registry

TEXTS = ["red fox red fox red", "red dog fox dog", "fox", "dog red red"]


def said(spark):
    return spark.createDataFrame([(i, p, w) for i, t in enumerate(TEXTS) for p, w in enumerate(t.split())], "doc_id long, pos int, term string")


def test_pair_counts_are_those_of_all_pairs(spark):
    toks = said(spark)
    want = {(r[0], r[1]): r[2] for r in embed.skipgram_pairs(toks, 2).groupBy("center", "context").count().collect()}
    assert {(r["center"], r["context"]): r["cnt"] for r in embed.pair_counts(toks, 2).collect()} == want


def test_draw_counts_are_those_of_draws(spark, monkeypatch):
    toks = said(spark)
    pairs, table = embed.skipgram_pairs(toks), negatives.alias_table(lexical.vocabulary(toks, 2))
    want = {r[0]: r[1] for r in negatives.draws(pairs, table, 2).groupBy("drawn").count().collect()}
    for rows in (negatives.BROADCAST_ROWS, 1):
        monkeypatch.setattr(negatives, "BROADCAST_ROWS", rows)
        assert {r["term"]: r["cnt"] for r in negatives.draw_counts(pairs, table, 2).collect()} == want


def test_fingerprint_brings_no_text_to_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(3, "cé"), (1, "a"), (2, None), (0, "z" * 5000)], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "toLocalIterator", None)
    assert C.fingerprint(docs) == hashlib.sha1(("z" * 5000 + "a" + "cé").encode()).hexdigest()[:16]


def test_normalised_weights_read_the_counts_once_for_weights_and_once_for_terms(spark):
    index = lexical.fit(spark.createDataFrame(list(enumerate(["red fox dog", "fox fox owl", "owl"])), "doc_id long, text string"))
    top = lexical.doc_top_terms(index, 1)
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2
    want = {(r["doc_id"], r["term"]): round(r["w"] / r["norm"], 6) for r in index.weights.join(index.norms, "doc_id").collect()}
    assert {(r["doc_id"], r["term"]): r["weight"] for r in lexical.normalised(index).collect()} == want


DOCS = ["red fox dog foxes", "fox fox owl running", "owl run", "", "red red owl hen"]


def ranked(spark, index, k=3):
    q = spark.createDataFrame([(0, "foxes owl"), (1, "red"), (2, "nothing")], "query_id long, query string")
    return sorted(map(tuple, lexical.search(index, q, k).select("query_id", "doc_id", "score", "rank").collect()))


def test_search_shuffles_no_pair_but_the_best(spark, monkeypatch):
    """Packed rows, a vocabulary that is broadcast in part, and products grouped by shuffle give the same."""
    docs = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string").coalesce(1)  # one task
    for how in ({}, {"ngram_range": (1, 2)}, {"lemmatise": True}, {"sublinear": False}):
        index = lexical.fit(docs, **how)
        asked = spark.createDataFrame([(i, "red owl") for i in range(2)], "query_id long, query string")
        assert index.packed.count() == 5 and lexical.best(index, asked, 1).count() < lexical.score(index, asked).count()
        want = ranked(spark, index)
        for name, value in (("MATRIX", 0), ("PRODUCT", 1), ("WIDE_ROWS", 1)):
            with monkeypatch.context() as m:
                m.setattr(lexical, name, value)
                assert ranked(spark, lexical.fit(docs, **how)) == want


def test_texts_of_one_id_are_counted_together(spark):
    docs = spark.createDataFrame([(1, "red fox"), (1, "red owl"), (2, "")], "doc_id long, text string")
    index = lexical.fit(docs)
    assert sorted(map(tuple, index.counts.collect())) == [(1, "fox", 1), (1, "owl", 1), (1, "red", 2)] and index.n_docs == 3


def test_reweighted_index_is_that_of_a_new_fit(spark):
    docs = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string")
    again = lexical.reweighted(lexical.fit(docs), False)
    assert ranked(spark, again) == ranked(spark, lexical.fit(docs, sublinear=False))


def test_lemma_frequency_is_that_of_the_lemmas(spark):
    toks = lexical.tokens_long(spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string"))
    want = sorted(map(tuple, lexical.term_frequency(lexical.lemmas(toks)).collect()))
    assert sorted(map(tuple, lexical.lemma_frequency(toks).collect())) == want and ("fox", 4) in want


def test_hits_do_not_shuffle_texts(spark):
    """The ranked rows are a table of known size, so they go to the documents."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200k")
    try:
        for made in (registry.search_hits, registry.response_json):
            plan = made(spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_norms_are_taken_where_documents_lie(spark, monkeypatch):
    """Terms of one document are not told, and weights are not grouped again for norms, but where terms are too many."""
    docs = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string")
    for how in ({}, {"max_features": 3}, {"lemmatise": True}, {"sublinear": False}, {"ngram_range": (1, 2)}):
        index = lexical.fit(docs, **how)
        hashes, _, other = lexical._told_weights(index).value
        assert len(hashes) == (3 if "max_features" in how else index.terms.where("df > 1").count()) and (other > 0) == ("max_features" not in how)
        want = ranked(spark, index, 9)
        index.norms = None
        assert ranked(spark, index, 9) == want
        with monkeypatch.context() as m:
            m.setattr(lexical, "TOLD_ROWS", 0)
            assert ranked(spark, lexical.fit(docs, **how), 9) == want


def test_a_plain_corpus_is_cut_where_it_is_counted(spark, monkeypatch):
    monkeypatch.setattr(lexical, "cut", None)
    index = lexical.fit(spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string"), stop_words=["owl"])
    assert index.terms.where("term = 'owl'").isEmpty() and index.terms.where("term = 'fox'").first()["df"] == 2


def test_words_are_counted_where_texts_are_cut(spark, monkeypatch):
    docs = spark.createDataFrame([*enumerate(DOCS), (9, None)], "doc_id long, text string")
    want = sorted(map(tuple, lexical.term_frequency(lexical.tokens_long(docs)).collect()))
    for held in (lexical.HELD_TERMS, 3):
        monkeypatch.setattr(lexical, "HELD_TERMS", held)
        assert sorted(map(tuple, lexical.text_frequency(docs).collect())) == want
    lemma = lambda t: sorted(map(tuple, lexical.lemma_frequency(t).collect()))
    assert lemma(lexical.text_frequency(docs)) == lemma(lexical.tokens_long(docs))


def test_lemmas_are_looked_up_once_a_document(spark, monkeypatch):
    """Counts of words are made into those of their lemmas, where these are few enough to be told and where not."""
    docs = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string").coalesce(1)
    want = sorted(map(tuple, lexical.doc_term_counts(lexical.lemmas(lexical.tokens_long(docs))).collect()))
    monkeypatch.setattr(lexical, "cut", None)
    for rows in (lexical.FORM_ROWS, 0):
        monkeypatch.setattr(lexical, "FORM_ROWS", rows)
        own, _, n, _ = lexical.counted(docs, lemmatise=True)
        assert sorted(map(tuple, lexical.unpacked(own).collect())) == want and n == 5 and own.count() == 5
