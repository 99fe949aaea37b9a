import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuscle.functions import tagging as G
from corpuscle.operators import dense, lexical, tagging
from corpuscle.plans.engine import Options, SearchEngine
from corpuscle.sources.readers import corpus_of

WORDS = ["left", "node", "training", "models", "improve", "early", "fast", "fed", "tests", "largest", "quickly", "nation", "runner", "process", "children", "was"]


def classes(word):
    import re

    return G.WORDS.get(word) or next(code for code, pattern, _ in G.ENDINGS if re.search(pattern, word))


def cheapest(tagger, words):
    """By trying every sequence of tags."""
    follows, emits = dict(tagger.follows), {c: dict(own) for c, own in tagger.emits}
    best = None
    for tags in itertools.product(*[sorted(emits[classes(w)]) for w in words]):
        cost, before = 0, "^"
        for w, t in zip(words, tags):
            cost += follows[before][G.LETTERS.index(t)] + emits[classes(w)][t]
            before = t
        best = min(best or (cost, tags), (cost, tags))
    return [G.TAGS[t] for t in best[1]] if words else []


def test_cheapest_sequences(spark):
    rng = np.random.default_rng(1)
    rows = [[str(w) for w in rng.choice(WORDS, n)] for n in [0, 1, 1, 2, 3, 4, 5, 6, 7, 7, 7, 8]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, w array<string>")
    odd = G.Tagger.of(*[{k: {t: 1.0 + ((ord(k) * 7 + ord(t)) % 11) for t in own} for k, own in part.items()} for part in G.seed_weights()])
    for tagger in (G.SEED, odd):
        got = [r[0] for r in df.orderBy("i").select(tagger(F.col("w"))).collect()]
        assert got == [cheapest(tagger, r) for r in rows]


def test_context_decides(spark):
    df = spark.createDataFrame([(["left", "node", "left", "early"],), (["training", "models"],), (["fast", "training"],)], "w array<string>")
    got = [r[0] for r in df.select(G.SEED(F.col("w"))).collect()]
    assert got[0][0] == "JJ" and got[0][2] == "VBD"
    assert len({t for row, words in zip(got, [["left", "node", "left", "early"], ["training", "models"], ["fast", "training"]]) for w, t in zip(words, row) if w == "left"}) == 2


def test_long_sequences_are_cut(spark):
    """Fifty thousand words: pieces end at sure words, so no fold is long."""
    words = (["fast", "training", "nation"] * 17_000)[:50_000]
    df = spark.createDataFrame([(words,)], "w array<string>")
    got = df.select(G.SEED(F.col("w")).alias("t"), F.array_max(F.transform(G.pieces(F.col("w")), F.length)).alias("most")).first()
    assert len(got["t"]) == 50_000 and got["most"] == 4
    assert got["t"][:3] == cheapest(G.SEED, words[:3])


def test_states_are_met_again():
    """Words without a sure one among them: a word costs a look into a table, however long the sequence."""
    rng = np.random.default_rng(2)
    unsure = [w for w in WORDS if classes(w) not in G.SURE]
    rows = [[str(w) for w in rng.choice(unsure, n)] for n in [5, 6, 0, 40_000]]
    got = G.SEED.tags(pa.array([*rows, None, ["tests", None]], pa.list_(pa.string()))).to_pylist()
    assert got[:2] == [cheapest(G.SEED, r) for r in rows[:2]] and got[2] == [] and len(got[3]) == 40_000
    assert got[4] is None and got[5] == cheapest(G.SEED, ["tests", "node"])
    assert len(G._start(G.SEED).known) < 2_000


def test_expectations_against_all_paths():
    """Forward and backward sums are those over every sequence of tags."""
    follows, emits, names = tagging._arrays(G.seed_weights())
    codes = np.array([[names.index(c) for c in "OFNb"], [names.index(c) for c in "GODA"]])
    before, n = np.array([0, 3]), np.array([2.0, 5.0])
    moves, said, total = tagging.expected(follows, emits, codes, before, n)
    want_m, want_s, want = np.zeros_like(follows), np.zeros_like(emits), 0.0
    for row, b, times in zip(codes, before, n):
        paths = []
        for tags in itertools.product(range(len(G.LETTERS)), repeat=4):
            p, at = 1.0, b
            for c, t in zip(row, tags):
                p *= follows[at, t] * emits[t, c]
                at = 1 + t
            paths.append((p, tags))
        whole = sum(p for p, _ in paths)
        want += times * np.log(whole)
        for p, tags in paths:
            at = b
            for c, t in zip(row, tags):
                want_m[at, t] += times * p / whole
                want_s[t, c] += times * p / whole
                at = 1 + t
    assert np.allclose(moves, want_m) and np.allclose(said, want_s) and total == pytest.approx(want)


TEXTS = ["The trained network quickly finds the left node.", "Networks left early; training improves translation.", "Large networks improve fast training tests.", "Children found the largest nation."]


def test_fit_raises_the_likelihood_and_any_partition_fits_alike(spark):
    docs = corpus_of(spark, TEXTS * 5)
    tagger, seen = tagging.fit_tagger(docs, rounds=4)
    assert len(seen) == 4 and seen == sorted(seen) and seen[-1] > seen[0]
    assert tagging.fit_tagger(docs.repartition(7), rounds=4)[0] == tagger
    assert tagging.fit_tagger(docs.where("false")) == (G.SEED, [])
    counts = {r["piece"]: r["n"] for r in tagging.piece_counts(docs).collect()}
    assert all(n % 5 == 0 for n in counts.values())


def test_lemmas_in_context(spark):
    rows = [(0, 0, "left", "JJ"), (0, 1, "left", "VBD"), (0, 2, "training", "NN"), (0, 3, "training", "VBG"), (0, 4, "children", "NNS"), (0, 5, "train", "VB"), (0, 6, "better", "RB"), (0, 7, "better", "JJ")]
    got = lexical.lemmas(spark.createDataFrame(rows, "doc_id long, pos int, term string, tag string"))
    assert got.columns == ["doc_id", "pos", "term"]
    assert [r["term"] for r in got.orderBy("pos").collect()] == ["left", "leave", "training", "train", "child", "train", "well", "good"]


def test_search_by_lemmas_in_context(spark):
    """Queries are tagged and lemmatised as the corpus is, with n-grams, too."""
    docs = corpus_of(spark, TEXTS)
    for grams in ((1, 1), (1, 2)):
        index = lexical.fit(docs, lemmatise=True, tag=G.SEED, ngram_range=grams)
        q = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "query_id long, query string")
        best = {r["query_id"]: (r["doc_id"], r["score"]) for r in lexical.search(index, q, 1).collect()}
        assert best == {i: (i, 1.0) for i in range(len(TEXTS))}
    terms = {r["term"] for r in index.terms.collect()}
    assert "child" in terms and "children" not in terms


@pytest.mark.parametrize("tag", [None, G.SEED])
def test_one_preprocess_for_all_arms(spark, tmp_path, tag):
    docs = corpus_of(spark, ["graph graphs", "speech"])
    words = spark.createDataFrame([("graph", [1.0, 0.0]), ("speech", [0.0, 1.0])], "word string, vector array<float>")
    engine = SearchEngine(docs, str(tmp_path), Options(lemmatise=True, tag=tag), word_vectors=words)
    found = {m["key"]: m["results"][0] for m in engine.search("graphs", 1)["methods"]}
    assert {k: (r["doc_id"], r["score"]) for k, r in found.items()} == {"tfidf": (0, 1.0), "word2vec": (0, 1.0)}


def test_own_tokeniser_in_all_arms(spark, tmp_path):
    docs = corpus_of(spark, ["a-b", "c-d"])
    words = spark.createDataFrame([("A-B", [1.0, 0.0]), ("C-D", [0.0, 1.0])], "word string, vector array<float>")
    options = Options(tokenise=_upper_words, stop_words=[])
    engine = SearchEngine(docs, str(tmp_path), options, word_vectors=words)
    assert [m["results"][0]["doc_id"] for m in engine.search("c-d", 1)["methods"]] == [1, 1]


def _upper_words(text):
    return F.split(F.upper(text), " ")


def test_mean_vectors_of_a_large_vocabulary(spark, monkeypatch):
    docs = corpus_of(spark, ["graph graph speech", "unknown words", None])
    vectors = spark.createDataFrame([("graph", [3.0, 0.0]), ("speech", [0.0, 3.0])], "word string, vector array<float>")
    monkeypatch.setattr(dense, "BROADCAST_NUMBERS", 0)
    got = {r["doc_id"]: r["vector"] for r in dense.mean_vectors(lexical.tokens_long(docs), vectors, docs, 2).collect()}
    assert got == {0: [2.0, 1.0], 1: [0.0, 0.0], 2: [0.0, 0.0]}


def test_packed_means_are_those_of_counts(spark, monkeypatch):
    """In one part, in several, and beyond PARTS: the same means; no row a count is made."""
    docs = corpus_of(spark, ["graph node graph", "edge node unknown", "", "unknown", "node edge graph tree leaf"])
    vectors = spark.createDataFrame([(w, [float(i), i * i / 4]) for i, w in enumerate(["graph", "node", "edge", "tree", "leaf"])], "word string, vector array<float>")
    own = lexical.counted(docs)[0]
    counts = lexical.unpacked(own)
    want = {r["doc_id"]: r["vector"] for r in dense.mean_vectors(counts, vectors, counts.select("doc_id").distinct(), 2).collect()}
    monkeypatch.setattr(dense, "GATHERED", 2)
    for numbers, parts in ((100, 16), (4, 16), (4, 1)):
        monkeypatch.setattr(dense, "BROADCAST_NUMBERS", numbers)
        monkeypatch.setattr(dense, "PARTS", parts)
        assert {r["doc_id"]: r["vector"] for r in dense.packed_means(own, vectors, 2).collect()} == want


@pytest.mark.parametrize("tag", [None, G.SEED])
def test_forms_by_hash_are_those_of_the_join(spark, monkeypatch, tag):
    """More forms than WIDE_ROWS are told by hash and rule; beyond FORM_ROWS, or where hashes meet, terms are joined."""
    docs = corpus_of(spark, [*TEXTS, "Tested tests test; children and a child, studies study.", ""])
    monkeypatch.setattr(lexical, "WIDE_ROWS", 1)

    def rows():
        own, *_ = lexical.counted(docs, lemmatise=True, tag=tag)
        return sorted((r["doc_id"], sorted(map(tuple, r["own"]))) for r in own.collect())

    got, joined = rows(), []
    with monkeypatch.context() as m:
        m.setattr(lexical, "lemma_grams", lambda tokens, n: joined.append(1) or tokens)
        assert rows() == got and not joined
        m.setattr(lexical, "FORM_ROWS", 0)
        assert rows() == got and joined
        m.setattr(lexical, "FORM_ROWS", 100)
        m.setattr(lexical, "hashes_apart", lambda v: False)
        assert rows() == got and len(joined) == 2
    assert not lexical.hashes_apart(spark.createDataFrame([("a",), ("a",)], "term string"))
