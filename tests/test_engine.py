import hashlib
import json
import sys
import threading
import types
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle import session
from corpuscle.operators import corpus as C
from corpuscle.operators import dense, embed, lexical
from corpuscle.operators import rank as R
from corpuscle.plans import service, validate
from corpuscle.plans.engine import Options, SearchEngine, repl
from corpuscle.sources import readers, sinks
from corpuscle.streaming import queries as S

TEXTS = ["graph neural network graph", "neural translation speech", "speech translation network network", "graph neural network graph", None]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    cache = str(tmp_path_factory.mktemp("cache"))
    return SearchEngine(readers.corpus_of(spark, TEXTS), cache, Options(vector_size=8, epochs=1), embed.HashingEncoder(16))


def test_search(engine):
    out = engine.search("  graph network ", 2)
    assert out["query"] == "graph network" and [m["key"] for m in out["methods"]] == ["tfidf", "word2vec", "bert"]
    assert [h["doc_id"] for h in out["methods"][0]["results"]] == [0, 2]
    assert all(len(m["results"]) == 2 for m in out["methods"])
    assert engine.status().first()["corpus_size"] == 3
    said = []
    answers = iter(["", "graph", "EXIT"])
    repl(engine, lambda _: next(answers), said.append)
    assert said[0] == "== TF-IDF ==" and said[1].startswith("1. [")


def test_cache_is_reused_and_mended(spark, engine):
    cache = engine.root.rsplit("/", 1)[0]
    again = SearchEngine(readers.corpus_of(spark, TEXTS), cache, engine.options, engine.encoder)
    assert again.root == engine.root
    other = SearchEngine(readers.corpus_of(spark, TEXTS), cache, Options(vector_size=8, epochs=1, sublinear=False), engine.encoder)
    assert other.root != engine.root


def test_keys_tell_vectors_and_encoders_apart(spark, tmp_path):
    docs, cache = readers.corpus_of(spark, TEXTS), str(tmp_path)
    tables = [spark.createDataFrame(rows, "word string, vector array<float>") for rows in ([("graph", [1.0, 0.0]), ("speech", [0.0, 1.0])], [("graph", [0.5, 0.5, 0.5])])]
    first, second = (SearchEngine(docs, cache, word_vectors=t) for t in tables)
    assert first.root != second.root and (first.width, second.width) == (2, 3)
    assert [r["vector"] for r in second.word_vectors.collect()] == [[0.5, 0.5, 0.5]]
    assert SearchEngine(docs, cache, word_vectors=tables[0].repartition(2)).root == first.root
    named = [embed.SentenceTransformerEncoder(n, 4) for n in "ab"] + [embed.SentenceTransformerEncoder("a", 5), embed.HashingEncoder(4), None]
    assert len({embed.encoder_key(e) for e in named}) == 5
    broken, n = Path(second.root) / "terms.parquet" / "_SUCCESS", second.index.terms.count()
    broken.unlink()
    assert SearchEngine(docs, cache, word_vectors=tables[1]).index.terms.count() == n > 0 and broken.exists()


class FakeSentenceModel:
    def __init__(self, name):
        self.name = name

    def encode(self, texts, batch_size, convert_to_numpy, show_progress_bar):
        return np.array([[len(t), t.count(" "), 1] for t in texts], dtype=np.float32)


def test_sentence_model(spark, tmp_path, monkeypatch):
    """The encoder of the library, with a model that stands in for one with weights; loaded once, in batches of 16."""
    encoder = embed.SentenceTransformerEncoder("fake", 3)
    encoder._model = FakeSentenceModel("fake")
    assert encoder.encode(["a b"]).tolist() == [[3, 1, 1]]
    assert encoder.__getstate__() == {"name": "fake", "dim": 3, "_model": None}
    module = types.ModuleType("sentence_transformers")
    module.SentenceTransformer = FakeSentenceModel
    monkeypatch.setitem(sys.modules, "sentence_transformers", module)
    fresh = embed.SentenceTransformerEncoder("fake", 3)
    assert fresh.encode(["abc"]).tolist() == [[3, 0, 1]] and fresh._model.name == "fake"


class Longest:
    """A retriever of one's own: the longest texts, whatever is asked."""

    key = "longest"

    def __init__(self, corpus):
        self.corpus = corpus

    def search(self, queries, k):
        rows = queries.select("query_id").join(self.corpus.select("doc_id", F.length("text").cast("double").alias("score")), how="cross")
        return lexical.rank(rows, k)


def test_further_retrievers_and_service(spark, tmp_path):
    docs = readers.corpus_of(spark, TEXTS)
    vectors = spark.createDataFrame([("graph", [1.0, 0.0])], "word string, vector array<float>")
    engine = SearchEngine(docs, str(tmp_path), word_vectors=vectors, more=[Longest(docs.where("text is not null"))], device="cuda")
    assert engine.methods == ["tfidf", "word2vec", "longest"]
    assert engine.status().first().asDict() == {"status": "ok", "corpus_size": 3, "device": "cuda", "n_methods": 3}
    ready = []
    server = service.serve(lambda: ready[0] if ready else None, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    with pytest.raises(RuntimeError, match="starting up"):
        service.ask(base, "/api/health")
    ready.append(engine)
    assert service.ask(base, "/api/health")["methods"] == engine.methods
    out = service.ask(base, "/api/search", {"query": " graph ", "k": 2})
    assert out["query"] == "graph" and [m["key"] for m in out["methods"]] == engine.methods
    assert [len(m["results"]) for m in out["methods"]] == [2, 2, 2]
    for body in ({"query": "x" * 501}, {"query": "a", "k": 21}, {"k": 1}, {"query": 5}, {"query": ""}, []):
        assert service.answer(engine, "POST", "/api/search", json.dumps(body).encode())[0] == 422
    assert service.answer(engine, "POST", "/api/search", b"{")[0] == 422
    assert service.answer(engine, "POST", "/api/search", b'{"query": "  "}')[0] == 400
    with pytest.raises(RuntimeError, match="Not Found"):
        service.ask(base, "/elsewhere")
    server.shutdown()


def test_overlap_and_json(spark, engine):
    q = spark.createDataFrame([(0, "graph network"), (1, "speech")], "query_id long, query string")
    hits = engine.search_batch(q, 2)
    for r in R.also_in(hits).collect():
        assert r["method"] not in r["also_in"].split(",")
    shared = {r["query_id"]: r["n_shared"] for r in R.overlap_count(hits).collect()}
    assert set(shared) == {0, 1}
    response = json.loads(sinks.response_json(hits, R.methods(spark)).where("query_id = 0").first()["response"])
    assert [m["key"] for m in response["methods"]] == ["tfidf", "word2vec", "bert"]
    assert [h["rank"] for h in response["methods"][0]["results"]] == [1, 2]
    one = hits.where("query_id = 0 and method = 'tfidf'")
    assert sinks.report(one, "TF-IDF").splitlines()[1].startswith("1. [0.")
    assert sinks.report(one.where("false"), "x").endswith("No results.")
    assert "doc_id" in json.loads(sinks.hit_json(one).first()["hit"])


def test_validation(spark):
    assert validate.check(" a ") == "a"
    for bad in (("",), ("x" * 501,), ("   ",), ("a", 0), ("a", 21)):
        with pytest.raises(ValueError):
            validate.check(*bad)
    rows = spark.createDataFrame([(None, 5), ("x", 0), ("  ", 5), (" ok ", 20)], "query string, k int")
    assert sorted(r["verdict"] for r in validate.verdicts(rows).collect()) == ["bad_k", "bad_length", "blank", "ok"]
    assert validate.allowed(rows).first()["query"] == "ok"


def test_corpus(spark):
    docs = readers.corpus_of(spark, TEXTS)
    assert sorted(r["doc_id"] for r in C.dedup_first(docs).collect()) == [0, 1, 2]
    assert C.fingerprint(docs) == hashlib.sha1("".join(t for t in TEXTS if t).encode()).hexdigest()[:16]
    assert C.content_key(docs) == C.content_key(docs.repartition(3)) != C.content_key(docs, k=1)
    idx = C.with_doc_idx(spark.range(100, 200).toDF("doc_id").repartition(7)).collect()
    assert all(r["doc_idx"] == r["doc_id"] - 100 for r in idx)
    assert C.dedup_first(docs.where("false")).count() == 0
    wide = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("doc_id"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 12).alias("text")).repartition(9)
    got = C.with_doc_idx(wide).select("doc_id", "doc_idx", F.length("text").alias("n")).orderBy("doc_id").collect()
    assert [r["doc_idx"] for r in got] == list(range(20_000)) and {r["n"] for r in got} == {1536}
    with_nulls = spark.createDataFrame([(None, "a"), (2, "b"), (2, "c"), (1, "d")], "doc_id long, text string")
    assert sorted((r["doc_idx"], r["doc_id"] or 0) for r in C.with_doc_idx(with_nulls).collect()) == [(0, 0), (1, 1), (2, 2), (3, 2)]


def test_sources(spark, tmp_path):
    csv = tmp_path / "a.csv"
    csv.write_text('arxiv_id,abstract,start_idx,end_idx,label\n2301.12340,"two\nlines, ""quoted""",0,5,x\n')
    row = readers.read_annotations(spark, str(csv)).first()
    assert (row["arxiv_id"], row["abstract"]) == ("2301.12340", 'two\nlines, "quoted"')
    assert readers.first_existing(spark, [str(tmp_path / "no"), str(csv)]) == str(csv)
    with pytest.raises(FileNotFoundError):
        readers.first_existing(spark, [str(tmp_path / "no")])
    vec = tmp_path / "v.txt"
    vec.write_text("2 3\nking 1 2 3\nqueen 3 2 1\n")
    assert {r["word"]: r["vector"] for r in readers.read_word_vectors(spark, str(vec)).collect()} == {"king": [1, 2, 3], "queen": [3, 2, 1]}


def test_stream(spark, engine, tmp_path):
    rows = spark.createDataFrame([(0, "graph network")], "query_id long, query string")
    rows.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).json(str(tmp_path / "in"))
    run = S.score_stream(stream, lambda q: engine.search_batch(q, 1).select("query_id", "method", "doc_id"), str(tmp_path / "out"), str(tmp_path / "cp"))
    run.processAllAvailable()
    run.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    late = spark.createDataFrame([("s", 2, "new"), ("s", 1, "old")], "session string, request_id long, response string")
    assert S.latest_response(late).first()["response"] == "new"


def test_skewed_dedup(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    assert C.dedup_first(docs).count() == docs.select("text").distinct().count()


def tables(spark):
    return {p.name for p in Path(session.shared_dir(spark).removeprefix("file://"), "corpuscle").glob("*")}


def test_a_warm_engine_and_its_searches_write_nothing(spark, tmp_path):
    docs, options = readers.corpus_of(spark, ["graph graphs network", "speech"]), Options(lemmatise=True, min_count=1)
    vectors = spark.createDataFrame([("graph", [1.0, 0.0])], "word string, vector array<float>")
    SearchEngine(docs, str(tmp_path), options, word_vectors=vectors)
    before, cached = tables(spark), {p.name for p in tmp_path.glob("*/*")}
    engine = SearchEngine(docs, str(tmp_path), options, word_vectors=vectors)
    assert not any(t.startswith(("counts", "tokens")) for t in tables(spark) - before)
    assert {p.name for p in tmp_path.glob("*/*")} == cached
    before = tables(spark)
    for query in ("graphs", "speech network"):
        assert engine.search(query, 1)["methods"][0]["results"]
    assert tables(spark) == before


class Nothing:
    key = "nothing"

    def search(self, queries, k):
        return queries.sparkSession.createDataFrame([], "query_id long, doc_id long, score double, rank int")


def test_a_method_without_hits_is_told(spark, tmp_path):
    vectors = spark.createDataFrame([("graph", [1.0])], "word string, vector array<float>")
    engine = SearchEngine(readers.corpus_of(spark, ["graph"]), str(tmp_path), word_vectors=vectors, more=[Nothing()])
    assert {m["key"]: len(m["results"]) for m in engine.search("graph", 2)["methods"]} == {"tfidf": 1, "word2vec": 1, "nothing": 0}


def test_overlapping_writes_leave_the_setting(spark, tmp_path):
    spark.conf.set(session.CLEANUP, "false")
    threads = [threading.Thread(target=session.save, args=(spark.range(50_000).repartition(3), f"{tmp_path}/{i}")) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert spark.conf.get(session.CLEANUP) == "false" and all(spark.read.parquet(f"{tmp_path}/{i}").count() == 50_000 for i in range(4))


def test_vectors_of_two_widths(spark):
    docs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0])], "doc_id long, vector array<double>")
    with pytest.raises(ValueError, match="several dimensions"):
        dense.cosine_topk(docs, docs.withColumnRenamed("doc_id", "query_id"), 1)
