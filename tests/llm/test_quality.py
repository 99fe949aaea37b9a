import random

import numpy as np

from corpuscle.llm import quality as Q

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=240):
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        words = ["".join(rng.choices("etaoin shrdlu", k=rng.randrange(2, 9))).strip() or "a" for _ in range(rng.randrange(20, 80))]
        text = " ".join(words).capitalize() + "." if good else " ".join(w.upper() + rng.choice(["!!", "$$$", "###"]) for w in words)
        rows.append((i, text, "en", f"s{i % 5}", len(text)))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, int(good), 0))
    return rows, labels


def test_views():
    assert not Q.content_view(None)[: Q.TEXT_DIMS].any() and not Q.content_view("ab")[: Q.TEXT_DIMS].any()
    assert np.isclose(np.linalg.norm(Q.content_view("some text")[: Q.TEXT_DIMS]), 1)
    long = "é word " * 400_000
    whole = np.frombuffer(long.encode(), np.uint8).astype(np.uint32)
    mixed = (whole[:-2] * np.uint32(0x9E3779B1)) ^ (whole[1:-1] * np.uint32(0x85EBCA77)) ^ (whole[2:] * np.uint32(0xC2B2AE3D))
    counts = np.bincount((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(22), minlength=Q.TEXT_DIMS)
    assert np.allclose(Q.content_view(long)[: Q.TEXT_DIMS], np.sqrt(counts / counts.sum()), atol=1e-6)  # steps lose nothing
    assert np.isfinite(Q.metadata_view(None, None, None)).all() and np.isfinite(Q.metadata_view("", "", 2**60)).all()
    assert (Q.metadata_view("s", None, 1) != Q.metadata_view(None, None, 1)).any()
    assert (Q.metadata_view("s", "en", None) != Q.metadata_view("s", "en", 0)).any()
    assert all(len(Q.metadata_view("s", "en", n)) == Q.META_DIMS for n in (-1, 0, 1, 2**40))


def test_logistic_regression():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3)).astype(np.float32)
    y = (x @ [2, -1, 0] + 0.5 + rng.logistic(size=400) > 0).astype(float)
    w = Q.fit_logistic(x, y, np.ones(400), steps=3000)
    slope = x.T @ (Q.sigmoid(Q.logits(w, x)) - y) / 400 + 1e-4 * w[:-1]
    assert np.abs(slope).max() < 1e-3


def test_held_out_accuracy(spark, docs_of):
    rows, labels = corpus()
    out = {r["doc_id"]: r for r in Q.quality_report(docs_of(rows, clash=True), spark.createDataFrame(labels, LABELS)).collect()}
    known = {i for i, _, _ in labels}
    right = [out[i]["keep"] == (i % 4 != 0) for i in out if i not in known]
    assert len(out) == 240 and np.mean(right) > 0.95
    assert all(0 <= out[i][c] <= 1 for i in out for c in ("p_content", "p_metadata", "score"))


def test_pseudo_labels_help_the_other_view():
    """Metadata alone has few labels among noise; the content view passes it what it is sure of. Fails without the exchange."""
    rng = np.random.default_rng(1)
    y = np.repeat([0.0, 1.0], 400)
    text = np.column_stack([y * 4 - 2, rng.normal(size=800)]).astype(np.float32) + rng.normal(0, 0.3, (800, 2)).astype(np.float32)
    meta = np.column_stack([y * 1.2 - 0.6, *rng.normal(size=(40, 800))]).astype(np.float32) + rng.normal(0, 0.4, (800, 41)).astype(np.float32)
    some = rng.permutation(800)[:24]
    rest = np.setdiff1d(np.arange(800), some)

    def exchange(weights, prior):
        out = []
        for to, (own, other) in enumerate(((text, meta), (meta, text))):
            p = Q.sigmoid(Q.logits(weights[1 - to], other[rest]))
            sure = np.maximum(p, 1 - p) >= 0.9
            out.append((rest[sure], own[rest][sure], (p[sure] > 0.5).astype(float)))
        return tuple(out)

    accuracy = lambda m: ((Q.logits(m.metadata, meta[rest]) > 0) == y[rest]).mean()
    alone, both = (Q.co_train((text[some], meta[some]), y[some], e) for e in (None, exchange))
    assert accuracy(both) > accuracy(alone) + 0.1


def test_exchange_takes_the_surest_of_all(spark, docs_of, monkeypatch):
    """What each view is told, against scores of all unlabelled documents; layout does not matter."""
    rows, labels = corpus()
    seen = []

    def record(x, y, exchange, rounds):
        weights = tuple(Q.fit_logistic(x[v], y, np.ones(len(y))) for v in (0, 1))
        seen.append((weights, exchange(weights, float(y.mean()))))
        return Q.Model(None, None, None, 1.0)

    monkeypatch.setattr(Q, "co_train", record)
    marks = spark.createDataFrame(labels, LABELS)
    for docs in (docs_of(rows), docs_of(rows).repartition(5)):
        Q.fit(docs, marks, most_passed=20, sure=0.6)
    (weights, said), (_, again) = seen
    assert all(np.array_equal(a[0], b[0]) for a, b in zip(said, again, strict=True))
    said, again = ([s[1:] for s in each] for each in (said, again))
    known = {i for i, _, _ in labels}
    free = [r for r in rows if r[0] not in known]
    views = [np.array([Q.content_view(t) for _, t, *_ in free]), np.array([Q.metadata_view(s, g, n) for _, _, g, s, n in free])]
    for to in (0, 1):
        p = Q.logits(weights[1 - to], views[1 - to])
        n_good, n_bad = int((said[to][1] == 1).sum()), int((said[to][1] == 0).sum())
        assert n_good + n_bad <= 20 and len(said[to][0]) == len(said[to][1])
        limit = np.log(0.6 / 0.4)
        prior = np.mean([q for _, q, _ in labels])
        assert n_good == min((p >= limit).sum(), round(20 * prior)) and n_bad == min((p <= -limit).sum(), round(20 * (1 - prior)))
        assert np.array_equal(np.sort(said[to][0], axis=0), np.sort(again[to][0], axis=0))
        best = views[to][np.argsort(-p, kind="stable")[:n_good]].astype(np.float16).astype(np.float32)
        got = said[to][0][said[to][1] == 1]
        if to == 1:
            continue  # metadata repeat, so ties may go either way
        assert n_good == 0 or np.isclose(p[np.argsort(-p)[:n_good]].min(), min(p[[np.abs(views[0].astype(np.float16) - g).sum(axis=1).argmin() for g in got]]))
        assert best.shape == got.shape


def test_scores_against_their_definition():
    rng = np.random.default_rng(2)
    m = Q.Model(rng.normal(size=Q.CONTENT_DIMS + 1), rng.normal(size=Q.META_DIMS + 1), np.array([[0.5, 0.1], [2.0, -0.3]]), 0.8)
    (got,) = m.scores(["some text"], ["s"], [None], [9])
    a = 0.5 * (Q.content_view("some text") @ m.content[:-1] + m.content[-1]) + 0.1
    b = 2.0 * (Q.metadata_view("s", None, 9) @ m.metadata[:-1] + m.metadata[-1]) - 0.3
    assert np.allclose(got, [Q.sigmoid(a), Q.sigmoid(b), Q.sigmoid(a + b - np.log(4))])


def test_odd_labels_and_rows(spark, docs_of):
    rows, labels = corpus()
    rows += [(900, None, None, None, None), (901, "", None, None, None), (902, "long " * 50_000, "en", "s", 1), (None, "text", "en", "s", 1), (0, "twin", "en", "s", 1)]
    labels += [(0, 1, 0), (None, 1, 0), (900, None, None), (5555, 1, 1)]
    docs, marks = docs_of(rows), spark.createDataFrame(labels, LABELS)
    assert len(Q.quality_report(docs, marks).collect()) == 245
    kept = Q.keep_good(docs_of(rows, clash=True), marks)
    assert kept.count() < 245 and kept.columns == docs_of(rows, clash=True).columns
    none = marks.where("false")
    assert {(r["score"], r["keep"]) for r in Q.quality_report(docs, none).collect()} == {(1.0, True)}
    assert {r["keep"] for r in Q.quality_report(docs, marks.where("quality = 1")).collect()} == {True}
    assert Q.quality_report(docs_of([]), marks).count() == 0


def test_samples_are_bounded(spark, docs_of):
    rows, labels = corpus()
    model = Q.fit(docs_of(rows), spark.createDataFrame(labels, LABELS), most_labelled=60, most_passed=20)
    assert model.content is not None
    one = [(i % 7, t, g, s, n) for i, t, g, s, n in rows]  # repeated ids: the choice is that of the least hash
    a, b = (Q.fit(d, spark.createDataFrame(labels, LABELS)) for d in (docs_of(one), docs_of(one[::-1]).repartition(3)))
    assert (a.content is None) == (b.content is None) and a.prior == b.prior
