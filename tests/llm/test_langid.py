import math
import random

import numpy as np
import pytest

from corpuscle.llm import langid as L

TINY = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4, "▁ab": 5}
BYTES = np.arange(6, 262)


def splits(text):
    if not text:
        yield []
    for i in range(1, len(text) + 1):
        for rest in splits(text[i:]):
            yield [text[:i], *rest]


def plain(word, logp):
    """The sum over all segmentations, one by one."""
    total = 0.0
    for parts in splits(L.MARK + word):
        p = 1.0
        for x in parts:
            if x in TINY:
                p *= math.exp(logp[TINY[x]])
            elif len(x) == 1:
                p *= math.exp(sum(logp[6 + b] for b in x.encode()))
            else:
                p = 0.0
        total += p
    return math.log(total)


def tables():
    rng = np.random.default_rng(3)
    p = rng.random((262, 2)) + 0.01
    return np.log(p / p.sum(axis=0))


def test_forward_sums_all_segmentations():
    logp, words = tables(), ["a", "ab", "abba", "aéb", "bbb", "éé", "aabab"]
    lattice = L.Lattice(words, TINY)
    got = lattice.marginals(logp, BYTES)
    for w, row in zip(words, got, strict=True):
        assert row == pytest.approx([plain(w, logp[:, 0]), plain(w, logp[:, 1])])


def test_expected_counts_are_the_derivative():
    """Of the log probability by each piece's log probability."""
    logp, words, n = tables()[:, :1], ["abba", "aéb", "aab"], np.array([2.0, 1.0, 3.0])
    expected = L.Lattice(words, TINY).expected(logp, BYTES, n)
    total = lambda table: float(L.Lattice(words, TINY).marginals(table, BYTES)[:, 0] @ n)
    for piece in [*range(6), 6 + 0xC3, 6 + 0xA9]:
        moved = logp.copy()
        moved[piece] += 1e-6
        assert (total(moved) - total(logp)) / 1e-6 == pytest.approx(expected[piece], abs=1e-4)


def test_long_words_do_not_underflow():
    model = L.Model(["x", "y"], tables(), TINY, BYTES)
    (lang, score), = model.predict(["é" * 3000])
    assert lang in "xy" and 0.5 <= score <= 1


def test_cache_is_bounded_and_changes_nothing():
    words = ["".join(random.Random(i).choice("ab") for _ in range(8)) for i in range(300)]
    texts = [" ".join(words[i : i + 30]) for i in range(0, 300, 7)]
    wide, narrow = L.Model(["x", "y"], tables(), TINY, BYTES), L.Model(["x", "y"], tables(), TINY, BYTES, most=5)
    a, b = list(wide.predict(texts)), list(narrow.predict(texts, step=1))
    assert [x[0] for x in a] == [x[0] for x in b]
    assert [x[1] for x in a] == pytest.approx([x[1] for x in b])


def corpus():
    rng = random.Random(0)
    words = {"en": "the quick brown fox jumps over lazy dogs and runs away".split(), "de": "der schnelle braune fuchs springt über faule hunde und rennt weg".split()}
    rows = [(i, " ".join(rng.choices(words[g], k=25)).capitalize(), g, "s", 1) for i, g in enumerate(["en", "de"] * 40)]
    return rows + [(80, None, "en", "s", 0), (81, "", None, "s", 0), (82, "123 !?", "de", "s", 0), (83, "½ ²", "en", "s", 0), (84, "the dogs " * 9000, None, None, None), (None, "und hunde", "de", "s", 1)]


def test_held_out_accuracy(docs_of):
    out = {r["doc_id"]: r for r in L.language_report(docs_of(corpus(), clash=True)).collect()}
    assert len(out) == 86
    for i, g in enumerate(["en", "de"] * 40):
        assert out[i]["lang_pred"] == g and 0.9 < out[i]["score"] <= 1
    assert [out[i]["lang_pred"] for i in (80, 81, 82, 83)] == ["und"] * 4 and out[80]["score"] == 0
    assert out[84]["lang_pred"] == "en" and out[None]["lang_pred"] == "de"
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in out.items() if i is not None)


def test_labels_of_held_out_rows_are_not_used(docs_of):
    import zlib

    rows = [(i, t, "xx" if i is not None and zlib.crc32(str(i).encode()) % 3 == 1 else g, s, n) for i, t, g, s, n in corpus()]
    a = L.language_report(docs_of(corpus())).collect()
    b = L.language_report(docs_of(rows)).collect()
    assert {(r["doc_id"], r["lang_pred"]) for r in a} == {(r["doc_id"], r["lang_pred"]) for r in b}


def test_nothing_to_learn(docs_of):
    out = L.language_report(docs_of([(0, "some words", None, "s", 1), (1, None, None, "s", 1)])).collect()
    assert [(r["lang_pred"], r["score"]) for r in out] == [("und", 0.0)] * 2
    assert L.language_report(docs_of([])).count() == 0
    assert len(L.fit(docs_of(corpus()), most_rows=10).langs) >= 1


def test_rows_and_languages(docs_of):
    model = L.fit(docs_of(corpus()))
    twice = docs_of([(1, "the dogs", None, "s", 1)] * 3 + [(2, "und hunde " * 20_000, None, "s", 1)], clash=True)
    out = L.identify(twice, model)
    assert sorted((r["doc_id"], r["lang_pred"]) for r in out.collect()) == [(1, "en")] * 3 + [(2, "de")]
    assert out.count() == 4 and L.identify(docs_of([]), model).count() == 0
    with pytest.raises(ValueError):
        L.fit(docs_of(corpus()), most_langs=1)
