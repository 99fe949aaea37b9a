import math
from collections import Counter, defaultdict

import pytest

from corpuscle.llm import mixing


def test_exponent():
    tokens = [8000, 1000, 500, 500]
    a = mixing.fit_exponent(tokens, sum(tokens), 0.95, 100)
    assert 0 < a < 1
    assert mixing.entropy(mixing.temperature_weights(tokens, a)) == pytest.approx(0.95 * math.log(4), abs=1e-9)
    assert mixing.fit_exponent([5, 5], 10) == 1.0
    tight = mixing.fit_exponent(tokens, sum(tokens), 0.95, 2.0)
    w = mixing.temperature_weights(tokens, tight)
    assert max(x * sum(tokens) / t for x, t in zip(w, tokens, strict=True)) == pytest.approx(2.0, rel=1e-6)
    with pytest.raises(ValueError):
        mixing.fit_exponent([10], 100, max_repeat=4)
    assert mixing.fit_exponent([], 0) == 1.0 and mixing.temperature_weights([], 1) == []


def corpus(docs_of, clash=False):
    rows, n = [], 0
    for source, count in (("big", 900), ("mid", 200), (None, 60), ("small", 40)):
        for i in range(count):
            rows.append((n, "w " * (1 + i % 7), "en", source, 0))
            n += 1
    rows += [(n, None, None, "small", None), (n + 1, "", None, "big", None), (n + 2, "long " * 300, None, "mid", None)]
    return docs_of(rows, clash)


def test_quotas(docs_of):
    docs = corpus(docs_of)
    out = mixing.mix(docs, docs_per_block=16).collect()
    totals, largest = defaultdict(int), defaultdict(int)
    for r in docs.collect():
        t = len((r["text"] or "").split()) + 1
        totals[r["source"]] += t
        largest[r["source"]] = max(largest[r["source"]], t)
    names, budget = list(totals), sum(totals.values())
    tokens = [totals[n] for n in names]
    weights = mixing.temperature_weights(tokens, mixing.fit_exponent(tokens, budget))
    made = defaultdict(int)
    for r in out:
        made[r["source"]] += r["mix_tokens"]
    for n, w in zip(names, weights, strict=True):
        assert 0 <= made[n] - w * budget < largest[n] + 1, n
    copies = Counter(r["doc_id"] for r in out)
    per_source = defaultdict(set)
    for r in docs.collect():
        per_source[r["source"]].add(copies[r["doc_id"]])
    assert all(max(c) - min(c) <= 1 for c in per_source.values())
    assert all(0 <= r["mix_position"] <= 1 for r in out)


def test_stretches_hold_the_weights(docs_of):
    out = sorted(mixing.mix(corpus(docs_of), docs_per_block=8).collect(), key=lambda r: r["mix_position"])
    halves = [Counter(), Counter()]
    for r in out:
        halves[r["mix_position"] >= 0.5][r["source"]] += r["mix_tokens"]
    for s in ("big", "mid"):
        assert halves[0][s] / sum(halves[0].values()) == pytest.approx(halves[1][s] / sum(halves[1].values()), abs=0.12)


def test_layout_and_names(docs_of):
    docs = corpus(docs_of)
    key = lambda df: sorted((r["doc_id"], r["mix_copy"], r["mix_block"]) for r in df.collect())
    want = key(mixing.mix(docs))
    assert key(mixing.mix(docs.repartition(5))) == want
    clashing = mixing.mix(corpus(docs_of, clash=True))
    assert key(clashing) == want and "times" in clashing.columns


def test_small_tables(docs_of):
    assert mixing.mix(docs_of([])).count() == 0
    assert [r["doc_id"] for r in mixing.mix(docs_of([None])).collect()] == [0]
    with pytest.raises(ValueError):
        mixing.mix(docs_of(["a", "b"]), max_sources=1)
    assert len(mixing.mix(docs_of([(1, "a b", "en", "s", 3)] * 5)).collect()) == 5
