import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuscle.llm import common, components, simhash


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbÉ \t\n\x0b  ", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_same_hash_as_spark(spark):
    row = spark.sql("SELECT xxhash64('one two three four')").first()[0]
    assert simhash.fingerprint("ONE two  three\tfour") == row & (1 << 64) - 1
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_code_covers():
    """Within radius 1 of each 21-bit block lies an anchor, and a pair one bit apart shares one."""
    rng = np.random.default_rng(0)
    near, patterns, syndromes = simhash.anchor_patterns(1), simhash.anchor_patterns(2), simhash._syndromes()
    of = lambda x, p: {int(x) ^ int(e) for e in p[syndromes[x >> simhash.FREE_BITS]]}
    for x in rng.integers(0, 1 << 21, 300):
        assert of(x, near)
        for bit in range(21):
            assert of(x, near) <= of(x, patterns) and of(x, near) & of(x ^ 1 << bit, patterns)


@pytest.mark.parametrize("dense, crowd, block", [(512, 4096, None), (2, 4096, 0), (512, 8, None), (2, 8, 1)])
def test_forest(dense, crowd, block):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    points = np.unique(np.array([b ^ np.uint64(1) << np.uint64(i) ^ np.uint64(1) << np.uint64(j) for b in base for i in range(12) for j in range(12)], dtype=np.uint64))
    edges = simhash.forest(points, 4, dense=dense, step=3, crowd=crowd, block=block)
    assert components_of(points.tolist(), edges) == components_of(points.tolist(), all_links(points.tolist(), 4))
    assert len(edges) < len(points)


def all_links(points, threshold):
    return [(a, b) for i, a in enumerate(points) for b in points[:i] if (a ^ b).bit_count() <= threshold]


def components_of(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("threshold", [0, 3, 4, 5])
def test_links_against_all_pairs(spark, threshold):
    rng = random.Random(threshold)
    points = {rng.getrandbits(64) for _ in range(150)}
    for p in list(points)[:60]:
        for n in range(1, 7):
            points.add(p ^ sum(1 << b for b in rng.sample(range(64), n)))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in points]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), threshold).collect()
    got = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in edges]
    assert all((a ^ b).bit_count() <= 64 for a, b in got)
    assert components_of(points, got) == components_of(points, all_links(sorted(points), threshold))


def test_threshold_is_limited(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 6)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7), (200, 100)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 200: 100}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def corpus():
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * 3 + str(rng.randrange(300)) for _ in range(n))
    texts = [text(80) for _ in range(40)]
    texts += [t.upper() for t in texts[:5]] + [texts[7]] * 9 + [f"{t} tail" for t in texts[10:20]] + [None, "", " ", "one", text(30_000)]
    return texts


def test_query_against_all_pairs(docs_of, rows_equal):
    texts = corpus()
    prints = [plain_fingerprint(t) if len(t or "") < 9999 else simhash.fingerprint(t) for t in texts]
    least = {}
    root = components_of(set(prints), all_links(sorted(set(prints)), 4))
    for i, p in enumerate(prints):
        least.setdefault(root[p], i)
    out = simhash.simhash_report(docs_of(texts))
    rows_equal(out, ["doc_id", "fingerprint", "component_id"], [(i, f"{p:016x}", least[root[p]]) for i, p in enumerate(prints)])


def test_classes_of_rows(docs_of):
    texts = corpus()
    docs = docs_of(texts, clash=True)
    out = simhash.near_duplicates(docs)
    want = {r["doc_id"]: r["component_id"] for r in simhash.simhash_report(docs).collect()}
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == want
    assert out.columns == [*docs.columns, "fingerprint", "component_id"]
    twice = docs_of([(1, "same text here again", "en", "a", 1)] * 4 + [(None, "same text here again", "en", "a", 1)])
    assert [r["component_id"] for r in simhash.near_duplicates(twice).collect()] == [1] * 5
    assert simhash.near_duplicates(docs_of([])).count() == simhash.simhash_report(docs_of([])).count() == 0


def test_parts_of_bits():
    for block in (None, 0, 1, 2):
        parts = simhash.parts_of_bits(5, block)
        covered = [shift + i for shift, mask in parts for i in range(64) if mask >> i & 1]
        inside = range(0) if block is None else range(21 * block, 21 * block + 21)
        assert sorted(covered) == [i for i in range(64) if i not in inside]


def test_hub(spark, monkeypatch):
    """Keys beyond the limit are broadcast, the others shuffled; both ways give the same components."""
    monkeypatch.setattr(common, "LIGHT", 5)
    star = [(0, i) for i in range(1, 80)] + [(200, i) for i in range(201, 204)] + [(79, 300), (300, 301)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(star, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(80)}, **{i: 200 for i in range(200, 204)}, 300: 0, 301: 0}
