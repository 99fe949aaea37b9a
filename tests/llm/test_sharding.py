import zlib
from collections import Counter

import numpy as np
import pytest

from corpuscle.llm import sharding


def test_matrix_has_its_sums():
    m = sharding.communication_matrix([10, 0, 25, 7], [11, 11, 10, 10], 3)
    assert m.sum(axis=1).tolist() == [10, 0, 25, 7] and m.sum(axis=0).tolist() == [11, 11, 10, 10]
    with pytest.raises(ValueError):
        sharding.communication_matrix([1], [2], 0)


def test_matrix_follows_the_hypergeometric_law():
    drawn = np.array([sharding.communication_matrix([4, 4], [4, 4], s)[0, 0] for s in range(4000)])
    want = np.array([1, 16, 36, 16, 1]) / 70
    assert np.abs(np.bincount(drawn, minlength=5) / 4000 - want).max() < 0.03


def test_large_populations_take_the_other_sampler(monkeypatch):
    monkeypatch.setattr(sharding, "NUMPY_MOST", 0)
    drawn = np.array([sharding.communication_matrix([4, 4], [4, 4], s)[0, 0] for s in range(3000)])
    assert np.abs(np.bincount(drawn, minlength=5) / 3000 - np.array([1, 16, 36, 16, 1]) / 70).max() < 0.03


def test_exact_sizes_and_gapless_slots(docs_of):
    texts = [None, "", "same", "same", "é" * 5, "long " * 20_000] + [f"t{i}" for i in range(1500)] + [(7, "twin", None, None, 1)] * 3 + [(None, None, None, None, None)] * 2
    out = sharding.shard_digest(docs_of(texts), 8).collect()
    sizes = Counter(r["shard"] for r in out)
    assert len(out) == len(texts) and set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s]))
    raw = lambda t: (t[1] if isinstance(t, tuple) else t) or ""
    assert Counter((r["size"], r["text_crc32"]) for r in out) == Counter((len(raw(t).encode()) + 1, zlib.crc32(raw(t).encode())) for t in texts)
    assert {r["law"] for r in out} == {"rows"} and {r["grown_shard"] for r in out} == {None}


def test_layout_does_not_matter(docs_of):
    docs = docs_of([f"t{i}" for i in range(900)])
    a, b = (sharding.shard(d, 3, 5, rows_per_part=64, rows_per_block=50) for d in (docs, docs.repartition(7)))
    assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()}
    other = sharding.shard(docs, 3, 6, rows_per_part=64)
    assert {tuple(r) for r in other.collect()} != {tuple(r) for r in a.collect()}


def test_equal_rows_are_spread(docs_of, monkeypatch):
    """A third of all rows are one: they are dealt like others, and no partition holds them all."""
    rows = [(7, "same", "en", "s", 4)] * 1000 + [(i, f"t{i}", "en", "s", 2) for i in range(2000)]
    biggest = []
    matrix = sharding.communication_matrix
    monkeypatch.setattr(sharding, "communication_matrix", lambda counts, *a: biggest.append(max(counts)) or matrix(counts, *a))
    out = sharding.shard(docs_of(rows), 4, rows_per_part=16).collect()
    assert biggest[0] < 60
    assert len(out) == 3000 and Counter(r["doc_id"] for r in out)[7] == 1000 + 1
    for s in range(4):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(750))
    same = Counter(r["shard"] for r in out if r["doc_id"] == 7)
    assert max(same.values()) - min(same.values()) < 120


def test_order_is_shuffled(docs_of):
    rows = sharding.shard(docs_of([f"t{i}" for i in range(2000)]), 2, rows_per_part=100, rows_per_block=100).orderBy("shard", "slot").collect()
    ids = np.array([r["doc_id"] for r in rows])
    assert abs(np.corrcoef(ids, np.arange(len(ids)))[0, 1]) < 0.08


def test_empty_and_clashing(docs_of):
    assert sharding.shard(docs_of([])).count() == 0
    out = sharding.shard(docs_of(["a", "b", None], clash=True), 2)
    assert out.columns.count("shard") == 1 and out.count() == 3
