import random
import tracemalloc
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from corpuscle.llm import nearcopies


def sets_of(texts):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    return out


def kept_by_all_pairs(texts):
    sets, root = sets_of(texts), list(range(len(texts)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [i for i in range(len(texts)) if find(i) == i]


def corpus(seed):
    """Texts, copies of them with words put in, changed and cut off on both sides of the threshold, and a common passage."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(200))
    passage = " ".join(word() for _ in range(30))
    base = [[word() for _ in range(rng.randrange(4, 160))] for _ in range(40)]
    out = [" ".join(w) for w in base]
    for w in base:
        for changes in (1, 2, 3, 5):
            v = list(w)
            for _ in range(changes):
                v[rng.randrange(len(v))] = word()
            out.append(" ".join(v))
        out += [" ".join(w[: len(w) * 9 // 10]), " ".join(w[: len(w) * 7 // 10]), " ".join(w) + " " + passage]
    out += [" ".join([passage, word(), word()]) for _ in range(60)]
    out += [out[3].upper(), out[4].replace(" ", "\n\n"), None, "", " \t", "one", "two words", "ONE"]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("common_from, together", [(1, 2000), (3, 7)])
def test_stage_against_all_pairs(spark, docs_of, monkeypatch, common_from, together):
    monkeypatch.setattr(nearcopies, "TOGETHER", together)
    monkeypatch.setattr(nearcopies, "SAMPLE", 2)
    monkeypatch.setattr(nearcopies, "COMMON_FROM", common_from)
    texts = corpus(common_from)
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs_of(texts), "").collect())
    assert got == kept_by_all_pairs(texts)


def test_prefixes_of_alike_sets_meet():
    rng = np.random.default_rng(3)
    for n in range(1, 60):
        a = np.unique(rng.integers(-(2**62), 2**62, n))
        common, times = np.sort(rng.choice(a, len(a) // 2, replace=False)), rng.integers(1, 9, len(a) // 2)
        for gone in range(n // 5 + 1):
            b = np.sort(rng.permutation(a)[gone:])
            if 5 * len(b) >= 4 * len(a):
                assert set(nearcopies.prefix(a, common, times)) & set(nearcopies.prefix(b, common, times))


def test_parities_bound_the_difference():
    rng = np.random.default_rng(4)
    for n in (1, 5, 60, 400, 5000):
        a = np.unique(rng.integers(-(2**62), 2**62, n))
        b = np.unique(np.concatenate([rng.permutation(a)[n // 7 :], rng.integers(-(2**62), 2**62, n // 9)]))
        differ = sum((x ^ y).bit_count() for x, y in zip((v & (1 << 64) - 1 for v in nearcopies.parities(a)), (v & (1 << 64) - 1 for v in nearcopies.parities(b)), strict=True))
        assert differ <= len(np.setxor1d(a, b)) and nearcopies.parities(a) == nearcopies.parities(a[::-1])
        (counted,) = nearcopies.differences(pd.Series([nearcopies.packed(a)]), pd.Series([nearcopies.packed(b)]))
        assert differ <= counted <= len(np.setxor1d(a, b))
    assert nearcopies.parities(np.zeros(0, dtype=np.int64)) == [0, 0, 0, 0]
    crowded = (np.arange(1000, dtype=np.int64) << 40) + 3  # all in one count, beyond what a byte holds
    for more, less in ((crowded, crowded[:900]), (crowded, crowded[:100])):
        (counted,) = nearcopies.differences(pd.Series([nearcopies.packed(more)]), pd.Series([nearcopies.packed(less)]))
        assert counted <= len(more) - len(less)
    none = pd.Series([], dtype=object)
    assert not len(nearcopies.differences(none, none))


def test_counts_are_compared_in_little_memory():
    """A batch of pairs takes less than its counts, where numbers of eight bytes took several times that."""
    r = np.random.default_rng(1)
    x, y = (pd.Series([r.integers(0, 256, nearcopies.PARITIES, dtype=np.uint8).tobytes() for _ in range(5_000)]) for _ in "xy")
    tracemalloc.start()
    got = nearcopies.differences(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    a, b = (np.frombuffer(b"".join(s), dtype=np.uint8).reshape(-1, nearcopies.PARITIES).astype(int) for s in (x, y))
    assert got.tolist() == np.abs(a - b).sum(axis=1).tolist() and peak < 2 * 5_000 * nearcopies.PARITIES


def test_leaves_little_behind(spark, docs_of):
    """Tables that are done with are deleted as the stage goes on."""
    from corpuscle.llm.common import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://")) / "corpuscle"
    before = set(folder.iterdir()) if folder.exists() else set()
    nearcopies.keep_first(docs_of(corpus(5))).count()
    left = {p.name.split("-")[0] for p in set(folder.iterdir()) - before}
    assert not left & {"shingles", "places", "met", "close", "asked", "sets", "labelled", "apart"}


def test_keep_first_rows(docs_of):
    docs = docs_of([(1, "same text here again", "en", "a", 1)] * 4 + [(None, "same text here again", "en", "a", 1)], clash=True)
    assert [r["doc_id"] for r in nearcopies.keep_first(docs).collect()] == [1]
    assert nearcopies.keep_first(docs).columns == docs.columns
    assert nearcopies.keep_first(docs_of([])).count() == 0
