import itertools
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuscle.llm import decontaminate as D


def words(rng, n):
    return [f"w{rng.randrange(500)}" for _ in range(n)]


def brute(docs, items, window=16, share=0.8):
    """All alignments of all pairs, without seeds; words beyond the document's ends are not equal."""
    token = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    found = set()
    for d, text in docs:
        a = token(text)
        for i, item in items:
            b = token(item)
            if not b:
                continue
            w = min(window, len(b))
            for shift in range(-len(b) + 1, len(a)):
                same = [0 <= k + shift < len(a) and a[k + shift] == b[k] for k in range(len(b))]
                if any(sum(same[s : s + w]) >= share * w for s in range(len(same) - w + 1)):
                    found.add((d, i))
    return found


def test_masks_are_lossless():
    """Every placement of the substitutions that the threshold allows leaves a seed of the group unhurt."""
    for width in range(1, D.WINDOW + 1):
        masks = D.MASKS[max(g for g in D.MASKS if g <= width)]
        gone = width - math.ceil(width * D.SIMILARITY)
        for hurt in itertools.combinations(range(width), gone):
            assert any(
                all(mask[k] == "0" or s + k not in hurt for k in range(len(mask))) for mask in masks for s in range(width - len(mask) + 1)
            ), (width, hurt)


def make():
    rng = random.Random(4)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate([12, 20, 30, 45, 9, 16])]
    items += [(6, None), (7, ""), (8, items[1][1].upper())]
    docs = []
    for d in range(40):
        body = words(rng, 60)
        if d < 24:
            passage = items[d % 6][1].split()
            if d >= 12:
                for k in range(3, len(passage), 9):
                    passage[k] = "changed"
            if d >= 18:
                passage = passage[2:]
            body[20:20] = passage
        docs.append((d, " ".join(body)))
    docs += [(40, None), (41, ""), (42, "short text"), (43, " ".join(items[3][1].split()[:14])), (44, items[2][1]), (45, "x " * 30_000 + items[1][1])]
    return docs, items


def test_against_all_alignments(spark, docs_of):
    docs, items = make()
    want = {(d, min(i, 1) if i == 8 else i) for d, i in brute(docs[:45], items)} | {(45, 1)}
    frame = docs_of([(d, t, "en", "s", 1) for d, t in docs], clash=True)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for rows in (500_000, 0):  # broadcast, and by shuffle
        out = D.overlaps(frame, bench, broadcast_rows=rows).collect()
        assert {(r["doc_id"], r["item_id"]) for r in out} == want
        assert len(out) == len(want)
    assert {r["n_items"] for r in out if r["item_id"] == 1} == {2}
    exact = next(r for r in out if r["doc_id"] == 2)
    assert (exact["doc_start"], exact["item_start"], exact["n_same"], exact["n_words"]) == (20, 0, 16, 16)
    one = {r["doc_id"]: r for r in D.contaminated(frame, bench).collect()}
    assert {d: r["n_items"] for d, r in one.items()} == Counter(d for d, _ in brute(docs[:45], items)) | Counter({45: 2})
    assert all((d, r["item_id"]) in want for d, r in one.items())
    kept = {r["doc_id"] for r in D.decontaminate(frame, bench).collect()}
    assert kept == set(range(46)) - {d for d, _ in want}


@pytest.mark.parametrize("together", [4096, 2])
def test_random_substitutions(spark, docs_of, monkeypatch, together):
    """Items of 1 to 18 words, planted with as many substitutions at random places as are allowed, and with one more."""
    monkeypatch.setattr(D, "TOGETHER", together)
    rng = random.Random(9)
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in range(1, 19)]
    docs = []
    for n, item in items:
        width = min(n, 16)
        for extra in (0, 0, 0, 1):
            gone = set(rng.sample(range(width), min(width, width - math.ceil(0.8 * width) + extra)))
            passage = [f"s{rng.randrange(99)}" if k in gone or k >= width else w for k, w in enumerate(item.split())]
            docs.append((len(docs), " ".join(words(rng, rng.randrange(3)) + passage + words(rng, rng.randrange(20)))))
    want = brute(docs, items)
    assert len(want) >= 54
    out = D.overlaps(docs_of([(d, t, "en", "s", 1) for d, t in docs]), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in out} == want


def test_substitutions_are_tolerated(spark, docs_of):
    rng = random.Random(1)
    item = words(rng, 40)
    changed = [w if k % 6 else "other" for k, w in enumerate(item)]  # one word in six
    half = [w if k % 2 else "other" for k, w in enumerate(item)]
    out = D.contaminated(docs_of([" ".join(changed), " ".join(half)]), spark.createDataFrame([(0, " ".join(item))], "item_id long, text string"))
    assert [r["doc_id"] for r in out.collect()] == [0]


def test_empty_and_null_keys(spark, docs_of):
    bench = spark.createDataFrame([(None, "a b c d e f g h i j k l")], "item_id long, text string")
    rows = [(None, "a b c d e f g h i j k l", "en", "s", 1), (None, "clean", "en", "s", 1), (3, "a b c d e f g h i j k l", "en", "s", 1), (3, "a b c d e f g h i j k l", "en", "s", 1)]
    out = D.contaminated(docs_of(rows), bench).collect()
    assert sorted(map(repr, (r["doc_id"] for r in out))) == ["3", "None"]
    assert [r["text"] for r in D.decontaminate(docs_of(rows), bench).collect()] == ["clean"]
    assert D.contaminated(docs_of([]), bench).count() == 0
    assert D.decontaminate(docs_of(rows), bench.where("false")).count() == 4


def test_runs_no_python(spark, docs_of):
    bench = spark.createDataFrame([(0, "a b c d e f g h i j k l")], "item_id long, text string")
    plan = D.contaminated(docs_of(["a"]).select("doc_id", F.col("text")), bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
