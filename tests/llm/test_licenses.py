import math
import random
import re

from corpuscle.llm import licenses as L


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    at = [(i, label) for phrase, label in L.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in at]
    return len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def test_base_against_brute_force(docs_of, rows_equal):
    rng = random.Random(3)
    parts = "MIT mit License license, apache general Public public-license gnu the é İ K's 3rd _ mit·license\tx".split(" ")
    texts = [None, "", "...", "mit license mit license", "MIT\nLicense", "mit licenses", "submit license"]
    texts += [" ".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(150)] + ["filler words " * 20_000 + "general public license"]
    out = L.scan(docs_of(texts, clash=True))
    rows_equal(out, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"], [(i, *plain(t)) for i, t in enumerate(texts)])


def test_notices(docs_of):
    texts = [f"some words before {text} and after" for _, text, _ in L.TEMPLATES]
    texts += ["Licensed under CC BY-NC 4.0.", "CC BY", "licensed under nothing", "creative commons", None]
    out = {r["doc_id"]: r for r in L.scan(docs_of(texts + [f"clean text {i}" for i in range(50)])).collect()}
    for i, (label, _, _) in enumerate(L.TEMPLATES):
        assert label in out[i]["labels"].split(",") and 0.99 <= out[i]["score"] <= 1, label
    n = len(L.TEMPLATES)
    assert out[n]["labels"] == "cc-by-nc" and out[n]["base_labels"] == ""
    assert [out[i]["labels"] for i in range(n + 1, n + 5)] == [""] * 4
    assert all(out[i]["score"] == 0 for i in range(n + 5, n + 55))


def test_altered_rare_words(docs_of):
    """A notice without some of the template's rarest words is found by the file's own next ones."""
    k, (label, text, phrases) = next((k, t) for k, t in enumerate(L.TEMPLATES) if t[0] == "isc")
    n = 60
    idf = {w: math.log((n + 1) / 2) for w in L.vocabulary()}
    rarest = set(L.by_rarity(k, idf)[: L.RARE]) - set(" ".join(phrases).split())
    texts = [text, " ".join("altered" if w in set(list(rarest)[:3]) else w for w in text.split())]
    out = {r["doc_id"]: r for r in L.scan(docs_of(texts + [f"clean text {i}" for i in range(n - 2)])).collect()}
    assert rarest and out[0]["labels"] == out[1]["labels"] == label and out[1]["score"] >= 0.6


def test_two_notices_in_one_file(docs_of):
    both = [L.TEMPLATES[k][1] for k in range(len(L.TEMPLATES)) if L.TEMPLATES[k][0] in ("isc", "zlib", "epl")]
    out = L.scan(docs_of(["\n\n".join(both), "x " * 50_000 + both[0], None])).orderBy("doc_id").collect()
    assert out[0]["labels"] == "epl,isc,zlib" and out[1]["labels"] == "epl" and out[2]["labels"] == ""


def test_every_phrase_has_a_stem():
    phrases = [*L.PHRASES, *(p for _, _, ps in L.TEMPLATES for p in ps)]
    assert all(any(s in p for s in L.STEMS) for p in phrases)
    assert all(any(p in text for p in ps) for _, text, ps in L.TEMPLATES)


def test_equal_rows_and_empty(docs_of):
    rows = [(1, "mit license", "en", "s", 1)] * 3 + [(None, "mit license", None, None, None)]
    out = L.scan(docs_of(rows)).collect()
    assert len(out) == 4 and {r["n_base"] for r in out} == {1}
    assert L.scan(docs_of([])).count() == 0
    plan = L.scan(docs_of(["a"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
