import hashlib
import zlib

import duckdb
import pytest

from corpuscle.llm import merkle, queries


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(doc_id, text, lang, source, n_chars):
    return h("".join(map(field, (doc_id, source, lang, n_chars, text))))


def tree(nodes):
    """The root, and of each node the runs on its way with its place in them."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for way, j in zip(ways, range(len(at))):
            way.append((runs[at[j] // 8], at[j] % 8))
            at[j] //= 8
        nodes = [h("".join(run)) for run in runs]
    return nodes[0], ways


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda v: (v is not None, (v or "").encode()))
    own = {v: sorted(by[v], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for v in langs}
    inner = {v: tree([leaf(*r) for r in own[v]]) for v in langs}
    root, outer = tree([inner[v][0] for v in langs])
    out = []
    for v, above in zip(langs, outer):
        for r, way in zip(own[v], inner[v][1]):
            doc_id, text, lang, source, n_chars = r
            if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf(doc_id, text, lang, source, n_chars)
            for run, k in way + above:
                folded = h("".join(run[:k]) + folded + "".join(run[k + 1 :]))
            siblings = "".join("".join(run[:k] + run[k + 1 :]) for run, k in way + above)
            out.append((doc_id, leaf(*r), inner[v][0], root, h(siblings), folded, folded == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
ODD = [
    (None, "No id", "en", "s", 5), (7, None, None, None, None), (8, "", "", "", 0), (9, "ÄÖ Straße Z", "dé", "s", 3), (10, "Long " * 50_000, "en", "s", 1),
    (11, "Same", "en", "s", 4), (11, "Same", "en", "s", 4), (11, "other", "en", "s", 4), (12, "all lower", "en", "s", 4), (-3, "Below", "en", "s", 2),
]


@pytest.mark.parametrize("n", [1, 9, 65, 513])
def test_trees_of_many_sizes(docs_of, rows_equal, n):
    rows = [(i * 7 % 1000, f"Text {i}", "en" if i % 3 else "de", f"s{i % 2}", i) for i in range(n)]
    rows_equal(merkle.merkle_digest(docs_of(rows, clash=n == 9)), COLUMNS, brute(rows))


def test_odd_rows(docs_of, rows_equal):
    rows_equal(merkle.merkle_digest(docs_of(ODD, clash=True)), COLUMNS, brute(ODD))


def test_many_groups_and_buckets(docs_of, rows_equal, monkeypatch):
    """Nine groups and a bucket of 64 leaves: several levels in DuckDB, in Spark and over the groups."""
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 3)
    rows = [(i, f"Text {i}", f"l{i % 10}" if i < 100 else "hot", "s", i) for i in range(1500)]
    rows_equal(merkle.merkle_digest(docs_of(rows), 2), COLUMNS, brute(rows))


def test_manifest_and_proofs(spark, docs_of):
    docs = docs_of([(i, f"t{i}", "en" if i % 2 else "de", "s", 1) for i in range(20)])
    proofs, manifest = merkle.prove(merkle.leaves_of(docs, "doc_id", "lang", merkle.COLUMNS))
    assert sorted((r["grp"], r["n"]) for r in manifest.collect()) == [("=de", 10), ("=en", 10)]
    got = proofs.collect()
    assert all(r["folded_root"] == r["root"] and h(r["siblings"]) == r["proof_sha256"] for r in got) and len(got) == 20
    assert {len(r["siblings"]) // 64 for r in got} == {7 + 1 + 1, 1 + 1 + 1}


def test_empty(docs_of):
    assert merkle.merkle_digest(docs_of([]).where("false")).collect() == []


def test_sql(docs_of, rows_equal):
    """The registered SQL says what the brute force says."""
    import pandas as pd

    frame = pd.DataFrame(ODD, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64", "n_chars": "Int64"})
    con = duckdb.connect()
    con.register("documents", frame)
    got = con.sql(queries.ORACLE_SQL["op12_merkle_manifest"]).select(", ".join(COLUMNS)).fetchall()
    assert sorted(map(repr, got)) == sorted(map(repr, brute(ODD)))
