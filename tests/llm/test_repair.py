import hashlib
import random
import re
import zlib

import duckdb
import pandas as pd
import pytest

from corpuscle.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def cheapest(rows):
    """Least (cost, audit, lines) by trying all edits forwards, state by state; rows are (role, text, fault)."""

    def closed(ways):
        for _ in range(3):
            for s, (c, a, t) in list(ways.items()):
                to = {"": "u", "s": "u", "u": "a", "a": "u"}[s]
                new = (c + 3, a + "I", t + [("user:" if to == "u" else "assistant:")])
                ways[to] = min(ways.get(to, new), new)
        return ways

    ways = closed({"": (0, "", [])})
    for role, text, fault in rows:
        after = {}
        for s, (c, a, t) in ways.items():
            options = [(s, (c + 4, a + "D", t))]
            if fault not in ("blank", "duplicate"):
                more, to = 3 * (fault == "truncated"), {"": "u", "s": "u", "u": "a", "a": "u"}[s]
                if role[:1] == to or (role[:1] == "s" and s == ""):
                    options.append((role[:1], (c + more, a + "K", t + [f"{role}:{text}"])))
                options.append((to, (c + 3 + more, a + "R", t + [("user:" if to == "u" else "assistant:") + text])))
            for to, new in options:
                after[to] = min(after.get(to, new), new)
        ways = closed(after)
    return min(ways[s] for s in ("", "a") if s in ways)


def brute(conversations):
    out = []
    for conv in dict.fromkeys(r[0] for r in conversations):
        hurt = []
        for c, turn, role, text in (r for r in conversations if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            code = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            hurt += [(turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
        hurt.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, rows = set(), []
        for _, role, text in hurt:
            bare = text.rstrip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            rows.append((role, text, fault))
        turns = [t for t, _, _ in hurt if t is not None]
        counts = [sum(f == x for _, _, f in rows) for x in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, lines = cheapest(rows)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *counts, illegal, cost, audit, sha("\n".join(lines))))
    return out


def sample(n, seed=3):
    rng, rows = random.Random(seed), []
    texts = ["Fine.", "Cut off", "", " \t\n", "Yes!", "Why? ", "Ende…", "a. ", None, "Same.", "Same."]
    for conv in range(n):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "User"])
            rows.append((conv, None if rng.random() < 0.05 else turn + (rng.random() < 0.1), role, rng.choice(texts)))
    rows += [(None, i, ("user", "assistant")[i % 2], f"Null {i}.") for i in range(5)]
    rows += [(10**15, 0, "user", "Lang. " * 100_000 + "Ende.")] + [(n + 7, 0, "user", "Again.")] * 4
    return rows


def test_against_brute_force(spark, rows_equal):
    rows = sample(300)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("code", pytest.importorskip("pyspark.sql.functions").lit("x"))
    for name in ("gone", "fault", "said", "audit", "times"):
        df = df.withColumn(name, df["role"])
    rows_equal(repair.repair_digest(df), COLUMNS, brute(rows))


@pytest.mark.parametrize("hold", [0, 40])
def test_large_conversations_stream(spark, rows_equal, monkeypatch, hold):
    """With hardly any text held, digests come from the second pass."""
    monkeypatch.setattr(repair, "HOLD", hold)
    rows = sample(60, 5)
    # HOLD is read on the executors, which import the module anew
    made = repair._audits

    def small(schema):
        inner = made(schema)

        def run(batches):
            repair.HOLD = hold
            yield from inner(batches)

        return run

    monkeypatch.setattr(repair, "_audits", small)
    found = repair.repair_digest(spark.createDataFrame(rows, SCHEMA))
    rows_equal(found, COLUMNS, brute(rows))


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi."), (1, 2, "tool", "Answer."), (1, 3, "user", " "), (2, 0, "user", "")]
    got = sorted(tuple(r) for r in repair.repaired(spark.createDataFrame(rows, SCHEMA)).collect())
    assert [(r[0], r[2], r[3]) for r in got] in (
        [(1, "user", ""), (1, "assistant", "Hello."), (1, "user", "Hi."), (1, "assistant", "Answer.")],
        [(1, "user", "Hi."), (1, "assistant", "Answer.")],
    )
    for conv in {r[0] for r in got}:
        assert re.fullmatch("(s?(ua)+)?", "".join(r[2][0] for r in got if r[0] == conv))


def test_audits_of_all_short_codes():
    rng = random.Random(7)
    faults = {"d": "blank"}
    for _ in range(3000):
        codes = "".join(rng.choice("suaxSUAXdua") for _ in range(rng.randint(0, 8)))
        rows = [({"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "x"), "t", faults.get(c, "truncated" if c.isupper() else "")) for c in codes]
        assert repair.repair_audit(codes) == cheapest(rows)[:2]


def test_long_conversation():
    cost, audit = repair.repair_audit("ua" * 50_000)
    assert (cost, audit) == (0, "K" * 100_000)


def test_empty(spark):
    assert repair.repair_digest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sql():
    rows = sample(200, 9)
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    got = con.sql(queries.ORACLE_SQL["op13_conversation_repair"]).select(", ".join(COLUMNS)).fetchall()
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))
