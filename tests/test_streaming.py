import json

from corpuscle.streaming.queries import newest_wins

SCHEMA = "session string, request_id long, response string"


def run(spark, folder, batches, forget_ms=3_600_000):
    """Each batch by a query of its own, started anew from the checkpoint; what has come out after each."""
    out = []
    for i, rows in batches:
        (folder / "in").mkdir(exist_ok=True)
        (folder / "in" / f"{i}.json").write_text("".join(json.dumps(dict(zip(("session", "request_id", "response"), r))) + "\n" for r in rows))
        events = spark.readStream.schema(SCHEMA).json(str(folder / "in"))
        query = newest_wins(events, forget_ms).writeStream.format("parquet").option("checkpointLocation", str(folder / "check")).trigger(once=True).start(str(folder / "out"))
        ended = query.awaitTermination(60)
        query.stop()
        assert ended and query.exception() is None
        out.append(sorted(map(tuple, spark.read.schema(SCHEMA).parquet(str(folder / "out")).collect())))
    return out


def test_late_answers_are_dropped_over_restarts(spark, tmp_path):
    got = run(spark, tmp_path, [
        (0, [("a", 1, None), ("a", 2, None), ("b", 1, None), ("a", 1, "late")]),
        (1, [("b", 1, "b1"), (None, 4, "x"), ("c", None, "y")]),
        (2, [("a", 2, "a2"), ("b", 1, "again")]),
        (3, [("a", 1, "very late"), ("b", 3, "b3"), ("b", 2, "old")]),
    ])
    assert got[0] == []
    assert got[1] == [("b", 1, "b1")]
    assert got[2] == [("a", 2, "a2"), ("b", 1, "b1")]
    assert got[3] == [("a", 2, "a2"), ("b", 1, "b1"), ("b", 3, "b3")]
