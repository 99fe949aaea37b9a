"""Streams of queries against a static index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def score_stream(queries: DataFrame, search: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Searches each micro-batch of ``(query_id, query)`` rows; a batch that is repeated replaces its own folder."""

    def each(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            search(batch).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def latest_response(responses: DataFrame) -> DataFrame:
    """Per session the response of the newest request; older ones that arrive late do not count."""
    return responses.groupBy("session").agg(F.max("request_id").alias("request_id"), F.max_by("response", "request_id").alias("response"))


#: A session that is silent for so long is forgotten.
FORGET_MS = 3_600_000


def newest_wins(events: DataFrame, forget_ms: int = FORGET_MS) -> DataFrame:
    """Of a stream ``(session, request_id, response)`` the answers that still count: ``(session, request_id, response)``.

    A row without response announces a request, one with a response answers it. An answer counts if no newer request of
    its session has been announced or answered, in this batch or any before, also before a restart: the state, two
    fields a session, is kept with the checkpoint and goes after ``forget_ms`` of silence. An answer counts once. Rows
    without session or request id are left out.
    """

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        newest, answered = state.get if state.exists else (-1, False)
        best = None
        for rows in batches:
            top = int(rows["request_id"].max())
            if top > newest:
                newest, answered, best = top, False, None
            told = rows[(rows["request_id"] == newest) & rows["response"].notna()]
            if len(told) and not answered:
                first = min(told["response"])
                best = first if best is None else min(best, first)
        if best is not None:
            answered = True
            yield pd.DataFrame({"session": [key[0]], "request_id": [newest], "response": [best]})
        state.update((newest, answered))
        state.setTimeoutDuration(forget_ms)

    rows = events.select(F.col("session").cast("string").alias("session"), F.col("request_id").cast("long").alias("request_id"), "response")
    rows = rows.where("session is not null and request_id >= 0")
    return rows.groupBy("session").applyInPandasWithState(
        keep, "session string, request_id long, response string", "newest long, answered boolean", "append", GroupStateTimeout.ProcessingTimeTimeout
    )
