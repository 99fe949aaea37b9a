"""Connected components by alternating large-star and small-star steps over a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, hot_join, written


def _star(edges: DataFrame, large: bool, n_edges: int) -> DataFrame:
    """One step. Edges are ``(u, v)`` with ``u > v``, ``n_edges`` at most.

    large: each node's larger neighbours are linked to the least of it and its neighbours.
    small: each node and its smaller neighbours are linked to the least of them.
    """
    around = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = around.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    moved = hot_join(around, least, "u", 2 * n_edges).select(F.col("v").alias("u"), "m", F.col("u").alias("centre"))
    if large:
        out = moved.where("u > centre").select("u", F.col("m").alias("v"))
    else:
        out = moved.select("u", F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``(node, root)`` of every node of the edges ``(a, b)``; ``root`` is the least node of its component.

    Each step is written to the shared folder, so lineage stays short and lost executors cost one step. The
    neighbours of a hub do not meet in one task (``hot_join``). Loops and repeated edges may occur; an empty
    table gives an empty result.
    """
    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
                now.select(F.col("v").alias("node"), F.col("v").alias("root"))
            ).distinct()
        before = state
        spread = written(_star(now, True, state[0]), "edges")
        drop(now)
        now = written(_star(spread, False, state[0]), "edges")
        drop(spread)
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
