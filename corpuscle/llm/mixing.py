"""Temperature mixing of sources, realised as budgeted block permutations.

Source token shares are raised to an exponent, which is bisected to meet a target entropy within a
repetition limit. A source's quota is then laid out in passes over its documents. Each pass visits the
source's hash blocks in a permuted order; the last pass stops in the block, and at the document, where
the quota is reached. Each document's number of copies follows from a few numbers per source, so no
text is shuffled.
"""

from __future__ import annotations

import math
import random as stdlib_random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, fresh, rows_of, written


#: Tables with a row a source are broadcast up to so many sources; beyond, they are joined by shuffle.
BROADCAST_SOURCES = 100_000


def temperature_weights(tokens: list[int], alpha: float) -> list[float]:
    """Shares to the power ``alpha``, normalised; sources without tokens get 0."""
    most = max(tokens, default=0)
    raised = [math.exp(alpha * math.log(t / most)) if t else 0.0 for t in tokens]
    total = math.fsum(raised)
    return [r / total for r in raised] if total else raised


def entropy(weights: list[float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights if w > 0)


def _bisect(holds, low: float, high: float) -> float:
    """The border of a property that holds at ``low`` and not at ``high``, on the side where it holds."""
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if holds(middle) else (low, middle)
    return low


def fit_exponent(tokens: list[int], budget: int, target_entropy: float = 0.95, max_repeat: float = 4.0) -> float:
    """The exponent in [0, 1] that meets ``target_entropy`` (as a share of the log of the number of sources).

    The largest exponent with at least that entropy is taken, but none so small that a source would be
    repeated more than ``max_repeat`` times within ``budget`` tokens.
    """
    live = [t for t in tokens if t]
    if not live:
        return 1.0
    if budget > max_repeat * sum(live) * (1 + 1e-12):
        raise ValueError("the budget needs more repetition than max_repeat even at the sources' own shares")
    flat_enough = lambda a: entropy(temperature_weights(live, a)) >= target_entropy * math.log(len(live)) - 1e-12
    by_entropy = 1.0 if flat_enough(1.0) else _bisect(flat_enough, 0.0, 1.0)
    repeats = lambda a: max(w * budget / t for w, t in zip(temperature_weights(live, a), live, strict=True))
    fits = lambda a: repeats(a) <= max_repeat * (1 + 1e-12)
    by_repeats = 0.0 if fits(0.0) else 1.0 - _bisect(lambda x: fits(1.0 - x), 0.0, 1.0)
    return max(by_entropy, by_repeats)


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    budget_ratio: float = 1.0,
    target_entropy: float = 0.95,
    max_repeat: float = 4.0,
    docs_per_block: int = 256,
    max_blocks: int = 65536,
    max_sources: int = 1_000_000,
    seed: int = 1,
) -> DataFrame:
    """``docs``, each row once per copy, plus mix_tokens, mix_copy, mix_block and mix_position.

    A document counts its white-space words plus one for its end, so null and empty texts count 1. A null
    source is a source of its own. The budget is ``budget_ratio`` times all tokens. A source gets its
    weight's share of it: whole passes, then part of one, which ends with the document that reaches the
    quota, so a source exceeds its quota by less than that document (and its equals: rows of equal key
    and text go together). ``mix_position`` in [0, 1) orders the stream so that every stretch of it holds
    the sources at their weights. Texts count whole; null keys and texts are values like others. ``max_sources`` bounds what the driver holds; more raise ValueError.
    An empty table gives an empty result. Columns of ``docs`` with the four names are replaced.
    """
    docs = docs.drop("mix_tokens", "mix_copy", "mix_block", "mix_position")
    spark, kept = docs.sparkSession, docs.columns
    tok, src, hash_, block, blocks, factor, shift, copies, rank, cut, cut_hash, passes, copy, rest, times, cut_src = fresh(
        docs, "tok", "src", "hash", "block", "blocks", "factor", "shift", "copies", "rank", "cut", "cut_hash", "passes", "copy", "rest", "times", "cut_src"
    )
    tokens_of = F.coalesce(F.regexp_count(col(text), F.lit(r"\S+")), F.lit(0)).cast("long") + 1
    hash_of = F.xxhash64(F.lit(seed), col(key), col(text))
    narrow = written(docs.select(col(source).alias(src), tokens_of.alias(tok), hash_of.alias(hash_)), "mix")
    totals = narrow.groupBy(src).agg(F.sum(tok).alias("t"), F.count(F.lit(1)).alias("n")).limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    totals = sorted(totals, key=lambda r: (r[0] is None, str(r[0])))
    tokens = [r["t"] for r in totals]
    budget = int(budget_ratio * sum(tokens))
    weights = temperature_weights(tokens, fit_exponent(tokens, budget, target_entropy, max_repeat))
    rng, plan = stdlib_random.Random(seed), []
    for r, w in zip(totals, weights, strict=True):
        quota = w * budget
        whole = min(int(quota // r["t"]), math.ceil(max_repeat))
        n_blocks = max(1, min(max_blocks, math.ceil(r["n"] / docs_per_block)))
        a = rng.randrange(1, n_blocks + 1)
        while math.gcd(a, n_blocks) != 1:
            a = rng.randrange(1, n_blocks + 1)
        plan.append((r[0], n_blocks, a, rng.randrange(n_blocks), whole, quota - whole * r["t"], quota / r["t"]))
    kind = docs.schema[source].dataType.simpleString()
    schema = f"{src} {kind}, {blocks} bigint, {factor} bigint, {shift} bigint, {passes} int, {rest} double, {times} double"
    few = F.broadcast if len(plan) <= BROADCAST_SOURCES else lambda df: df  # each table below has a row a source at most
    per_source = few(rows_of(spark, plan, schema))

    def order_in_pass(number):
        """A permutation of the source's blocks, another in each pass."""
        return F.pmod(col(block) * col(factor) + col(shift) * (number + 1), col(blocks))

    def in_last_pass(df, source_column):
        joined = df.join(per_source.withColumnRenamed(src, cut_src), col(source_column).eqNullSafe(col(cut_src))).drop(cut_src)
        return joined.withColumn(block, F.pmod(F.xxhash64(col(hash_)), col(blocks))).withColumn(rank, order_in_pass(col(passes)))

    last = in_last_pass(narrow, src)
    sums = last.groupBy(src, rank).agg(F.sum(tok).alias("t"), F.first(rest).alias("rest"))
    border = (
        sums.withColumn("before", F.sum("t").over(Window.partitionBy(src).orderBy(rank)) - F.col("t"))
        .where("before < rest and before + t >= rest")
        .select(col(src).alias(cut_src), col(rank).alias(cut), (F.col("rest") - F.col("before")).alias("needed"))
    )
    # no row where the last pass takes nothing
    inside = last.join(few(border), col(src).eqNullSafe(col(cut_src)) & (col(rank) == col(cut)))
    in_block = Window.partitionBy(src).orderBy(hash_)
    ends = (
        inside.groupBy(src, cut, hash_)
        .agg(F.sum(tok).alias("t"), F.first("needed").alias("needed"))
        .withColumn("before", F.sum("t").over(in_block) - F.col("t"))
        .where("before < needed")
        .groupBy(col(src).alias(cut_src))
        .agg(F.max(cut).alias(cut), F.max(hash_).alias(cut_hash))
    )
    in_rest = (col(rank) < col(cut)) | ((col(rank) == col(cut)) & (col(hash_) <= col(cut_hash)))
    chosen = (
        in_last_pass(docs.withColumn(hash_, hash_of).withColumn(tok, tokens_of), source)
        .join(few(ends), col(source).eqNullSafe(col(cut_src)), "left")
        .withColumn(copies, col(passes) + F.coalesce(in_rest.cast("int"), F.lit(0)))
        .where(col(copies) > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(0), col(copies) - 1)))
        .withColumn(rank, order_in_pass(col(copy)))
    )
    within = F.pmod(F.xxhash64(col(hash_), col(copy)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    position = (col(copy) + (col(rank) + within) / col(blocks)) / col(times)
    return chosen.select(
        *[col(c) for c in kept],
        col(tok).alias("mix_tokens"),
        col(copy).alias("mix_copy"),
        col(rank).alias("mix_block"),
        F.least(position, F.lit(1.0)).alias("mix_position"),
    )


def mix_report(documents: DataFrame) -> DataFrame:
    """The mixed stream of all documents without their texts: a row per document and copy.

    Null and empty texts count one token, texts count whole; a null source is one of its own, a null doc_id a value like
    others. Repeated rows are taken together. Other columns are left out, whatever their names; an empty table gives
    an empty result.
    """
    return mix(documents).select("doc_id", "source", "mix_tokens", "mix_copy", "mix_block", "mix_position")
