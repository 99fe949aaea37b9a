"""Near copies: groups of texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from SimHash: fingerprints of the five-word shingles, linked through the anchors of the covering
code (``simhash.links``). The similarity of the whole sets decides on each. At 0.8 two fingerprints differ in some
ten bits, more than anchors can cover at a bearable number, so an exact prefix join supplies the pairs that the
radius does not reach. Of two sets so alike, each shares four fifths of its shingles with the other, so under any
common order of shingles their prefixes (a fifth of the set and one more) meet in some shingle. The order puts
rare ones first: what is common in a sample of texts comes last. The sample bears on the work only, not on the
pairs. Sizes and places in the order discard what cannot reach the threshold. A shingle's texts are first compared
with its smallest and with their neighbours by size, in salted parts; all further pairs only where the links found
so far do not join them, so a dense group costs little more than its size. Of these, 256 parities of each set give a
lower bound of the number of shingles that only one of two has, and the 256 counts behind them a better one: these
discard most pairs before sets are compared.
"""

from __future__ import annotations

import operator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.session import ship

from .common import col, drop, fresh, hot_join, row_key, written
from .components import connected_components
from .simhash import links, majority, shingle_hashes, words_of

WORDS = 5
#: Common shingles that are told to all tasks, from one text in SAMPLE.
MOST_COMMON, SAMPLE, COMMON_FROM = 50_000, 16, 3
#: Keys of the texts in question are broadcast up to so many; beyond, they are joined by shuffle.
BROADCAST_ROWS = 500_000
#: So many of a shingle's texts are taken together; more are parted by salts.
TOGETHER = 2_000


def shingles(found: list[bytes], words: int = WORDS) -> np.ndarray:
    """The distinct word shingles in the order of their numbers; fewer words than that are one shingle."""
    return np.unique(shingle_hashes(found, words).view(np.int64))


def prefix(own: np.ndarray, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order (times among the ``common``, number), as many as the threshold needs."""
    rank = np.zeros(len(own), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        rank = np.where(common[at] == own, times[at], 0)
    return own[np.lexsort((own, rank))][: len(own) - -(-4 * len(own) // 5) + 1 if len(own) else 0]


def _all_shingles(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles(words_of(t)) for t in texts], dtype=object)


def _shingle_column(text: Column) -> Column:
    return F.pandas_udf(_all_shingles, "array<long>")(text)


def _common(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    some = docs.where(F.pmod(F.xxhash64(col(text)), F.lit(SAMPLE)) == 0).select(F.explode(_shingle_column(col(text))).alias("s"))
    counted = some.groupBy("s").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= COMMON_FROM)
    found = counted.orderBy(F.desc("times"), "s").limit(MOST_COMMON).toArrow()
    s, times = found["s"].to_numpy(), found["times"].to_numpy()
    order = np.argsort(s)
    return s[order], times[order]


def _may_reach(x: str, y: str) -> Column:
    """Whether two sets that meet at these places of their orders can share enough: 9 * shared >= 4 * (sizes)."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    shared = F.lit(1) + F.least(n - F.col(f"{x}.pos"), m - F.col(f"{y}.pos")) - 1
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * shared >= 4 * (n + m))


#: A set's counts: how many of its shingles have each value of eight of their bits. Its parities: these modulo 2.
PARITIES = 256
BITS = ["p0", "p1", "p2", "p3"]
#: Pairs whose counts are compared at once: their bytes, not numbers of eight times that.
HELD_PAIRS = 1_024


def counts(own: np.ndarray) -> np.ndarray:
    return np.bincount((own >> 20 & PARITIES - 1).astype(np.int64), minlength=PARITIES)


def parities(own: np.ndarray) -> list[int]:
    """PARITIES bits in four longs. Two sets differ in at least as many elements as their parities do in bits."""
    return np.packbits((counts(own) & 1).astype(np.uint8)).view(">i8").tolist()


def packed(own: np.ndarray) -> bytes:
    """The counts, a byte each, 255 standing for more. Two sets differ in at least as many elements as these sum up to."""
    return np.minimum(counts(own), 255).astype(np.uint8).tobytes()


def differences(x: pd.Series, y: pd.Series) -> pd.Series:
    """The sum of the differences of two sets' packed counts."""
    found = np.empty(len(x), dtype=np.int64)
    for i in range(0, len(x), HELD_PAIRS):
        a, b = (np.frombuffer(b"".join(s.iloc[i : i + HELD_PAIRS]), dtype=np.uint8).reshape(-1, PARITIES) for s in (x, y))
        found[i : i + HELD_PAIRS] = (np.maximum(a, b) - np.minimum(a, b)).sum(axis=1)
    return pd.Series(found)


def _may_be_alike(x: str, y: str) -> Column:
    """Whether parities leave it open that two sets share enough: they may differ in a ninth of their sizes."""
    differ = reduce(operator.add, [F.bit_count(F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}"))) for p in BITS])
    return 9 * differ <= F.col(f"{x}.n") + F.col(f"{y}.n")


def _pair(x: str, y: str) -> list[Column]:
    a, b = F.col(f"{x}.key"), F.col(f"{y}.key")
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _verified(pairs: DataFrame, texts: DataFrame, best: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose whole sets reach the threshold; sets are made of the texts in question only.

    Counts discard pairs first: sets at the threshold differ in a ninth of their sizes at most.
    """
    x, y = (best.select(F.col("key").alias(k), F.col("n").alias(f"n_{k}"), F.col("counts").alias(f"counts_{k}")) for k in "ab")
    differ = F.pandas_udf(differences, "long")("counts_a", "counts_b")
    pairs = written(pairs.join(x, "a").join(y, "b").where(9 * differ <= F.col("n_a") + F.col("n_b")).select("a", "b"), "close")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    asked = written(best.join(asked, "key").select("key", F.col("first.row").alias("row")), "asked")
    rows = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
    sets = written(texts.join(rows, "row").dropDuplicates(["key"]).select("key", _shingle_column(F.col("text")).alias("own")), "sets")
    x, y = sets.select(F.col("key").alias("a"), F.col("own").alias("x")), sets.select(F.col("key").alias("b"), F.col("own").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    alike = written(pairs.join(x, "a").join(y, "b").where(9 * shared >= 4 * (F.size("x") + F.size("y"))).select("a", "b"), "links")
    drop(pairs, asked, sets)
    return alike


def _labelled(met: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of shingles whose texts are not all in one component yet, with the component and the shingle's rows.

    ``texts``: the component, as label, and the parities of each key.
    """
    with_all = F.struct("x.*", *BITS).alias("x")
    labelled = written(met.select("s", "x", F.col("x.key").alias("key")).join(texts, "key").select("s", with_all, "label"), "labelled")
    spread = labelled.groupBy("s").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("n"))
    spread = spread.where("least <> most").select("s", "n", F.col("n").alias("size"))
    apart = written(hot_join(labelled, spread, "s", labelled.count()), "apart")
    drop(labelled)
    return apart


def _few(rows: DataFrame) -> DataFrame:
    """Row hashes, broadcast if there are counted few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _salts(size: str) -> Column:
    return F.ceil(F.col(size) / TOGETHER).cast("long")


def _salted(rows: DataFrame) -> DataFrame:
    """Rows ``(s, x, size)`` with ``salt``, of which a shingle has as many as its ``size`` needs."""
    return rows.withColumn("salt", F.pmod(F.xxhash64("x.key"), _salts("size")))


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One document of each group of near copies, with its columns as they are: that with the smallest ``key``.

    Groups are the components of all pairs at the threshold. Texts of equal words (case and blanks aside) are
    one; null and blank texts are one another's copies. Null keys come last; of rows of equal key and text, the one
    whose columns have the least hash stays. Texts count whole, however long, and are not shuffled: what stays is told by
    row hashes. Other columns may have any name. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    row, rank = fresh(docs, "row", "rank")
    row_of = F.xxhash64(col(key), col(text))
    common = docs.sparkSession.sparkContext.broadcast(_common(docs, text))  # MOST_COMMON pairs of numbers

    def mark(texts: pd.Series) -> pd.DataFrame:
        keys, sizes, firsts, prints, odd, times = [], [], [], [], [], []
        for t in texts:
            found = words_of(t)
            hashes = shingle_hashes(found, WORDS)
            own = np.unique(hashes.view(np.int64))
            keys.append(xxhash.xxh64_intdigest(b" ".join(found), 7))
            sizes.append(len(own))
            firsts.append(prefix(own, *common.value))
            prints.append(majority(hashes))
            odd.append(parities(own))
            times.append(packed(own))
        signed = lambda v: np.array(v, dtype=np.uint64).view(np.int64)
        made = pd.DataFrame({"key": signed(keys), "n": np.array(sizes, dtype=np.int64), "first": pd.Series(firsts, dtype=object), "fp": signed(prints), "counts": pd.Series(times, dtype=object)})
        return made.assign(**dict(zip(BITS, np.array(odd, dtype=np.int64).reshape(-1, len(BITS)).T, strict=True)))

    marked = F.pandas_udf(mark, ", ".join(["key long, n long, first array<long>, fp long, counts binary", *(f"{p} long" for p in BITS)]))(col(text))
    narrow = written(docs.select(col(key).alias("id"), row_of.alias("row"), F.monotonically_increasing_id().alias("at"), marked.alias("m")), "shingles")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", "at")).alias("first")
    best = written(narrow.groupBy(F.col("m.key").alias("key")).agg(first, *[F.first(f"m.{c}").alias(c) for c in ("n", "fp", "counts", *BITS)]), "copies")

    prints = written(best.groupBy("fp").agg(F.min("key").alias("of"), F.count(F.lit(1)).alias("n")), "prints")
    a, b = (prints.select(F.col("fp").alias(x), F.col("of").alias(f"{x}_of")) for x in "ab")
    linked = links(prints).join(a, "a").join(b, "b").select(*[f("a_of", "b_of").alias(x) for f, x in ((F.least, "a"), (F.greatest, "b"))])
    same = hot_join(best.select("fp", "key"), prints, "fp", best.count()).where("key <> of")
    same = same.select(F.least("of", "key").alias("a"), F.greatest("of", "key").alias("b"))

    twice = written(narrow.groupBy("row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("row").alias(row)), "twice")
    once = narrow.join(best.select(F.col("first.at").alias("at")), "at", "left_semi")
    places = written(once.select(F.posexplode("m.first").alias("pos", "s"), F.col("m.key").alias("key"), F.col("m.n").alias("own")), "places")
    drop(narrow)
    shared = places.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1")  # a key has a shingle once
    met = hot_join(places, shared.select("s", "n", F.col("n").alias("size")), "s", places.count())
    met = written(met.select("s", F.struct("key", F.col("own").alias("n"), "pos").alias("x"), "size"), "met")
    drop(places)

    part = Window.partitionBy("s", "salt")
    by_size = part.orderBy("x.n", "x.key")
    beside = _salted(met).select("x", F.lag("x").over(by_size).alias("before"), F.first("x").over(by_size).alias("hub"))
    near = beside.where("before is not null").select("x", F.explode(F.array("before", "hub")).alias("y"))
    hubs = _salted(met.where(F.col("size") > TOGETHER)).groupBy("s", "salt").agg(F.min(F.struct("x.n", "x.key", "x")).alias("hub"))
    hubs = hubs.select("s", F.col("hub.x").alias("x"), F.min("hub").over(Window.partitionBy("s"))["x"].alias("y"))  # a row per salt
    near = near.unionByName(hubs.where("x.key <> y.key").select("x", "y"))
    tried = near.where(_may_reach("x", "y")).select(*_pair("x", "y"))
    tried = written(tried.unionByName(linked).unionByName(same).distinct(), "tried")

    texts = docs.select(row_of.alias("row"), col(text).alias("text"))
    alike = _verified(tried, texts, best)
    found = connected_components(alike).select(F.col("node").alias("key"), "root")
    apart = _labelled(met, best.join(found, "key", "left").select("key", F.coalesce("root", "key").alias("label"), *BITS))
    drop(met)
    x = _salted(apart).alias("p")
    y = apart.withColumnsRenamed({"x": "y", "label": "other"}).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), _salts("size") - 1))).alias("q")
    left = x.join(y, ["s", "salt"]).where((F.col("x.key") < F.col("y.key")) & (F.col("label") != F.col("other")) & _may_reach("x", "y") & _may_be_alike("x", "y"))
    more = written(left.select(*_pair("x", "y")).distinct().join(tried, ["a", "b"], "left_anti"), "more")
    drop(apart, tried)
    every = alike.unionByName(_verified(more, texts, best))

    found = connected_components(every).select(F.col("node").alias("key"), "root")
    kept = best.join(found, "key", "left").groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("first").alias("first"))
    kept = written(kept.select(F.col("first.row").alias(row)), "kept")
    some = docs.withColumn(row, row_of).join(_few(kept), row, "left_semi")
    if twice.isEmpty():
        return some.drop(row)
    order = Window.partitionBy(row).orderBy(row_key(docs))
    again = some.join(_few(twice), row, "left_semi").withColumn(rank, F.row_number().over(order)).where(col(rank) == 1).drop(rank)
    return some.join(_few(twice), row, "left_anti").unionByName(again).drop(row)
