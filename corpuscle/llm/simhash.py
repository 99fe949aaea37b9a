"""SimHash near-duplicates through anchor points of a covering code.

Fingerprints have 64 bits and link at ``threshold`` differing bits or fewer. The bits are cut into
``BLOCKS`` of 21 (one is left over). Of at most ``threshold`` differences some block has
``t = threshold // BLOCKS`` at most. In a block, the anchors are the words of a covering code: a Hamming
(15, 11) code, whose covering radius is 1, beside 6 free bits. Each fingerprint goes to every anchor
within radius + t of its block. The anchor nearest to one fingerprint is within radius + t of any other
that differs in t bits, so each linked pair meets at an anchor. Fingerprints are compared there only;
an anchor passes on a spanning forest of its links, and components are joined from these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.session import ship

from .common import col, fresh, hot_join, written
from .components import connected_components

BLOCKS, BLOCK_BITS, HAMMING_BITS, FREE_BITS = 3, 21, 15, 6
RADIUS = 1


def words_of(text: str | None) -> list[bytes]:
    """A-Z in lower case, parted at the six ASCII blanks (bytes know no others)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(found: list[bytes], words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words`` words, repeats included; of all words where there are fewer."""
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    starts = np.cumsum(lengths + 1) - lengths - 1
    n = max(1, len(found) - words + 1)
    ends = (starts + lengths)[len(found) - n :]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends.tolist(), strict=True)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; 0 of none."""
    return int.from_bytes(np.packbits(_ones(hashes.astype(">u8")) * 2 > len(hashes)).tobytes(), "big") if len(hashes) else 0


def fingerprint(text: str | None, words: int = 4) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 without words."""
    return majority(shingle_hashes(words_of(text), words))


def _ones(hashes: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """How many hashes have each bit, in steps: memory stays small for very long texts."""
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), step):
        total += np.unpackbits(hashes[i : i + step].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return total


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def fingerprint_column(text: Column) -> Column:
    """The fingerprint as a long (the bits of the unsigned number)."""
    ship(SparkSession.active())
    return F.pandas_udf(_fingerprints, T.LongType())(text)


def _syndromes() -> np.ndarray:
    """Of each 15-bit word: the XOR of the 1-based places of its ones. Words of syndrome 0 are the code."""
    words, out = np.arange(1 << HAMMING_BITS), np.zeros(1 << HAMMING_BITS, dtype=np.int64)
    for place in range(HAMMING_BITS):
        out ^= np.where(words >> place & 1, place + 1, 0)
    return out


def anchor_patterns(reach: int) -> list[np.ndarray]:
    """By syndrome: what to XOR to a 21-bit block to get its anchors within ``reach`` bits."""
    words = np.arange(1 << HAMMING_BITS)
    syndromes, weights = _syndromes(), np.bitwise_count(words).astype(int)
    free = np.arange(1 << FREE_BITS)
    free_weights = np.bitwise_count(free).astype(int)
    out = []
    for s in range(HAMMING_BITS + 1):
        e = words[(syndromes == s) & (weights <= reach)]
        pairs = [(e[weights[e] + w <= reach, None] << FREE_BITS | free[free_weights == w][None, :]).ravel() for w in range(reach + 1)]
        out.append(np.concatenate(pairs).astype(np.int64))
    return out


def anchors(fingerprints: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """``(anchor, fingerprint)`` of every anchor that each uint64 fingerprint goes to."""
    patterns, syndromes = anchor_patterns(RADIUS + threshold // BLOCKS), _syndromes()
    at, of = [], []
    for b in range(BLOCKS):
        block = (fingerprints >> np.uint64(b * BLOCK_BITS)).astype(np.int64) & ((1 << BLOCK_BITS) - 1)
        s = syndromes[block >> FREE_BITS]
        for k, pattern in enumerate(patterns):
            mine = s == k
            at.append(((block[mine, None] ^ pattern[None, :]) | b << BLOCK_BITS).ravel())
            of.append(np.repeat(fingerprints[mine], len(pattern)))
    return np.concatenate(at), np.concatenate(of)


def forest(points: np.ndarray, threshold: int, dense: int = 512, step: int = 64, crowd: int = 4096, block: int | None = None) -> list[tuple[int, int]]:
    """Edges (least of component, other) of the components of one anchor's distinct uint64 fingerprints.

    Few points: all their distances at once. Many: breadth-first search that compares the frontier, in steps,
    with the points not yet reached, so a dense cluster costs little more than its size. More than ``crowd``: the
    bits outside the anchor's ``block`` are cut into one part more than there may be differences, so linked points
    agree in some part; points are searched among those that agree with them.
    """
    if len(points) < 2:
        return []
    if len(points) > crowd:
        edges = []
        for shift, mask in parts_of_bits(threshold + 1, block):
            part = points >> np.uint64(shift) & np.uint64(mask)
            order = np.argsort(part, kind="stable")
            for group in np.split(points[order], np.flatnonzero(np.diff(part[order])) + 1):
                edges += forest(group, threshold, dense, step, crowd=len(points))
        return _spanning(edges)
    if len(points) <= dense:
        near = np.bitwise_count(points[:, None] ^ points[None, :]) <= threshold
        if near.sum() == len(points):
            return []
        touched = near.sum(axis=1) > 1
        points = points[touched]
    points = np.sort(points)
    edges: list[tuple[int, int]] = []
    while len(points):
        root, points = points[0], points[1:]
        frontier, members = np.array([root], dtype=np.uint64), []
        while len(frontier) and len(points):
            now, frontier = frontier[:step], frontier[step:]
            hit = np.zeros(len(points), dtype=bool)
            for i in range(0, len(points), 1 << 16):
                hit[i : i + (1 << 16)] = (np.bitwise_count(now[:, None] ^ points[None, i : i + (1 << 16)]) <= threshold).any(axis=0)
            if hit.any():
                found, points = points[hit], points[~hit]
                members.append(found)
                frontier = np.concatenate([frontier, found])
        for found in members:
            edges += [(int(root), int(x)) for x in found]
    return edges


def parts_of_bits(n: int, block: int | None) -> list[tuple[int, int]]:
    """``(shift, mask)`` of ``n`` parts of the 64 bits; a part that spans ``block`` (its bits differ little) is cut there."""
    low, high = (0, 0) if block is None else (block * BLOCK_BITS, (block + 1) * BLOCK_BITS)
    free = [i for i in range(64) if not low <= i < high]
    out = []
    for k in range(n):
        mine = free[k * len(free) // n : (k + 1) * len(free) // n]
        out.append((mine[0], sum(1 << (i - mine[0]) for i in mine)))
    return out


def _spanning(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """``(least, other)`` of the edges' components, each node once."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        above[max(x, y)] = min(x, y)
    return [(r, x) for x in above if (r := root(x)) != x]


def links(fingerprints: DataFrame, threshold: int = 4, partitions: int | None = None) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of all pairs within ``threshold`` bits.

    ``fingerprints``: distinct longs in the column ``fp``. Exact for a threshold up to 5; more is refused,
    as the anchors within reach would be too many.
    """
    if not 0 <= threshold < 2 * BLOCKS:
        raise ValueError("the anchors are laid out for 0 to 5 differing bits")

    ship(fingerprints.sparkSession)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["fp"].to_numpy(dtype=np.int64).view(np.uint64)
            for i in range(0, len(values), 20_000):
                at, of = anchors(values[i : i + 20_000], threshold)
                yield pd.DataFrame({"anchor": at, "fp": of.view(np.int64)})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by anchor; one anchor's points may stretch over batches."""
        at, open_points = None, []

        def edges_of(groups: list[np.ndarray], places: list[int]) -> pd.DataFrame:
            found = [e for g, p in zip(groups, places, strict=True) for e in forest(g, threshold, block=p >> BLOCK_BITS)]
            found = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

        for batch in batches:
            if not len(batch):
                continue
            anchor, points = batch["anchor"].to_numpy(), batch["fp"].to_numpy(dtype=np.int64).view(np.uint64)
            borders = np.flatnonzero(np.diff(anchor)) + 1
            parts = np.split(points, borders)
            places = anchor[np.concatenate([[0], borders])].tolist()
            if at == places[0]:
                open_points.append(parts[0])
            else:
                if open_points:
                    yield edges_of([np.concatenate(open_points)], [at])
                open_points = [parts[0]]
            if len(parts) > 1:
                yield edges_of([np.concatenate(open_points), *parts[1:-1]], places[:-1])
                open_points = [parts[-1]]
            at = places[-1]
        if open_points:
            yield edges_of([np.concatenate(open_points)], [at])

    spread_out = fingerprints.select("fp").mapInPandas(spread, "anchor long, fp long")
    by_anchor = spread_out.repartition(partitions, "anchor") if partitions else spread_out.repartition("anchor")
    return by_anchor.sortWithinPartitions("anchor").mapInPandas(compare, "a long, b long").distinct()


def _hex(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(col(fp)), 16, "0"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: int = 4) -> DataFrame:
    """``docs`` with ``fingerprint`` (16 hex digits) and ``component_id``.

    Documents whose fingerprints differ in ``threshold`` bits or fewer are linked; ``component_id`` is the
    smallest ``key`` reachable by links, the document itself included. Null and empty texts have the
    fingerprint 0 and are linked like any others. A null key counts as larger than all others. Only distinct
    fingerprints are compared, so any number of exact copies costs one comparison. An empty table gives an
    empty result. Columns of ``docs`` with the two names are replaced.
    """
    docs = docs.drop("fingerprint", "component_id")
    kept = docs.columns
    (fp,) = fresh(docs, "fp")
    marked = written(docs.withColumn(fp, fingerprint_column(col(text))), "marked")
    classes = classes_of(marked.select(col(key).alias("id"), col(fp).alias("fp")), threshold)
    return hot_join(marked, classes.withColumnRenamed("fp", fp), fp, marked.count()).select(
        *[col(c) for c in kept], _hex(fp).alias("fingerprint"), "component_id"
    )


def classes_of(prints: DataFrame, threshold: int = 4) -> DataFrame:
    """``(fp, component, component_id, n)`` of each distinct fingerprint of ``(id, fp)`` rows.

    ``component`` is the component's least fingerprint, ``component_id`` its smallest id, ``n`` the rows of ``fp``. Null ids
    are larger than all others and a component of such rows alone has a null one; repeated rows count each; an empty table
    gives an empty result.
    """
    smallest = written(prints.groupBy("fp").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "simhash")
    found = connected_components(links(smallest, threshold))
    component = F.coalesce("root", "fp").alias("component")
    labelled = written(smallest.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "id", component, F.col("n").alias("rows")), "labelled")
    least = labelled.groupBy("component").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    return hot_join(labelled, least, "component", labelled.count()).select("fp", "component", "component_id", F.col("rows").alias("n"))


def simhash_report(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of all documents, a row per row.

    Null, empty and blank texts have fingerprint zero and are linked like any others; texts count whole, however long.
    Equal texts, repeated rows among them, are in one component. A null doc_id is never a component's smallest, unless
    there is no other. Other columns are left out, whatever their names; an empty table gives an empty result.
    """
    narrow = written(documents.select("doc_id", fingerprint_column(F.col("text")).alias("fp")), "fingerprints")
    classes = written(classes_of(narrow.withColumnRenamed("doc_id", "id")), "classes")
    return hot_join(narrow, classes, "fp", narrow.count()).select("doc_id", _hex("fp").alias("fingerprint"), "component_id")
