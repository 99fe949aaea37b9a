"""Merkle manifest of a dataset: a tree of SHA-256 digests per group of rows, a tree over the groups, a proof per row.

Leaves are digests of rows, in order of a key within their group; every eight consecutive nodes become the digest of
their joined hex texts until one is left. Positions come from one range sort of the leaves (no texts), so a group may
hold any share of the rows. Leaves are aligned into buckets of 8^4 positions; on the executors DuckDB runs the four
lowest levels of each bucket as queries (ordered ``string_agg``, ``sha256``) over its Arrow rows. Spark combines the
buckets' roots level by level, 4,096 times fewer rows than leaves, and joins each bucket with its outer proof, over
which DuckDB folds every leaf up to the root.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


from corpuscle.session import ship

from .common import col, drop, written

#: Children of a node; levels that a bucket has.
FANOUT, INNER = 8, 4
#: Offsets, proofs of groups and outer proofs are broadcast up to so many rows; beyond, they are joined by shuffle.
BROADCAST_ROWS = 5_000
DIGEST = 64


def leaf_digest(values: list[Column]) -> Column:
    """Hex SHA-256 of the values in order: ``-`` for null, else the UTF-8 length, ``:`` and the value as text."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*map(part, values)), 256)


def few(df: DataFrame) -> DataFrame:
    """``df``, broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def numbered(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """``rows`` with ``pos``, from 0 in each ``group`` (never null) by ``order``, and ``n``, the rows of the group; its tables.

    One range sort deals rows to tasks, so a group that holds most of them is split. Partition and number are written
    beside the rows; offsets need a row per group and partition. Rows that are equal in ``order`` come in any order.
    """
    sorted_rows = rows.withColumn("__u", F.monotonically_increasing_id()).orderBy(group, *order, "__u").drop("__u")
    dealt = written(sorted_rows.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()), "ordered")
    runs = dealt.groupBy(group, "__p").agg(F.count(F.lit(1)).alias("__n"), F.min("__i").alias("__first"))
    whole = Window.partitionBy(group)  # a row per partition
    starts = runs.select(
        group, "__p", "__first", (F.sum("__n").over(whole.orderBy("__p")) - F.col("__n")).alias("__start"), F.sum("__n").over(whole).alias("n")
    )
    starts = written(starts, "starts")
    placed = dealt.join(few(starts), [group, "__p"])
    return placed.withColumn("pos", F.col("__start") + F.col("__i") - F.col("__first")).drop("__p", "__i", "__first", "__start"), [dealt, starts]


_ITEMS = "array<struct<pos bigint, id string, leaf binary, claim binary>>"
_PATH = "array<struct<joined string, place int>>"


def _levels(inner: int) -> str:
    """CTEs l0, l1, ... of nodes and r0, r1, ... of joined runs; a group's single node stays as it is."""
    out = []
    for k in range(inner):
        out.append(f"r{k} AS (SELECT b, pos // {FANOUT} AS run, n, n > {FANOUT**k} AS live, string_agg(h, '' ORDER BY pos) AS joined FROM l{k} GROUP BY b, pos // {FANOUT}, n)")
        out.append(f"l{k + 1} AS (SELECT b, run AS pos, n, CASE WHEN live THEN sha256(joined) ELSE joined END AS h FROM r{k})")
    return ", ".join(out)


def _session():
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})


def _chunks(batch: pa.RecordBatch, leaves: int) -> Iterator[pa.Table]:
    """The batch's rows in tables of one bucket, or of several that have ``leaves`` together at most."""
    sizes = [len(x) for x in batch.column("items")]
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > leaves:
            yield pa.Table.from_batches([batch.slice(start, i - start)])
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield pa.Table.from_batches([batch.slice(start)])


def _roots(inner: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con = _session()
    for batch in batches:
        for chunk in _chunks(batch, FANOUT**inner):
            con.register("chunk", chunk)
            made = con.sql(f"""
                WITH told AS (SELECT row_number() OVER () AS b, grp, bucket, n, items FROM chunk),
                l0 AS (SELECT b, n, i.pos AS pos, lower(hex(i.leaf)) AS h FROM (SELECT b, n, unnest(items) AS i FROM told)), {_levels(inner)}
                SELECT grp, bucket, h FROM l{inner} JOIN told USING (b)""").to_arrow_table()
            con.unregister("chunk")
            yield from made.to_batches()


def _proofs(inner: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con = _session()
    for batch in batches:
        for chunk in _chunks(batch, FANOUT**inner):
            con.register("chunk", chunk)
            outer = max((len(x) for x in chunk.column("path") if x.is_valid), default=0)
            steps = [f"""s0 AS (SELECT told.b, path, pos // {FANOUT} AS run, pos % {FANOUT} AS place, id, h AS leaf, claim AS folded, '' AS siblings
                FROM told JOIN l0 USING (b))"""]
            for k in range(inner):
                left, right = f"substr(joined, 1, {DIGEST} * place::INT)", f"substr(joined, {DIGEST} * place::INT + {DIGEST + 1})"
                steps.append(f"""s{k + 1} AS (SELECT b, path, run // {FANOUT} AS run, run % {FANOUT} AS place, id, leaf,
                    CASE WHEN live THEN sha256({left} || folded || {right}) ELSE folded END AS folded,
                    CASE WHEN live THEN siblings || {left} || {right} ELSE siblings END AS siblings
                    FROM s{k} JOIN r{k} USING (b, run))""")
            for k in range(outer):
                left, right = (f"substr(path[{k + 1}].joined, {part}" for part in (f"1, {DIGEST} * path[{k + 1}].place)", f"{DIGEST} * path[{k + 1}].place + {DIGEST + 1})"))
                at = inner + k
                steps.append(f"""s{at + 1} AS (SELECT b, path, id, leaf,
                    CASE WHEN len(path) > {k} THEN sha256({left} || folded || {right}) ELSE folded END AS folded,
                    CASE WHEN len(path) > {k} THEN siblings || {left} || {right} ELSE siblings END AS siblings FROM s{at})""")
            made = con.sql(f"""
                WITH told AS (SELECT row_number() OVER () AS b, n, items, coalesce(path, []) AS path, subroot, root FROM chunk),
                l0 AS (SELECT b, n, i.pos AS pos, i.id AS id, lower(hex(i.leaf)) AS h, lower(hex(i.claim)) AS claim FROM (SELECT b, n, unnest(items) AS i FROM told)),
                {_levels(inner)}, {", ".join(steps)}
                SELECT id, leaf, subroot, root, siblings, sha256(siblings) AS proof_sha256, folded AS folded_root FROM s{inner + outer} JOIN told USING (b)""").to_arrow_table()
            con.unregister("chunk")
            yield from made.to_batches()


def _combine(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trees over ``(grp, node, h)``, nodes numbered from 0 in each group: ``(grp, h)`` of the roots, ``(grp, node, path)``.

    ``path`` holds, from the node up, the joined digests of its run and its place in that. Each level is a table.
    """
    sizes = nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    levels, most = [written(nodes.join(few(sizes), "grp"), "level")], sizes.agg(F.max("n")).first()[0] or 0
    runs = []
    while most > 1:
        own = F.array_sort(F.collect_list(F.struct("node", "h")))  # eight at most
        grouped = levels[-1].groupBy("grp", F.expr(f"node div {FANOUT}").alias("run"), "n").agg(own.alias("own"))
        runs.append(written(grouped.select("grp", "run", "n", F.array_join(F.transform("own", lambda x: x["h"]), "").alias("joined")), "runs"))
        up = F.when(F.col("n") > 1, F.sha2("joined", 256)).otherwise(F.col("joined"))
        levels.append(runs[-1].select("grp", F.col("run").alias("node"), up.alias("h"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n")))
        most = -(-most // FANOUT)
    paths = levels[-1].select("grp", "node", F.array().cast(_PATH).alias("path"))
    for level, run in zip(reversed(levels[:-1]), reversed(runs), strict=True):
        above = run.join(paths.withColumnRenamed("node", "run"), ["grp", "run"]).select("grp", "run", "joined", "path")
        here = level.select("grp", "node", "n", F.expr(f"node div {FANOUT}").alias("run")).join(above, ["grp", "run"])
        step = F.array(F.struct("joined", F.expr(f"int(node % {FANOUT})").alias("place"))).cast(_PATH)
        paths = here.select("grp", "node", F.when(F.col("n") > 1, F.concat(step, "path")).otherwise(F.col("path")).alias("path"))
    return levels[-1].select("grp", "h"), paths


def prove(leaves: DataFrame, inner: int = INNER) -> tuple[DataFrame, DataFrame]:
    """Of ``(id, grp, leaf, claim)``, digests as binary, ``grp`` a text by whose bytes groups are ordered:

    ``(id, leaf, subroot, root, siblings, proof_sha256, folded_root)`` of each row, and the manifest ``(grp, n, subroot,
    root)``. Rows of a group are ordered by id (null first), then by leaf. ``siblings`` is the proof: the digests beside
    the leaf's way to the root, in order, level by level; ``folded_root`` is what ``claim`` leads to with them. A bucket has
    ``FANOUT ** inner`` leaves.
    """
    ship(leaves.sparkSession)
    placed, made = numbered(leaves, "grp", ["id", "leaf"])
    item = F.struct("pos", F.col("id").cast("string").alias("id"), "leaf", "claim")
    grouped = placed.groupBy("grp", F.expr(f"pos div {FANOUT**inner}").alias("bucket"), "n").agg(F.collect_list(item).cast(_ITEMS).alias("items"))
    buckets = written(grouped, "buckets")
    drop(*made)
    nodes = buckets.select("grp", "bucket", "n", "items").mapInArrow(partial(_roots, inner), "grp string, bucket long, h string")
    subroots, within = _combine(nodes.withColumnRenamed("bucket", "node"))
    subroots = subroots.withColumnRenamed("grp", "name").withColumn("grp", F.lit(""))
    placed, made = numbered(subroots, "grp", ["name"])
    placed_roots = written(placed.select("grp", "name", F.col("pos").alias("node"), "h"), "subroots")
    drop(*made)
    roots, outer = _combine(placed_roots.select("grp", "node", "h"))
    root = roots.select(F.col("h").alias("root"))  # a row
    tops = placed_roots.join(few(outer), ["grp", "node"]).select(F.col("name").alias("grp"), F.col("h").alias("subroot"), F.col("path").alias("above"))
    tops = written(tops.join(F.broadcast(root), how="cross"), "tops")
    paths = within.join(few(tops), "grp").select("grp", F.col("node").alias("bucket"), F.concat("path", "above").alias("path"), "subroot", "root")
    paths = written(paths, "paths")
    made = buckets.join(few(paths), ["grp", "bucket"]).select("items", "n", "path", "subroot", "root")
    proofs = made.mapInArrow(partial(_proofs, inner), "id string, leaf string, subroot string, root string, siblings string, proof_sha256 string, folded_root string")
    sizes = buckets.groupBy("grp").agg(F.max("n").alias("n"))
    return proofs.withColumn("id", F.col("id").cast(leaves.schema["id"].dataType)), sizes.join(tops.select("grp", "subroot", "root"), "grp")


def group_text(value: Column) -> Column:
    """A group's name whose bytes sort as the value's, null first; empty is not null."""
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), value.cast("string")))


def leaves_of(docs: DataFrame, key: str, group: str, columns: list[str], claimed: dict[str, Column] | None = None) -> DataFrame:
    """``(id, grp, leaf, claim)``: digests of ``columns``, and of these with the ``claimed`` ones in their place. A table."""
    own = leaf_digest([col(c) for c in columns])
    other = leaf_digest([(claimed or {}).get(c, col(c)) for c in columns])
    return written(docs.select(col(key).alias("id"), group_text(col(group)).alias("grp"), F.unhex(own).alias("leaf"), F.unhex(other).alias("claim")), "leaves")


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def merkle_digest(docs: DataFrame, inner: int = INNER) -> DataFrame:
    """The documents' proofs by language, and which of them hold after a third of the texts was put in lower case.

    ``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)``, a row per row. Nulls in any column are
    values of their own (``-``), other than empty texts; a null language is a group, the first, and a null doc_id comes
    first and is not tampered with. Texts count whole. Repeated rows have a leaf each; rows of one doc_id are ordered by
    their digests. A single row is its own subroot and root, its proof that of no siblings. Other columns are left out,
    whatever their names. An empty table gives an empty result.
    """
    hit = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 == 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tampered = {"text": F.when(hit, F.translate("text", upper, lower)).otherwise(F.col("text"))}
    leaves = leaves_of(docs.select(*COLUMNS), "doc_id", "lang", COLUMNS, tampered)
    proofs, _ = prove(leaves, inner)
    drop(leaves)
    out = proofs.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
