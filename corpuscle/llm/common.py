"""What the training-data operators share: names, row keys, joins of hot keys and the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.session import drop, save, shared_dir, written

__all__ = ["col", "drop", "fresh", "hot_join", "let", "row_key", "rows_of", "save", "shared_dir", "table", "written"]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """One column name per given name that no column of ``df`` has (Spark compares them without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        tried = f"__{name}"
        while tried.lower() in taken:
            tried += "_"
        taken.add(tried.lower())
        out.append(tried)
    return out


def col(name: str) -> Column:
    """The column of this very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_key(df: DataFrame) -> Column:
    """A 64-bit hash of all columns that can be hashed; equal rows have equal keys."""
    able = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return F.xxhash64(*[col(c) for c in able]) if able else F.lit(0).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_of(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame(rows, schema)


#: A key counts as hot beyond this share of all rows, so there are fewer hot keys than HOT_KEYS.
HOT_KEYS, LIGHT = 100_000, 1_000


def hot_join(rows: DataFrame, facts: DataFrame, on: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``facts``, which has one row per ``on`` and ``n``, the number of rows with it.

    ``total``: the number of rows, or more. Keys with over max(LIGHT, total / HOT_KEYS) rows are fewer than HOT_KEYS:
    theirs are broadcast. The rest is joined by shuffle, where no key brings more rows than that. ``rows`` is read
    twice, so it should be a table.
    """
    most = max(LIGHT, total // HOT_KEYS)
    hot, cold = facts.where(F.col("n") > most).drop("n"), facts.where(F.col("n") <= most).drop("n")
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(cold, on))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]
