"""Running totals over a whole table in an order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.session import written


def accumulate(rows: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """``rows`` with ``place``, from 0 by ``order``, and running sums ``{name: column}`` up to and including each row.

    One range sort, whose partitions and numbers are written beside the rows; each partition sums up its own, and
    offsets need a row per partition. Rows equal in ``order`` come in any order, so let it be unique. Not null.
    """
    sorted_rows = rows.orderBy(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    dealt = written(sorted_rows, "ordered")
    own = Window.partitionBy("__p").orderBy("__i")
    within = dealt.withColumn("place", F.row_number().over(own) - F.lit(1).cast("long"))
    within = within.withColumns({name: F.sum(column).over(own) for name, column in sums.items()})
    parts = dealt.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(f"__{name}") for name, c in sums.items()])
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = parts.select("__p", *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in ["n", *sums]])
    placed = within.join(F.broadcast(offsets), "__p")
    totals = {name: F.col(name) + F.col(f"__{name}") for name in sums}
    return placed.withColumns({"place": F.col("place") + F.col("__n"), **totals}).select(*rows.columns, "place", *sums)
