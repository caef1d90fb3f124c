"""Running sums over a global order without a one-partition window.

Rows are range-partitioned in the order, each partition's total is prefix-summed (a row a partition), and
a row's sum is its partition's base plus the running sum inside the partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise, partitions


def running(df: DataFrame, order: list[str], size: str, offset: str = "packed_offset", ordinal: str = "layout_ord") -> DataFrame:
    """Adds the exclusive running sum of `size` and the row's number, both in `order` (which must be unique)."""
    spread = df.repartitionByRange(partitions(df.sparkSession), *order).withColumn("_part", F.spark_partition_id())
    spread = materialise(spread, "prefix")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    totals = spread.groupBy("_part").agg(F.sum(size).alias("s"), F.count("*").alias("n"))
    bases = totals.select("_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(b) for c, b in (("s", "_base"), ("n", "_rows"))])
    inside = Window.partitionBy("_part").orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    return (
        spread.join(F.broadcast(bases), "_part")
        .withColumn(offset, (F.col("_base") + F.sum(size).over(so_far) - F.col(size)).cast("long"))
        .withColumn(ordinal, (F.col("_rows") + F.row_number().over(inside) - 1).cast("long"))
        .drop("_part", "_base", "_rows")
    )
