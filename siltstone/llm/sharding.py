"""Operator 1, sharding: contiguous shards of near-equal bytes by a two-level prefix sum.

Rows are put in key order by a range partitioning, each partition's total is prefix-summed (one row a
partition), and a row's global byte offset is its partition's base plus the running sum inside the
partition.  A row belongs to the shard that holds the middle of its byte range, so every cut is at
most half a row away from its equal target.  No task sees more than one range partition; the ranges
are cut on (key, crc, row tag), so that a key that many rows share is split as well.

Defined cases: a null text has size 1 and a null crc; an empty text has size 1 and crc 0; null keys
sort first; repeated keys and repeated rows are ordered by crc and then by a row tag, each row gets a
slot of its own, and copies of a text may lie in different shards, as the law is `bytes` and the order
is the key's; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, read_table


def shard_by_bytes(df: DataFrame, n_shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot) for every row; shards are contiguous in key order."""
    spark = df.sparkSession
    sized = df.select(
        F.col(key).alias("k"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.encode(F.col(text), "UTF-8")).alias("crc"),
    ).withColumn("tag", F.monotonically_increasing_id())
    order = ["k", "crc", "tag"]
    ranged = materialise(
        sized.repartitionByRange(partitions(spark), *order).withColumn("part", F.spark_partition_id()), "sharding"
    )
    # one row a partition: the single-task window below is bounded by the number of partitions
    totals = ranged.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    bases = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("base_bytes"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("base_rows"),
        F.sum("part_bytes").over(everything).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        ranged.join(F.broadcast(bases), "part")
        .withColumn("start", F.col("base_bytes") + F.sum("size").over(inside) - F.col("size"))
        .withColumn("idx", F.col("base_rows") + F.count("*").over(inside) - 1)
        .withColumn("shard", F.expr(f"cast(((2 * start + size) * {n_shards}) div (2 * total) as int)"))
    )
    firsts = placed.groupBy("shard").agg(F.min("idx").alias("first_idx"))  # n_shards rows
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("idx") - F.col("first_idx")).alias("slot")
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7, law `bytes`."""
    out = shard_by_bytes(read_table(spark, sf_dir, "documents"), 8)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
