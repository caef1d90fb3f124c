"""Incremental ingest: chunks of arriving files against a growing index of hashes.

Structured Streaming keeps the index as the state of dropDuplicates on the hash: without a
watermark it grows with the number of distinct chunks, which is what a duplicate index must do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunk import chunk
from ..plans.storage import fresh_path
from ..sources import payloads


def stream_files(spark: SparkSession, folder: str, like: DataFrame, key: str, payload: str) -> DataFrame:
    """New Parquet files in a folder as `files`; a single file is watched by its name in its folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    reader = spark.readStream.schema(like.schema)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        folder, _, name = folder.rpartition("/")
        reader = reader.option("pathGlobFilter", name)
    return payloads.from_table(reader.parquet(folder), key, payload)


def first_seen(files: DataFrame, method: str = "ae") -> DataFrame:
    """One row for each hash when it first arrives."""
    return chunk(files, method).dropDuplicates(["chunk_hash"])


def ingest_available(spark: SparkSession, folder: str, like: DataFrame, key: str, payload: str, method: str = "ae") -> DataFrame:
    """Run all that is there through the index and return the hashes it took in."""
    out, state = fresh_path(spark, "ingest"), fresh_path(spark, "ingest-state")
    fresh = first_seen(stream_files(spark, folder, like, key, payload), method).select("chunk_hash", F.col("chunk_size").cast("long").alias("chunk_size"))
    query = fresh.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return spark.read.schema(fresh.schema).parquet(out)
