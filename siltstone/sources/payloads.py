"""Anything with bytes as `files` (file_id, file_ord, filename, data)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE = ["file_id", "file_ord", "filename", "data"]


def from_table(df: DataFrame, key: str, payload: str, prefix: str = "f/") -> DataFrame:
    """Rows as files: order by key, payload's UTF-8 bytes; null payloads stay null and make no chunks."""
    data = F.col(payload) if df.schema[payload].dataType.simpleString() == "binary" else F.encode(F.col(payload), "UTF-8")
    return df.select(F.col(key).cast("long").alias("file_id"), F.col(key).cast("long").alias("file_ord"), F.concat(F.lit(prefix), F.col(key).cast("string")).alias("filename"), data.alias("data"))


def from_parts(df: DataFrame, key: str, order: str, payload: str, prefix: str = "f/") -> DataFrame:
    """Rows of one key, in order, as one file each."""
    joined = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, payload))).alias("p")).select(key, F.array_join(F.col(f"p.{payload}"), "").alias(payload))
    return from_table(joined, key, payload, prefix)


def from_folder(spark: SparkSession, *roots: str) -> DataFrame:
    """All files under the roots; a root that can't be read raises."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(roots))
    named = found.select(F.col("path").alias("filename"), F.col("content").alias("data"))
    return named.select(F.xxhash64("filename").alias("file_id"), F.xxhash64("filename").alias("file_ord"), "filename", "data")


def archive_name(paths: list[str]) -> str | None:
    """The archive's name for its input roots: none, the last part of one, or a fixed one for several."""
    if len(paths) != 1:
        return "mc" if paths else None
    return paths[0].rstrip("/\\").replace("\\", "/").rpartition("/")[2]


def archive_name_column(path):
    """The same for a column of single roots."""
    return F.regexp_extract(F.regexp_replace(path, r"[/\\]+$", ""), r"[^/\\]+$", 0)


def restore_path_column(name):
    """Where a stored name may be restored: leading dots and slashes go; null for a name that still climbs out."""
    bare = F.regexp_replace(name, r"^[./]+", "")
    return F.when(~bare.rlike(r"(^|/)\.\.(/|$)"), bare)
