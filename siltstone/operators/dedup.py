"""The duplicate index.  Arrival order is (file_ord, seq); the first arrival of a hash wins.

All steps are aggregates with map-side combine and equi-joins on the hash, so a chunk that a third of
all rows share is combined before any exchange, and joins may be split by adaptive execution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_chunks(chunks: DataFrame) -> DataFrame:
    """(chunk_hash, first_file, first_seq, file_id, src_offset, chunk_size, occurrences): one row a hash, of its first arrival."""
    first = F.min(F.struct("file_ord", "seq", "file_id", "src_offset", "chunk_size")).alias("f")
    return chunks.groupBy("chunk_hash").agg(first, F.count("*").alias("occurrences")).select(
        "chunk_hash", F.col("f.file_ord").alias("first_file"), F.col("f.seq").alias("first_seq"), "f.file_id", "f.src_offset", "f.chunk_size", "occurrences")


def with_first(chunks: DataFrame) -> DataFrame:
    """Every occurrence with the first arrival of its hash (index insert that returns the entry), and whether it is that one."""
    index = unique_chunks(chunks).select("chunk_hash", "first_file", "first_seq")
    return chunks.join(index, "chunk_hash").withColumn("is_unique", (F.col("file_ord") == F.col("first_file")) & (F.col("seq") == F.col("first_seq")))


def last_position(chunks: DataFrame) -> DataFrame:
    """(chunk_hash, file_ord, seq): the last arrival of each hash (index update by the latest writer)."""
    return chunks.groupBy("chunk_hash").agg(F.max(F.struct("file_ord", "seq")).alias("l")).select("chunk_hash", "l.file_ord", "l.seq")


def lookup(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """Chunks whose hash an index has, with its columns."""
    return chunks.join(index, "chunk_hash")


def new_against(chunks: DataFrame, base: DataFrame) -> DataFrame:
    """Chunks whose hash a base doesn't have."""
    return chunks.join(base.select("chunk_hash").distinct(), "chunk_hash", "left_anti")


def successors(chunks: DataFrame) -> DataFrame:
    """(chunk_hash, prev_hash): each unique chunk with the chunk before its first arrival in the same file."""
    before = chunks.select("file_ord", (F.col("seq") + 1).alias("seq"), F.col("chunk_hash").alias("prev_hash"))
    own = unique_chunks(chunks).select("chunk_hash", F.col("first_file").alias("file_ord"), F.col("first_seq").alias("seq"))
    return own.join(before, ["file_ord", "seq"], "left")
