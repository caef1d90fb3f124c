"""The job as one fluent plan: files, chunks, duplicates, groups, layout, recipes, container, statistics."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import FeatureParams
from ..operators import chunk as chunking
from ..operators import dedup, layout, similar
from ..sources import payloads
from .storage import fresh_path, materialise


class Archive:
    """Every step is a DataFrame and may be taken by itself; chunks and the layout are written once."""

    def __init__(self, files: DataFrame, method: str = "ae", order: str = "arrival", params: FeatureParams | None = None):
        """order: `arrival`, `grouped` (similar chunks side by side) or `adjacent` (near duplicates' neighbours)."""
        self.files, self.method, self.order, self.params = files, method, order, params or FeatureParams()

    @classmethod
    def from_table(cls, df: DataFrame, key: str, payload: str, **options) -> Archive:
        return cls(payloads.from_table(df, key, payload), **options)

    @cached_property
    def chunks(self) -> DataFrame:
        return materialise(chunking.chunk(self.files, self.method), "chunks")

    @cached_property
    def unique(self) -> DataFrame:
        return materialise(dedup.unique_chunks(self.chunks), "unique")

    @cached_property
    def features(self) -> DataFrame:
        """Unique chunks with arrival (struct) and super_features; payloads are cut from the files only here."""
        own = chunking.slices(self.files, self.unique.select("file_id", "src_offset", "chunk_size", "chunk_hash", "first_file", "first_seq"))
        out = similar.with_super_features(own.select("chunk_hash", "first_file", "first_seq", "data"), self.params)
        return materialise(out.withColumn("arrival", F.struct("first_file", "first_seq")), "features")

    @cached_property
    def groups(self) -> DataFrame:
        """(chunk_hash, arrival, leader): leader is the arrival of the group's first chunk."""
        return materialise(self.features.join(similar.leaders(self.features), "arrival").select("chunk_hash", "arrival", "leader"), "groups")

    @cached_property
    def layout(self) -> DataFrame:
        unique = self.unique
        if self.order == "grouped":
            unique = unique.join(self.groups.select("chunk_hash", "leader"), "chunk_hash").withColumns({"o1": F.col("leader.first_file"), "o2": F.col("leader.first_seq")})
            order = ["o1", "o2", "first_file", "first_seq"]
        elif self.order == "adjacent":
            near = similar.duplicate_adjacency(self.chunks).select("chunk_hash", "anchor_file", "anchor_seq", "side")
            unique = unique.join(near, "chunk_hash")
            order = ["anchor_file", "anchor_seq", "side", "first_file", "first_seq"]
        else:
            order = ["first_file", "first_seq"]
        return materialise(layout.layout(unique, order), "layout")

    @cached_property
    def recipes(self) -> DataFrame:
        return layout.recipes(self.chunks, self.layout)

    @property
    def packed(self) -> DataFrame:
        """(packed_offset, data) of unique chunks."""
        return chunking.slices(self.files, self.layout.select("file_id", "src_offset", F.col("chunk_size").cast("int").alias("chunk_size"), "packed_offset")).select("packed_offset", "data")

    def restored(self) -> DataFrame:
        """(file_id, data) of every file; an empty and a null payload come back empty, as from the container."""
        return layout.restore(self.recipes, self.packed, self.files)

    def write(self, path: str, mode: str = "errorifexists", codec: str | None = None) -> str:
        """Write the container, compressed by a codec if one is named; returns the file's path."""
        from ..sources.container import compress_container, write_container

        write_container(self.files, self.recipes, self.packed, fresh_path(self.files.sparkSession, "parts"), path, mode)
        return compress_container(path, codec) if codec else path

    def stats(self) -> DataFrame:
        """One row: files, bytes, chunks, unique chunks and bytes, header and container bytes."""
        files = self.files.where(F.col("data").isNotNull()).select(F.lit("f").alias("w"), F.count("*").alias("n"), F.sum(F.octet_length("data").cast("long")).alias("b"))
        chunks = self.chunks.select(F.lit("c"), F.count("*"), F.sum(F.col("chunk_size").cast("long")))
        unique = self.unique.select(F.lit("u"), F.count("*"), F.sum(F.col("chunk_size").cast("long")))
        head = layout.header_bytes(self.files, self.chunks).select(F.lit("h"), F.lit(1).cast("long"), "header_bytes")
        of = lambda w, c: F.coalesce(F.max(F.when(F.col("w") == w, F.col(c))), F.lit(0)).cast("long")
        rows = files.union(chunks).union(unique).union(head)
        return rows.agg(
            of("f", "n").alias("files"), of("f", "b").alias("bytes"), of("c", "n").alias("chunks"), of("u", "n").alias("unique_chunks"), of("u", "b").alias("unique_bytes"),
            of("h", "b").alias("header_bytes"), (of("h", "b") + of("u", "b")).alias("container_bytes"))

    def journal(self, path: str) -> None:
        """Append the statistics to a table of runs."""
        self.stats().withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)
