"""Order of unique chunks, packed offsets, recipes, restore and the read plan."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.prefix import running
from ..plans.storage import partitions


def layout(unique: DataFrame, order: list[str]) -> DataFrame:
    """Unique chunks in order with layout_ord and packed_offset, the exclusive running sum of sizes."""
    return running(unique.withColumn("chunk_size", F.col("chunk_size").cast("long")), order, "chunk_size")


def recipes(chunks: DataFrame, placed: DataFrame) -> DataFrame:
    """(file_id, seq, packed_offset, chunk_size): source offsets replaced by packed ones."""
    return chunks.select("file_id", "seq", "chunk_hash", "chunk_size").join(placed.select("chunk_hash", "packed_offset"), "chunk_hash").select("file_id", "seq", "packed_offset", "chunk_size")


def unresolved(chunks: DataFrame, placed: DataFrame) -> DataFrame:
    """Chunk occurrences without a place."""
    return chunks.join(placed.select("chunk_hash"), "chunk_hash", "left_anti")


def restore(recipe: DataFrame, packed: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(file_id, data): the parts (packed_offset, data) of each file in recipe order.

    With the files (file_id, ...), each of them has a row: one without chunks, empty or null, comes back empty."""
    parts = recipe.join(packed.select("packed_offset", "data"), "packed_offset")
    listed = parts.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("seq", "data"))).alias("p"))
    if files is not None:
        listed = files.select("file_id").join(listed, "file_id", "left")
    return listed.select("file_id", F.coalesce(F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.data))"), F.lit(b"")).alias("data"))


def read_units(placed: DataFrame, limit: int = 4 << 20) -> DataFrame:
    """(run, unit_no, file_id, offset, length, lifetime): reads in layout order, widened while the file stays
    and the span keeps within `limit`; lifetime counts the chunks a read serves.

    A unit never leaves a run, the longest stretch of the layout with one file.  Runs are numbered over the
    whole layout and each is folded by itself in layout order, so that units don't depend on partitions."""
    rows = placed.select("layout_ord", "file_id", "src_offset", "chunk_size")
    before = rows.select((F.col("layout_ord") + 1).alias("layout_ord"), F.col("file_id").alias("before"))
    fresh = F.when(F.col("before").eqNullSafe(F.col("file_id")), 0).otherwise(1).cast("long")
    marked = running(rows.join(before, "layout_ord", "left").withColumn("fresh", fresh), ["layout_ord"], "fresh", "earlier", "nth")
    marked = marked.select((F.col("earlier") + F.col("fresh") - 1).alias("run"), *rows.columns)
    spread = marked.repartition(partitions(placed.sparkSession), "run").sortWithinPartitions("run", "layout_ord")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["run", "unit_no", "file_id", "offset", "length", "lifetime"]
        now = None  # run, unit, file, first byte, past the last, chunks

        def batch(done: list[list[int]]) -> pa.RecordBatch:
            made = [(r, u, f, o, e - o, n) for r, u, f, o, e, n in done]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 5 else pa.int64()) for i, c in enumerate(zip(*made, strict=True))], names)

        for b in batches:
            done = []
            for r, f, o, n in zip(*[b.column(c).to_pylist() for c in ("run", "file_id", "src_offset", "chunk_size")], strict=True):
                same = now is not None and now[0] == r
                if same and max(now[4], o + n) - min(now[3], o) <= limit:
                    now[3], now[4], now[5] = min(now[3], o), max(now[4], o + n), now[5] + 1
                    continue
                if now:
                    done.append(now)
                now = [r, now[1] + 1 if same else 0, f, o, o + n, 1]
            if done:
                yield batch(done)
        if now:
            yield batch([now])

    return spread.mapInArrow(run, "run long, unit_no long, file_id long, offset long, length long, lifetime int")


def segments(packed: DataFrame, size: int = 1 << 20) -> DataFrame:
    """(segment, data): packed chunks (packed_offset, data) joined into segments of about `size` bytes."""
    cut = packed.withColumn("segment", F.floor(F.col("packed_offset") / size))
    listed = cut.groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("packed_offset", "data"))).alias("p"))
    return listed.select("segment", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.data))").alias("data"))


def header_bytes(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row, header_bytes: 16 and for each file 18, its name's bytes and 12 a chunk."""
    names = files.select(F.sum(F.octet_length("filename").cast("long") + 18).alias("n"))
    pairs = chunks.select((F.count("*") * 12).alias("n"))
    return names.unionByName(pairs).select((F.coalesce(F.sum("n"), F.lit(0)) + 16).cast("long").alias("header_bytes"))
