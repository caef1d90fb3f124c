"""Files to chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import CUTTERS
from ..plans.storage import small_batches


def chunk(files: DataFrame, method: str = "ae", with_data: bool = False) -> DataFrame:
    """(file_id, file_ord, seq, src_offset, chunk_size, chunk_hash[, data]) of every chunk; null or empty payloads make none.

    The hash is SHA-1.  Payloads don't leave this stage unless `with_data` asks for them, so that
    exchanges carry hashes and sizes only."""
    small_batches(files.sparkSession)
    cutter = CUTTERS[method]
    schema = "file_id long, file_ord long, seq int, src_offset long, chunk_size int, chunk_hash binary" + ", data binary" * with_data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, seq, at, size, digest, parts = [], [], [], [], [], []
            for i, raw in enumerate(b.column("data").to_pylist()):
                offset = 0
                for k, n in enumerate(cutter(raw or b"")):
                    part = raw[offset : offset + n]
                    rows.append(i)
                    seq.append(k)
                    at.append(offset)
                    size.append(n)
                    digest.append(hashlib.sha1(part).digest())
                    if with_data:
                        parts.append(part)
                    offset += n
            take = pa.array(rows, pa.int64())
            cols = [b.column("file_id").take(take), b.column("file_ord").take(take), pa.array(seq, pa.int32()), pa.array(at, pa.int64()), pa.array(size, pa.int32()), pa.array(digest, pa.binary())]
            names = ["file_id", "file_ord", "seq", "src_offset", "chunk_size", "chunk_hash"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(parts, pa.binary())] * with_data, names + ["data"] * with_data)

    return files.select("file_id", "file_ord", "data").mapInArrow(run, schema)


def slices(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """The payloads of chunks, cut from their files: late materialisation for a few chunks."""
    return chunks.join(files.select("file_id", "data"), "file_id").withColumn("data", F.expr("substring(data, cast(src_offset as int) + 1, chunk_size)"))
