"""Operator 9, token ids in binary files.

Whole texts are tokenised, an end id is appended to each, and the ids go to files in ascending key
order.  A file holds up to `SEGMENT` ids (one text's ids stay together).  In it ids are numbers of a
table sorted by how often an id occurs in that file, so that frequent ids take one byte; a number's
byte length, 1 to 4, is two bits of a control byte, and control bytes are apart from data bytes.
Numpy decodes a file by looking up control bytes in a table of lengths.

    bytes 0-3    magic
    u64 x 3      texts, ids, distinct ids
    i64 x texts  keys;  u8 x texts: 1 where the key is null;  u64 x texts: ids of each text
    u32 x distinct ids: the ids, most frequent first (ties: smaller id)
    control bytes (4 numbers each, lowest bits first), data bytes (little-endian)

All numbers are little-endian.  A task writes files under names of its own and returns their names;
only files named in the written manifest are read, so those of failed or repeated tasks do no harm.

Defined cases: a null or empty text has the end id alone; null keys come first; equal keys and
repeated rows are ordered by a row tag; an empty table makes no files and no rows; only the named
columns are read.  Files go to `folder`, which pyarrow.fs must be able to open (local or shared
paths, hdfs, s3, gs); by default that is the shared folder.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, materialise, partitions, read_table, small_batches
from .packing import tokenizer_path
from .tokens import tokenizer

MAGIC = b"FRQ1"
END_ID = 0
SEGMENT = 4_000_000

#: Byte lengths of the four numbers that a control byte stands for.
LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode_numbers(x: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    x = x.astype("<u4")
    size = (x > 0xFF).astype(np.uint8) + (x > 0xFFFF) + (x > 0xFFFFFF)
    code = np.zeros(-(-len(x) // 4) * 4, np.uint8)
    code[: len(x)] = size
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    data = []
    for i in range(0, len(x), 1 << 18):
        part = x[i : i + (1 << 18)].view(np.uint8).reshape(-1, 4)
        data.append(part[np.arange(4) <= size[i : i + (1 << 18), None]].tobytes())
    return control.astype(np.uint8).tobytes(), b"".join(data)


def decode_numbers(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The numbers, by table lookup."""
    size = LENGTHS[control].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    most = int(size.max()) if n else 1
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    out = padded[at].astype(np.uint32)
    for i in range(1, most):
        out |= padded[at + i].astype(np.uint32) << np.uint32(8 * i)
    return out & _MASKS[size]


def encode_file(keys: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One file's bytes."""
    seen, number, often = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-often, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    control, data = encode_numbers(rank[number])
    return b"".join([
        MAGIC, np.array([len(keys), len(ids), len(seen)], "<u8").tobytes(), np.array([k or 0 for k in keys], "<i8").tobytes(),
        bytes(k is None for k in keys), counts.astype("<u8").tobytes(), seen[order].astype("<u4").tobytes(), control, data])


def decode_file(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Keys, ids of each text, and all ids of a file."""
    if raw[:4] != MAGIC:
        raise ValueError("not a token file")
    texts, n, distinct = np.frombuffer(raw, "<u8", 3, 4).tolist()
    at = 28
    keys = np.frombuffer(raw, "<i8", texts, at).tolist()
    at += 8 * texts
    nulls = raw[at : at + texts]
    at += texts
    counts = np.frombuffer(raw, "<u8", texts, at).astype(np.int64)
    at += 8 * texts
    table = np.frombuffer(raw, "<u4", distinct, at)
    at += 4 * distinct
    control = np.frombuffer(raw, np.uint8, -(-n // 4), at)
    data = np.frombuffer(raw, np.uint8, -1, at + len(control))
    return [None if z else k for k, z in zip(keys, nulls, strict=True)], counts, table[decode_numbers(control, data, n)]


def write_token_files(df: DataFrame, vocabulary: str, kind: str, end_id: int = END_ID, key: str = "doc_id", text: str = "text", folder: str | None = None, segment: int = SEGMENT) -> DataFrame:
    """Write the files; returns their manifest (part, nth, path, texts, ids), in file order by (part, nth)."""
    spark = df.sparkSession
    small_batches(spark)
    folder = folder or fresh_path(spark, "tokens")
    frame = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).withColumn("tag", F.monotonically_increasing_id())
    ordered = frame.repartitionByRange(partitions(spark), "k", "tag").sortWithinPartitions("k", "tag")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        part, own = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        words = tokenizer(vocabulary, kind)
        keys, counts, lists, held, nth = [], [], [], 0, 0

        def flush():
            nonlocal keys, counts, lists, held, nth
            name = f"ids-{part:06d}-{nth:05d}-{own}.frq"
            raw = encode_file(keys, np.concatenate(counts), np.concatenate(lists))
            with store.open_output_stream(f"{top}/{name}") as out:
                out.write(raw)
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "nth": pa.array([nth], pa.int32()), "path": [f"{folder}/{name}"], "texts": [len(keys)], "ids": [held]})
            keys, counts, lists, held, nth = [], [], [], 0, nth + 1
            return row

        for b in batches:
            ids, bounds = words.encode(b.column("t").to_pylist())
            n = np.diff(bounds)
            keys += b.column("k").to_pylist()
            lists.append(np.insert(ids, bounds[1:], np.uint32(end_id)))
            counts.append(n + 1)
            held += len(ids) + len(n)
            if held >= segment:
                yield flush()
        if keys:
            yield flush()

    return materialise(ordered.mapInArrow(run, "part int, nth int, path string, texts long, ids long"), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(k, start, n_tokens, ids_crc32) of every text, decoded from the files; start counts the ids of all texts before it."""
    spark = manifest.sparkSession
    before = Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = manifest.select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base")).repartition(partitions(spark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_stream(name) as f:
                    keys, counts, ids = decode_file(f.read())
                ids = ids.astype("<u4")
                ends = np.cumsum(counts)
                starts = ends - counts
                crc = [zlib.crc32(ids[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts + base), pa.array(counts), pa.array(crc, pa.int64())], ["k", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "k long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents to token files and back."""
    manifest = write_token_files(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), "byte")
    return read_token_files(manifest).withColumnRenamed("k", "doc_id")
