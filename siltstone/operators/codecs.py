"""General compressors on payloads, and recognition of compressed ones."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Suffix and first byte of the compressed forms that can be read.
SNIFF = {".gz": 0x1F, ".bz2": 0x42, ".7z": 0x37, ".rar": 0x52, ".lz4": 0x04}
#: Codecs whose files can be recognised when read again; lz4 here is a frame with the recognised first byte.
SUFFIXES = {"gzip": ".gz", "bzip2": ".bz2", "lz4": ".lz4"}
#: Known by name, but no library for them is here.
ABSENT = ("7z", "rar", "lha")


def _zip(raw: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("payload"), raw)
    return out.getvalue()


def _unzip(raw: bytes) -> bytes:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        return z.read("payload")


def _arrow(name: str):
    return (lambda x: pa.compress(x, codec=name, asbytes=True)), (lambda x, n: pa.decompress(x, n, codec=name, asbytes=True))


def _lz4_pack(raw: bytes) -> bytes:
    out = pa.BufferOutputStream()
    with pa.CompressedOutputStream(out, "lz4") as f:
        f.write(raw)
    return out.getvalue().to_pybytes()


def _lz4_unpack(raw: bytes) -> bytes:
    with pa.CompressedInputStream(pa.BufferReader(raw), "lz4") as f:
        return f.read()


CODECS = {
    "gzip": (lambda x: gzip.compress(x, mtime=0), lambda x, n: gzip.decompress(x)),
    "bzip2": (bz2.compress, lambda x, n: bz2.decompress(x)),
    "zip": (_zip, lambda x, n: _unzip(x)),
    "zlib": (zlib.compress, lambda x, n: zlib.decompress(x)),
    "lzma": (lzma.compress, lambda x, n: lzma.decompress(x)),
    "lz4": (_lz4_pack, lambda x, n: _lz4_unpack(x)),
    "zstd": _arrow("zstd"),
}


def codec(name: str):
    """(compress, decompress) by name; an algorithm is matched by its prefix."""
    if name.startswith(ABSENT):
        raise ValueError(f"no library for {name} here")
    for known, pair in CODECS.items():
        if name.startswith(known):
            return pair
    raise ValueError(f"unknown codec {name}")


def compress(df: DataFrame, name: str, payload: str = "data") -> DataFrame:
    """Adds `packed` (the compressed payload) and `size` (the payload's bytes) and drops the payload."""
    codec(name)
    names = [c for c in df.columns if c != payload]
    schema = ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names) + ", size long, packed binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = codec(name)[0]
        for b in batches:
            raw = [x or b"" for x in b.column(payload).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array([len(x) for x in raw], pa.int64()), pa.array([pack(x) for x in raw], pa.binary())], [*names, "size", "packed"])

    return df.select(*names, payload).mapInArrow(run, schema)


def decompress(df: DataFrame, name: str, payload: str = "data") -> DataFrame:
    """The inverse of compress."""
    codec(name)
    names = [c for c in df.columns if c not in ("packed", "size")]
    schema = ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names) + f", {payload} binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = codec(name)[1]
        for b in batches:
            raw = [unpack(x, n) for x, n in zip(b.column("packed").to_pylist(), b.column("size").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(raw, pa.binary())], [*names, payload])

    return df.select(*names, "size", "packed").mapInArrow(run, schema)


def sniffed(filename: Column, data: Column) -> Column:
    """The suffix if the name's suffix and the first byte agree on a readable form, else null."""
    out = F.lit(None).cast("string")
    for suffix, first in SNIFF.items():
        out = F.when(filename.endswith(suffix) & (F.substring(data, 1, 1) == F.lit(bytes([first]))), F.lit(suffix)).otherwise(out)
    return out
