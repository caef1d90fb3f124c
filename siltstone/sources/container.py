"""The archive container: a header of files with their recipes, then the packed chunks.

    u32 magic, u32 files; for each file u16 name length, name, u64 size, u64 chunks, and for each
    chunk u64 packed offset and u32 length; u64 header length, this field included; packed data

Little-endian.  Executors write parts, header parts in file order and data parts in layout order; a
container is their concatenation.  Reading is a Python data source named "container"."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.storage import materialise, partitions

# Fixed value: the container's first four bytes.
MAGIC = 0x2016B509
SCHEMA = "container string, file_ord int, filename string, file_size long, chunk_count long, seq int, packed_offset long, chunk_size int"


def _parts(df: DataFrame, order: list[str], folder: str, tag: str) -> DataFrame:
    """Write the column `raw` in order; returns (tag, part, path, bytes, rows)."""
    ordered = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        part, own = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        name, size, rows = f"{tag}-{part:06d}-{own}", 0, 0
        with store.open_output_stream(f"{top}/{name}") as out:
            for b in batches:
                for raw in b.column("raw").to_pylist():
                    out.write(raw)
                    size, rows = size + len(raw), rows + 1
        yield pa.RecordBatch.from_pydict({"tag": [tag], "part": pa.array([part], pa.int32()), "path": [f"{folder}/{name}"], "bytes": [size], "rows": [rows]})

    return ordered.select(*order, "raw").mapInArrow(run, "tag string, part int, path string, bytes long, rows long")


def _exists(path: str) -> bool:
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path)
    return store.get_file_info(place).type != fs.FileType.NotFound


def write_container(files: DataFrame, recipe: DataFrame, packed: DataFrame, folder: str, path: str, mode: str = "errorifexists") -> None:
    """files (file_id, file_ord, filename), recipe (file_id, seq, packed_offset, chunk_size), packed (packed_offset, data).  Names keep at most 65,535 bytes by the format.  mode: `errorifexists` or `overwrite`."""
    if mode == "errorifexists" and _exists(path):
        raise FileExistsError(path)
    pair = F.struct("seq", "packed_offset", "chunk_size")
    listed = recipe.groupBy("file_id").agg(F.array_sort(F.collect_list(pair)).alias("pairs"))
    heads = files.select("file_id", "file_ord", "filename").join(listed, "file_id", "left")

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = []
            for name, pairs in zip(b.column("filename").to_pylist(), b.column("pairs").to_pylist(), strict=True):
                pairs, name = pairs or [], name.encode()
                out = [struct.pack("<H", len(name)), name, struct.pack("<QQ", sum(p["chunk_size"] for p in pairs), len(pairs))]
                raw.append(b"".join(out + [struct.pack("<QI", p["packed_offset"], p["chunk_size"]) for p in pairs]))
            yield pa.RecordBatch.from_arrays([b.column("file_ord"), pa.array(raw, pa.binary())], ["file_ord", "raw"])

    head_rows = heads.select("file_ord", "filename", "pairs").mapInArrow(head, "file_ord long, raw binary")
    data_rows = packed.select("packed_offset", F.col("data").alias("raw"))
    manifest = materialise(_parts(head_rows, ["file_ord"], folder, "head").unionByName(_parts(data_rows, ["packed_offset"], folder, "data")), "container")
    rows = manifest.orderBy(F.desc("tag"), "part").collect()  # a row a part
    head_size = 16 + sum(r["bytes"] for r in rows if r["tag"] == "head")
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path)
    store.create_dir(place.rpartition("/")[0], recursive=True)
    with store.open_output_stream(place, compression=None) as out:
        out.write(struct.pack("<II", MAGIC, sum(r["rows"] for r in rows if r["tag"] == "head")))
        for tag in ("head", "data"):
            if tag == "data":
                out.write(struct.pack("<Q", head_size))
            for r in rows:
                if r["tag"] == tag:
                    part_store, name = fs.FileSystem.from_uri(r["path"])
                    with part_store.open_input_stream(name, compression=None) as f:
                        while block := f.read(8 << 20):
                            out.write(block)


def parse_header(f) -> tuple[list[tuple], int]:
    """((name, size, pairs) of every file, where data starts); raises if the magic is another."""
    magic, n = struct.unpack("<II", f.read(8))
    if magic != MAGIC:
        raise ValueError("not a container")
    out = []
    for _ in range(n):
        (size,) = struct.unpack("<H", f.read(2))
        name = f.read(size).decode()
        total, count = struct.unpack("<QQ", f.read(16))
        out.append((name, total, list(struct.iter_unpack("<QI", f.read(12 * count)))))
    return out, struct.unpack("<Q", f.read(8))[0]


class _Path(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class ContainerReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]

    def partitions(self) -> list[InputPartition]:
        return [_Path(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(partition.value)
        with store.open_input_stream(name, compression=None) as f:
            files, _ = parse_header(f)
        for i, (filename, size, pairs) in enumerate(files):
            for k, (offset, length) in enumerate(pairs or [(None, None)]):
                yield partition.value, i, filename, size, len(pairs), k, offset, length


class ContainerSource(DataSource):
    """spark.read.format("container").load(path): a row for each chunk of each stored file."""

    @classmethod
    def name(cls) -> str:
        return "container"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ContainerReader:
        return ContainerReader(self.options)


def read_container(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ContainerSource)
    return spark.read.format("container").load(path)


def restore_container(spark: SparkSession, path: str) -> DataFrame:
    """(filename, file_size, chunk_count, data): every stored file, its bytes read from the data area."""
    rows = read_container(spark, path)
    listed = rows.groupBy("container", "file_ord", "filename", "file_size", "chunk_count").agg(F.array_sort(F.collect_list(F.struct("seq", "packed_offset", "chunk_size"))).alias("pairs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        starts: dict[str, int] = {}
        for b in batches:
            out = []
            for place, pairs in zip(b.column("container").to_pylist(), b.column("pairs").to_pylist(), strict=True):
                store, name = fs.FileSystem.from_uri(place)
                if place not in starts:
                    with store.open_input_stream(name, compression=None) as f:
                        starts[place] = parse_header(f)[1]
                with store.open_input_file(name) as f:
                    out.append(b"".join(f.read_at(p["chunk_size"], starts[place] + p["packed_offset"]) for p in pairs if p["chunk_size"]))
            yield pa.RecordBatch.from_arrays([b.column("filename"), b.column("file_size"), b.column("chunk_count"), pa.array(out, pa.binary())], ["filename", "file_size", "chunk_count", "data"])

    return listed.mapInArrow(run, "filename string, file_size long, chunk_count long, data binary")


def compress_container(path: str, name: str) -> str:
    """Compress a container by a codec whose form can be recognised; returns the new file's path."""
    from pyarrow import fs

    from ..operators.codecs import SUFFIXES, codec

    suffix = SUFFIXES[name]
    store, place = fs.FileSystem.from_uri(path)
    with store.open_input_stream(place, compression=None) as f:
        raw = f.read()
    with store.open_output_stream(place + suffix, compression=None) as out:
        out.write(codec(name)[0](raw))
    return path + suffix


def restore_archive(spark: SparkSession, path: str, scratch: str) -> DataFrame:
    """Restore a container, compressed or not.  A compressed one is taken if its name's suffix and its first byte agree, else refused."""
    from pyarrow import fs

    from ..operators.codecs import SNIFF, SUFFIXES, codec

    names = {suffix: name for name, suffix in SUFFIXES.items()}
    suffix = next((x for x in SNIFF if path.endswith(x)), None)
    if suffix:
        store, place = fs.FileSystem.from_uri(path)
        with store.open_input_stream(place, compression=None) as f:
            raw = f.read()
        if suffix not in names or raw[:1] != bytes([SNIFF[suffix]]):
            raise ValueError(f"{path} isn't what its name says, or can't be read here")
        path = f"{scratch}/{uuid.uuid4().hex}.bin"
        store, place = fs.FileSystem.from_uri(path)
        store.create_dir(place.rpartition("/")[0], recursive=True)
        with store.open_output_stream(place, compression=None) as out:
            out.write(codec(names[suffix])[1](raw, None))
    return restore_container(spark, path)


def write_files(restored: DataFrame, folder: str, mode: str = "errorifexists") -> DataFrame:
    """Write (filename, data) under a folder by the restore rule; returns (filename, path, written).  A name that climbs out isn't written, and in the default mode neither is one that is there."""
    from .payloads import restore_path_column

    named = restored.select("filename", restore_path_column(F.col("filename")).alias("path"), "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        for b in batches:
            done = []
            for path, data in zip(b.column("path").to_pylist(), b.column("data").to_pylist(), strict=True):
                place = f"{top}/{path}"
                ok = bool(path) and (mode == "overwrite" or store.get_file_info(place).type == fs.FileType.NotFound)
                if ok:
                    store.create_dir(place.rpartition("/")[0], recursive=True)
                    with store.open_output_stream(place, compression=None) as out:
                        out.write(data or b"")
                done.append(ok)
            yield pa.RecordBatch.from_arrays([b.column("filename"), b.column("path"), pa.array(done, pa.bool_())], ["filename", "path", "written"])

    return materialise(named.mapInArrow(run, "filename string, path string, written boolean"), "files")
