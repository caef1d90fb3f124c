import pytest

from siltstone.operators import codecs, layout
from siltstone.plans.archive import Archive
from siltstone.plans.storage import fresh_path, shared_dir
from siltstone.sources import container, payloads

ROWS = [(1, "a" * 9000), (2, None), (3, ""), (4, "é" * 6000), (5, "a" * 9000), (6, "x"), (7, "b" * 70000 + "a" * 9000)]


def files(spark):
    return payloads.from_table(spark.createDataFrame(ROWS, "id long, body string"), "id", "body")


@pytest.mark.parametrize("method", ["ae", "rabin", "whole"])
@pytest.mark.parametrize("order", ["arrival", "grouped", "adjacent"])
def test_lossless(spark, method, order):
    a = Archive(files(spark), method, order)
    got = {r["file_id"]: bytes(r["data"]).decode() for r in a.restored().collect()}
    assert got == {k: v or "" for k, v in ROWS}


def test_container(spark):
    a = Archive(files(spark), "rabin", "grouped")
    path = fresh_path(spark, "container") + "/x.bin"
    a.write(path)
    got = {r["filename"]: bytes(r["data"]).decode() for r in container.restore_container(spark, path).collect()}
    assert got == {f"f/{k}": v or "" for k, v in ROWS}
    s = a.stats().first()
    assert s["container_bytes"] == len(open(path.removeprefix("file://"), "rb").read())


def test_compressed_container(spark, tmp_path):
    a = Archive(files(spark))
    for codec in ("gzip", "bzip2", "lz4"):
        path = a.write(f"file://{tmp_path}/{codec}.bin", codec=codec)
        got = container.restore_archive(spark, path, f"file://{tmp_path}/scratch")
        assert {r["filename"]: bytes(r["data"]).decode() for r in got.collect()} == {f"f/{k}": v or "" for k, v in ROWS}
    with pytest.raises(FileExistsError):
        a.write(f"file://{tmp_path}/gzip.bin")
    (tmp_path / "x.gz").write_bytes(b"BZh")
    with pytest.raises(ValueError):
        container.restore_archive(spark, f"file://{tmp_path}/x.gz", f"file://{tmp_path}/scratch")


def test_written_files(spark, tmp_path):
    df = spark.createDataFrame([("../x/./y", b"1"), ("a/../../b", b"2"), ("c", b"3")], "filename string, data binary")
    got = {r["filename"]: r["written"] for r in container.write_files(df, f"file://{tmp_path}").collect()}
    assert got == {"../x/./y": True, "a/../../b": False, "c": True}
    assert (tmp_path / "x" / "y").read_bytes() == b"1" and not (tmp_path.parent / "b").exists()
    assert not any(r["written"] for r in container.write_files(df, f"file://{tmp_path}").collect())


def test_journal(spark, tmp_path):
    a = Archive(files(spark))
    for _ in range(2):
        a.journal(str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2


def test_empty(spark):
    a = Archive(files(spark).where("file_id < 0"))
    assert a.restored().count() == 0 and a.stats().first()["container_bytes"] == 16
    b = Archive(files(spark).where("file_id < 0"), order="grouped")
    assert b.layout.count() == 0


def test_codecs():
    for name, (pack, unpack) in codecs.CODECS.items():
        assert unpack(pack(b"abc" * 50), 150) == b"abc" * 50, name
    with pytest.raises(ValueError):
        codecs.codec("rar")


def test_names(spark):
    assert payloads.archive_name([]) is None and payloads.archive_name(["./a/b//"]) == "b" and payloads.archive_name(["a", "b"]) == "mc"
    df = spark.createDataFrame([("../x/./y",), ("a/../b",), ("./z",)], "n string")
    assert [r[0] for r in df.select(payloads.restore_path_column(df.n)).collect()] == ["x/./y", None, "z"]


@pytest.mark.parametrize("order", ["arrival", "grouped"])
def test_read_units(spark, order):
    """Units are those of one pass over the whole layout, whatever its partitions."""
    a, limit = Archive(files(spark), "ae", order), 9600
    want, now = [], None
    for c in a.layout.orderBy("layout_ord").collect():
        start, stop = c["src_offset"], c["src_offset"] + c["chunk_size"]
        if now and now[0] == c["file_id"] and max(now[2], stop) - min(now[1], start) <= limit:
            now[1], now[2], now[3] = min(now[1], start), max(now[2], stop), now[3] + 1
        else:
            now = [c["file_id"], start, stop, 1]
            want.append(now)
    assert any(n > 1 for *_, n in want)
    for parts in (1, 5):
        got = layout.read_units(a.layout.repartition(parts), limit).orderBy("run", "unit_no").collect()
        assert [[u["file_id"], u["offset"], u["offset"] + u["length"], u["lifetime"]] for u in got] == want


def test_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    context = SimpleNamespace(master="spark://x:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))))
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))
