import random

from siltstone.operators import similar


def greedy(rows):
    index, out = {}, {}
    for a, sf in sorted(rows):
        for i, x in enumerate(sf):
            if (i, x) in index:
                out[a] = index[i, x]
                break
        else:
            out[a] = a
            for i, x in enumerate(sf):
                index.setdefault((i, x), a)
    return out


def test_leaders_equal_sequential(spark):
    for seed in range(3):
        r = random.Random(seed)
        rows = [(a, [r.randrange(40) for _ in range(2)]) for a in range(120)]
        df = spark.createDataFrame(rows, "arrival long, super_features array<bigint>")
        assert {x["arrival"]: x["leader"] for x in similar.leaders(df).collect()} == greedy(rows)


def test_skip_and_adjacency(spark):
    s = spark.createDataFrame([("a", 1, 0, None), ("b", 1, 1, "a"), ("c", 2, 1, "a"), ("d", 3, 0, None)], "chunk_hash string, file_ord long, seq int, prev_hash string")
    assert {x[0]: x[1] for x in similar.skip_groups(s).collect()} == {"a": "a", "b": "b", "c": "b", "d": "d"}
    c = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (2, 1, "x"), (3, 0, "z")], "file_ord long, seq int, chunk_hash string")
    c = c.selectExpr("file_ord", "seq", "file_ord as file_id", "0L as src_offset", "1 as chunk_size", "chunk_hash")
    got = [x[0] for x in similar.duplicate_adjacency(c).orderBy("anchor_file", "anchor_seq", "side", "file_ord", "seq").collect()]
    assert got == ["a", "x", "b", "z"]
