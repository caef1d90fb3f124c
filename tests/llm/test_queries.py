"""Every opN query on a folder of awkward documents, against brute force, and on an empty one."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from siltstone.llm import attribution, decontaminate, lattice, neardup, registry, repeats

from ..oracle import compare
from .fixtures import documents, library, ordered, saved

ROWS = documents()
ITEMS = [(1, ROWS[5][1]), (2, "the of"), (3, None), (4, ""), (5, "is of the IS!! of the, is. of - the is of the"), (6, ROWS[6][1]), (7, ROWS[6][1]), (None, "an an an an"), (10, ROWS[8][1])]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return saved(spark, ROWS, str(tmp_path_factory.mktemp("docs")), ITEMS)


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    path = saved(spark, [], str(tmp_path_factory.mktemp("none")))
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty(spark, nothing, name):
    assert registry.QUERIES[name](spark, nothing).collect() == []


def run(spark, folder, name):
    df = registry.QUERIES[name](spark, folder)
    return pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)


def clean(v):
    return None if v is None or v != v else v


def crc(key):
    return None if key is None else zlib.crc32(str(key).encode())


def test_op1(spark, folder):
    got = run(spark, folder, "op1_sharding")
    want = [(k, len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())) for k, t, _, _ in ROWS]
    assert ordered(zip(map(clean, got["doc_id"]), got["size"], map(clean, got["text_crc32"]))) == ordered(want)
    total, largest = sum(w[1] for w in want), max(w[1] for w in want)
    last = -math.inf
    for shard, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
        ids = [clean(x) for x in part.sort_values("slot")["doc_id"]]
        ids = [-1 if x is None else x for x in ids]
        assert ids == sorted(ids) and ids[0] >= last
        last = ids[-1]
        assert part["size"].sum() <= total / 8 + largest
    assert set(got["law"]) == {"bytes"} and set(map(clean, got["grown_shard"])) == {None}


def test_op3(spark, folder):
    got = run(spark, folder, "op3_language_id")
    assert len(got) == len(ROWS)
    text = collections.defaultdict(set)
    for k, t, _, _ in ROWS:
        text[k].add(t)
    for r in got.itertuples():
        k = clean(r.doc_id)
        t = next(iter(text[k]))
        assert r.held_out == (True if k is None else crc(k) % 5 == 0)
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (t is None or not re.search(r"[^\W\d_]", t))
        assert r.lang_pred in {"en", "fr", "de", "und"}


def pieces_of(ids, end, size):
    ids = np.array([*ids, end], "<u4")
    return [(i, s, len(ids[s : s + size]), zlib.crc32(ids[s : s + size])) for i, s in enumerate(range(0, len(ids), size))]


def test_op4(spark, folder):
    got = run(spark, folder, "op4_packing")
    t = library("word_bpe_49k.json")
    want = [(k, *p) for k, text, _, _ in ROWS for p in pieces_of(t.encode(text or "", add_special_tokens=False).ids, 1, 4096)]
    assert ordered(zip(map(clean, got.doc_id), got.piece, got.start, got.length, got.ids_crc32)) == ordered(want)
    for _, seq in got.groupby("sequence_id"):
        at = 0
        for r in seq.sort_values("offset").itertuples():
            assert r.offset == at
            at += r.length
        assert at <= 4096
    total = sum(w[3] for w in want)
    assert got.sequence_id.nunique() <= -(-total // 4096) + 1


def test_op5(spark, folder):
    got = run(spark, folder, "op5_repeats")
    raws = [(k, (t or "").encode()) for k, t, _, _ in ROWS]
    seen = collections.Counter(raw[i : i + 400] for _, raw in raws for i in range(len(raw) - 399))
    want = []
    for k, raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - 399):
            if seen[raw[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        want.append((k, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    assert ordered(zip(map(clean, got.doc_id), got.n_bytes, got.n_removed, got.n_spans, got.kept_sha256)) == ordered(want)
    assert sum(w[2] for w in want) > 0


def test_op5_large_groups(spark, folder):
    """The way for groups of any size gives the same."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    a = repeats.kept_bytes(docs, form="sha256").toPandas()
    b = repeats.kept_bytes(docs, form="sha256", group=1).toPandas()
    assert ordered(map(str, a.itertuples(index=False, name=None))) == ordered(map(str, b.itertuples(index=False, name=None)))


def passages(raws, words):
    """Maximal runs and bytes of each text that repeated strings of so many words cover, one string at a time."""
    at = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)] for raw in raws]
    strings = [[(w[i][0], w[i + words - 1][1]) for i in range(len(w) - words + 1)] for w in at]
    seen = collections.Counter(raw[s:e] for raw, own in zip(raws, strings) for s, e in own)
    out = []
    for raw, own in zip(raws, strings):
        gone = np.zeros(len(raw) + 1, np.int8)
        for s, e in own:
            if seen[raw[s:e]] > 1:
                gone[s:e] = 1
        out.append((int((np.diff(gone, prepend=0) == 1).sum()), int(gone.sum())))
    return out


def test_op5_passages(spark, folder, tmp_path):
    """A repeated passage of 51 words is reported at whatever length in bytes, one of 50 is not; what is removed stays by 400 bytes."""
    got = run(spark, folder, "op5_repeats")
    want = passages([(t or "").encode() for _, t, _, _ in ROWS], 51)
    assert ordered(zip(map(clean, got.doc_id), got.n_passages, got.n_passage_bytes)) == ordered((r[0], *p) for r, p in zip(ROWS, want))
    text = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    one, two = text("a", 51), text("b", 50)
    rows = [(1, f"{text('c', 90)} {one} x {two} y"), (2, f"{one}\n{text('d', 70)}"), (3, f"z {two} {text('e', 80)}"), (4, text("f", 200)), (5, "u " * 60), (6, None), (7, f"v {text('a', 40)}  {text('a', 51)}")]
    rows = [(k, t, "en", "src") for k, t in rows]
    small = run(spark, saved(spark, rows, str(tmp_path)), "op5_repeats")
    assert {r.doc_id: (r.n_removed, r.n_passages, r.n_passage_bytes) for r in small.itertuples()} == {
        1: (0, 1, len(one)), 2: (0, 1, len(one)), 3: (0, 0, 0), 4: (0, 0, 0), 5: (0, 1, 119), 6: (0, 0, 0), 7: (0, 1, len(one))}


def test_op6(spark, folder):
    got = run(spark, folder, "op6_lattice")
    held = lambda k: True if k is None else crc(k) % 7 == 2
    c = collections.Counter()
    for k, t, _, _ in ROWS:
        if not held(k):
            c.update([*lattice.words_of(t), "\n"])
    n, v = sum(c.values()), len(c)
    want = []
    for k, t, _, _ in ROWS:
        w = [*lattice.words_of(t), "\n"]
        want.append((k, held(k), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 5)))
    assert ordered(zip(map(clean, got.doc_id), got.held_out, got.n_tokens, got.n_known, got.train_tokens, [round(x, 5) for x in got.base_score])) == ordered(want)
    assert all(-math.inf < x < 0 for x in got.score)


def test_op7(spark, folder):
    got = run(spark, folder, "op7_decontaminate")
    items = [(i, decontaminate.words_of(t)) for i, t in ITEMS]
    want = []
    for k, t, _, _ in ROWS:
        w, hit, who = decontaminate.words_of(t), set(), set()
        for item, words in items:
            n = min(10, len(words))
            windows = {tuple(words[j : j + n]) for j in range(len(words) - n + 1)} if n else set()
            for j in range(len(w) - n + 1 if n else 0):
                if tuple(w[j : j + n]) in windows:
                    hit.update(range(j, j + n))
                    who.update(() if item is None else [str(item)])
        want.append((k, len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit)))
    assert ordered(zip(map(clean, got.doc_id), got.n_words, got.n_hit, got.n_items, got.items_sha256, got.contaminated)) == ordered(want)
    assert sum(w[5] for w in want) > 2


def test_op7_passes(spark, folder):
    """A benchmark beyond one pass's bound gives the same."""
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    a, b = (decontaminate.mark_benchmark(docs, items, pass_bytes=p).toPandas() for p in (1 << 20, 400))
    show = lambda f: ordered((clean(r.doc_id), r.n_words, list(r.hit_words), list(r.items)) for r in f.itertuples())
    assert show(a) == show(b)


def test_op8(spark, folder):
    got = run(spark, folder, "op8_neardup")
    assert len(got) == len(ROWS)
    parent = list(range(len(ROWS)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t or "") for _, t, _, _ in ROWS]
    for i, a in enumerate(ROWS):
        for j in range(i):
            b = ROWS[j]
            if None not in (a[1], b[1]) and (a[1] == b[1] or (sets[i] & sets[j] and neardup.similar(a[1], b[1]))):
                parent[find(i)] = find(j)
    want = []
    for i, a in enumerate(ROWS):
        ids = [ROWS[j][0] for j in range(len(ROWS)) if find(j) == find(i) and ROWS[j][0] is not None]
        want.append((a[0], min(ids) if ids else None))
    assert ordered(zip(map(clean, got.doc_id), map(clean, got.class_id))) == ordered(want)


def test_op9(spark, folder):
    got = run(spark, folder, "op9_token_files")
    t = library("byte_bpe_50k.json")
    coded = [(k, t.encode(x or "", add_special_tokens=False).ids + [0]) for k, x, _, _ in ROWS]
    assert ordered(zip(map(clean, got.doc_id), got.n_tokens, got.ids_crc32)) == ordered((k, len(i), zlib.crc32(np.array(i, "<u4"))) for k, i in coded)
    got = got.sort_values("start")
    at, last = 0, -1
    for r in got.itertuples():
        assert r.start == at
        at += r.n_tokens
        k = -1 if clean(r.doc_id) is None else r.doc_id
        assert k >= last
        last = k


def test_op10(spark, folder):
    got = run(spark, folder, "op10_token_counts")
    t = library("byte_bpe_50k.json")
    want = []
    for k, x, _, _ in ROWS:
        x = x or ""
        starts = attribution.line_starts(x).tolist()
        stops = [*starts[1:], len(x)]
        count, cross = [0] * len(starts), [0] * len(starts)
        for b, e in t.encode(x, add_special_tokens=False).offsets:
            held = [min(e, z) - max(b, s) for s, z in zip(starts, stops)]
            own = max(range(len(starts)), key=lambda i: (held[i], -i)) if max(held) > 0 else max(i for i, s in enumerate(starts) if s <= b)
            count[own] += 1
            cross[own] += sum(h > 0 for h in held) > 1
        want += [(k, i, starts[i], stops[i], count[i], cross[i]) for i in range(len(starts))]
    assert ordered(zip(map(clean, got.doc_id), got.section, got.start, got.end, got.n_tokens, got.n_crossing)) == ordered(want)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    compare(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], "/root/testdata/sf0.001")
