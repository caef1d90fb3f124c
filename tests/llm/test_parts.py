"""The operators' kernels by themselves."""

import math
import random
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import components, lattice, language, neardup, packing, repeats, token_files, tokens, topk
from siltstone.llm.decontaminate import WuManber, mark_benchmark

from .fixtures import documents, library

ODD = [" ", "  ", "\n", "\t", "a", "B", "é", "É", "1", "23", ".", "!!", "\x1c", "\x85", "中", "́", "\U0001f600", "'s", "'LL", "\r\n", "\0", "ſ", "İ", "ß", "<|endoftext|>", "​", "﻿", "Σ", "ς", "ᄀ", "ᅡ"]


@pytest.mark.parametrize("name, kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_tokens_equal_library(name, kind):
    r = random.Random(1)
    texts = ["".join(r.choice(ODD) for _ in range(r.randint(0, 25))) for _ in range(3000)] + [x[1] or "" for x in documents()]
    want = library(name).encode_batch(texts, add_special_tokens=False)
    for spans in (False, True):
        t = tokens.ChunkTokenizer(public_tokenizers.path(name), kind, spans)
        ids, bounds = t.encode(texts)
        assert [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(len(texts))] == [e.ids for e in want]
    _, bounds, begin, end = t.encode_spans(texts)
    assert [list(zip(begin[a:b].tolist(), end[a:b].tolist())) for a, b in zip(bounds[:-1], bounds[1:])] == [e.offsets for e in want]


@pytest.mark.parametrize("name, kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_merges_reach_every_plain_piece(name, kind):
    t = tokens.ChunkTokenizer(public_tokenizers.path(name), kind)
    back = {c: b for b, c in tokens._LETTERS.items()}
    plain = []
    for piece in t.tokenizer.get_vocab():
        try:
            text = bytes(back[c] for c in piece.replace("</w>", "")).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if tokens._PLAIN.fullmatch(text.strip(" ")):
            plain.append(text)
    ids, bounds = t.encode(plain)
    assert [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(len(plain))] == [e.ids for e in t.tokenizer.encode_batch_fast(plain, add_special_tokens=False)]


def test_tokens_start_anew(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 10)
    t = tokens.ChunkTokenizer(public_tokenizers.path("byte_bpe_50k.json"), "byte")
    text = documents()[5][1]
    first = t.encode([text])[0].tolist()
    t.encode(["x y z " * 20])
    assert t.encode([text])[0].tolist() == first


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=12), min_size=1, max_size=12), st.text("abc", max_size=200))
def test_wu_manber(patterns, text):
    p = sorted({x.encode() for x in patterns})
    want = sorted((i, k) for k, x in enumerate(p) for i in range(len(text)) if text.encode().startswith(x, i))
    assert sorted(WuManber(p, 3).find(text.encode())) == want


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), max_size=15))
def test_packing_plan(counts):
    rows, n = packing.plan_packing(counts, 50)
    used = {}
    bins = {}
    for length, first, pieces, sequence, offset, copies in rows:
        assert used.get(length, 0) == first
        used[length] = first + pieces
        for i in range(pieces):
            bins.setdefault(sequence + i // copies, []).append((offset + i % copies * length, length))
    assert used == counts and len(bins) == n
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 50


def test_packing_uses_exact_complements():
    assert packing.plan_packing({30: 4, 20: 4}, 50)[1] == 4
    assert packing.plan_packing({30: 3, 12: 3, 8: 3}, 50)[1] == 3
    assert packing.plan_packing({30: 2, 9: 2, 7: 2, 4: 2}, 50)[1] == 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_numbers(values):
    x = np.array(values, np.uint32)
    control, data = token_files.encode_numbers(x)
    assert token_files.decode_numbers(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(x)).tolist() == values


def test_token_file():
    ids = np.array([7, 7, 9, 70000, 7, 0, 0], np.uint32)
    keys, counts, back = token_files.decode_file(token_files.encode_file([None, 3, 3], np.array([3, 2, 2]), ids))
    assert (keys, counts.tolist(), back.tolist()) == ([None, 3, 3], [3, 2, 2], ids.tolist())


def test_token_segments(spark, tmp_path):
    df = spark.createDataFrame([(i, "a b c " * i) for i in range(60)], "doc_id long, text string")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 2)
    m = token_files.write_token_files(df, public_tokenizers.path("byte_bpe_50k.json"), "byte", folder=f"file://{tmp_path}", segment=100)
    spark.conf.set(key, before)
    assert m.count() > 8
    got = token_files.read_token_files(m).orderBy("start").collect()
    assert [r["k"] for r in got] == list(range(60)) and got[-1]["start"] + got[-1]["n_tokens"] == m.agg(F.sum("ids")).first()[0]


def test_learns_languages():
    r = random.Random(2)
    make = {"x": lambda: " ".join(r.choice(["the", "and", "of", "with"]) + r.choice("abc") for _ in range(60)), "y": lambda: " ".join(r.choice(["der", "und", "mit"]) + r.choice("abc") for _ in range(60))}
    data = [(make[k]().encode(), i) for i, k in enumerate(make) for _ in range(60)]
    m = language.ByteCNN(2)
    m.train(np.stack([language.padded(x) for x, _ in data]), np.array([y for _, y in data]), steps=80)
    p = language.Predictor(m).predict([make[k]().encode() * 3 for k in make for _ in range(20)])
    assert p.argmax(1).tolist() == [0] * 20 + [1] * 20 and np.allclose(p.sum(1), 1, atol=1e-4)


def test_tables_equal_network():
    m = language.ByteCNN(3, seed=4)
    raw = random.Random(1).randbytes(700)
    x = np.zeros((3, language.LENGTH + 3), np.uint8)
    flat = np.frombuffer(raw + bytes(1000), np.uint8)
    for i in range(3):
        x[i] = flat[i * 256 : i * 256 + 259]
    prob = m._forward(x)[-1]
    want = (prob * np.array([256, 256, 188])[:, None]).sum(0) / 700
    assert np.allclose(language.Predictor(m).predict([raw])[0], want, atol=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs, *language.learn(docs), carry=("lang",)).where(language.held_out(F.col("doc_id"))).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert got > 0.97


@pytest.fixture(scope="module")
def vocabulary():
    return lattice.Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))


def segmentations(v, s):
    """All (pieces, log probability) by brute force."""
    index = {p: i for i, p in enumerate(v.pieces[:-257])}
    if not s:
        return [((), 0.0)]
    out = []
    for n in range(1, len(s) + 1):
        edge = [(index[s[:n]],)] if s[:n] in index else [tuple(len(index) + b for b in s[:1].encode())] if n == 1 else []
        for e in edge:
            out += [(e + rest, sum(v.log[i] for i in e) + p) for rest, p in segmentations(v, s[n:])]
    return out


def test_lattice(vocabulary):
    m = lattice.Lattice(vocabulary)
    words = ["the", "thing", "ndshat", "é", "中\U0001f600", "a▁b", "x", "tion."]
    got = m.score(words)
    want, expected = [], np.zeros(len(vocabulary.log))
    for t, w in enumerate(words):
        all_ = segmentations(vocabulary, lattice.MARK + w)
        total = sum(math.exp(p) for _, p in all_)
        want.append(math.log(total))
        for ids, p in all_:
            for i in ids:
                expected[i] += math.exp(p) / total * (t + 1)
    assert np.allclose(got, want)
    assert np.allclose(m.expect(words, np.arange(1.0, len(words) + 1)), expected)


def test_log_probability_scores_stay():
    v = lattice.Vocabulary(["a", "b", *[f"<{i}>" for i in range(256)], "</s>"], [math.log(0.5), math.log(0.25)] + [math.log(0.25 / 257)] * 257)
    assert np.allclose(v.log[:2], [math.log(0.5), math.log(0.25)])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12), st.integers(0, 9))
def test_banded_distance(a, b, band):
    d = distance(a, b)
    assert neardup.banded_distance(a, b, band) == (d if d <= band else None)


def test_order_matters():
    r = random.Random(1)
    w = [f"w{r.randrange(10**6)}" for _ in range(120)]
    half = w[60:] + w[:60]
    s, _, _ = neardup.sketches([" ".join(x).encode() for x in (w, half, w[:100] + w[101:])])
    assert (s[0] == s[2]).sum() > (s[0] == s[1]).sum()


def test_sketches_dont_depend_on_the_batch():
    texts = [(x[1] or "").encode() for x in documents()]
    whole = neardup.sketches(texts)[0]
    assert all((neardup.sketches([t])[0][0] == whole[i]).all() for i, t in enumerate(texts))


def test_links_meet():
    """Nearly all pairs at the least similarity of a link agree in a key, short ones of up to nine words always."""
    r, share = random.Random(2), {}
    for n in (5, 9, 10, 12, 20, 100):
        texts = []
        for _ in range(300):
            w = [f"w{r.randrange(3000)}" for _ in range(n)]
            v = list(w)
            for j in r.sample(range(n), n // 5):
                v[j] = f"x{r.randrange(10**6)}"
            texts += [" ".join(w).encode(), " ".join(v).encode()]
        keys, _ = neardup.all_keys(texts)
        share[n] = sum(bool(set(a) & set(b)) for a, b in zip(keys[::2], keys[1::2], strict=True)) / 300
    assert share[5] == share[9] == 1 and min(share.values()) > 0.97, share
    keys, _ = neardup.all_keys([b"a b c d", b"a b X c d", b"a b c d e f g h", b"b c d e f g h"])
    assert set(keys[0]) & set(keys[1]) and set(keys[2]) & set(keys[3])


def test_no_third_text_hides_a_link(spark):
    """Texts that share a passage, and pairs among them that are links but share no shingle outside it."""
    passage, texts = " ".join(f"w{i}" for i in range(50)), []
    for i in range(150):
        w = [f"x{i}y{j}" for j in range(50)]
        texts.append(f"{passage} {' '.join(w)}")
        if i % 3 == 0:
            texts.append(f"{passage} {' '.join(f'z{i}y{j}' if j % 5 in (0, 2) else x for j, x in enumerate(w))}")
    found = neardup.sketches([t.encode() for t in texts])[0]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and (found[i] == found[j]).any() and neardup.similar(texts[i], texts[j]):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    assert len(set(label)) < 170
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert {x["doc_id"]: x["class_id"] for x in got} == dict(enumerate(label))


def passage_and_vocabulary(count=240, words=60, vocabulary=1500):
    """Texts that share a passage and, by chance, rare words; every eighth has a near copy, of which no shingle outside the passage is left."""
    r, passage, texts = random.Random(11), " ".join(f"w{i}" for i in range(50)), []
    for i in range(count):
        w = [f"v{r.randrange(vocabulary)}" for _ in range(words)]
        texts.append(f"{passage} {' '.join(w)}")
        if i % 8 == 0:
            texts.append(f"{passage} {' '.join(f'z{i}y{j}' if j % 4 == 0 else x for j, x in enumerate(w))}")
    return texts


def test_words_met_by_chance_are_dropped(spark, monkeypatch):
    """Rows of the join by rare words are of texts that may be links, not of all that have a word in common."""
    seen, real = {}, neardup.materialise

    def counted(df, tag):
        out = real(df, tag)
        seen[tag] = out.count() if tag in ("meetings", "rare") else None
        return out

    monkeypatch.setattr(neardup, "materialise", counted)
    texts = passage_and_vocabulary()
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    at = [i for i, t in enumerate(texts) if "z" in t]
    assert {x["doc_id"]: x["class_id"] for x in got} == {i: i - (i in at) for i in range(len(texts))}
    assert seen["rare"] > 200 and seen["meetings"] < 10 * seen["rare"], seen


@pytest.mark.parametrize(("few", "gathered"), [(64, 1024), (2, 1024), (64, 20), (64, 0)])
def test_meetings_keep_every_link(spark, monkeypatch, few, gathered):
    """Words that many texts have are kept whole, gathered or not: any two texts that may be a link and have a rare word in common meet."""
    monkeypatch.setattr(neardup, "FEW", few)
    monkeypatch.setattr(neardup, "GATHERED", gathered)
    r, texts = random.Random(3), passage_and_vocabulary(80, vocabulary=300)
    base = [f"b{i}" for i in range(110)]
    for i in range(60):  # near copies of one text, some links and some not, of different lengths
        w = [f"c{i}y{j}" if r.random() < 0.11 else x for j, x in enumerate(base)]
        texts.append(" ".join(w[: 110 - r.randrange(12)]))
    texts += [" ".join(f"k{i % 5}l{j}" if j % 11 else f"m{i}" for j in range(1100 + i)) for i in range(10)]  # more words than have parities
    frame = spark.createDataFrame([(i, t, i, 0, len(t.split())) for i, t in enumerate(texts)], "id long, t string, label long, `group` long, n long")
    often = neardup._often(frame)
    rare = neardup._rare(frame, often, 0.8).join(frame.drop("t"), "id")
    met: dict = {}
    for x in neardup._meetings(neardup.materialise(rare, "rare"), 0.8).collect():
        met.setdefault(x["id"], set()).add(x["word"])
    links = [(i, j) for i in range(len(texts)) for j in range(i) if neardup.similar(texts[i], texts[j])]
    assert len(links) > 100 and all(met.get(i, set()) & met.get(j, set()) for i, j in links)


def test_components_of_leaves_with_two_centres(spark):
    """Links that one round turns into two stars which share a leaf: at once, and split over two calls."""
    first, second, schema = [(4, 0), (7, 3)], [(7, 2), (4, 3)], "a long, b long"
    labels = lambda links: {x["id"]: x["label"] for x in components.components(links).collect()}
    assert labels(spark.createDataFrame(first + second, schema)) == dict.fromkeys((0, 2, 3, 4, 7), 0)
    known = components.components(spark.createDataFrame(first, schema)).where("id <> label").selectExpr("id a", "label b")
    assert labels(known.unionByName(spark.createDataFrame(second, schema))) == dict.fromkeys((0, 2, 3, 4, 7), 0)


def test_components_of_chains_over_two_calls(spark):
    schema, first, second = "a long, b long", [], []
    for i, ids in enumerate((list(range(40)), random.Random(5).sample(range(40), 40))):
        chain = [(a + 100 * i, b + 100 * i) for a, b in zip(ids, ids[1:], strict=False)]
        first, second = first + chain[::2], second + chain[1::2]
    known = components.components(spark.createDataFrame(first, schema)).where("id <> label").selectExpr("id a", "label b")
    got = {x["id"]: x["label"] for x in components.components(known.unionByName(spark.createDataFrame(second, schema))).collect()}
    assert got == {x: x // 100 * 100 for x in (*range(40), *range(100, 140))}


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {x["id"]: x["label"] for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.text("ab", max_size=6), st.text("ab", max_size=6)), min_size=1, max_size=10, unique=True))
def test_marks(rows):
    wide = 4
    rows = sorted((g, left[-(wide - 1) :], right[: wide - 1]) for g, left, right in rows)
    rows = sorted(set(rows))
    got = repeats.marks(np.array([r[0] for r in rows]), np.ones(len(rows), np.int64), [r[1].encode() for r in rows], [r[2].encode() for r in rows], wide)
    windows = lambda g, left, right: {i: (g, i, left[len(left) - i :], right[: wide - 1 - i]) for i in range(wide) if i <= len(left) and wide - 1 - i <= len(right)}
    all_ = [w for r in rows for w in windows(*r).values()]
    assert got.tolist() == [sum(1 << i for i, w in windows(*r).items() if all_.count(w) > 1) for r in rows]


@settings(max_examples=60, deadline=None)
@given(st.text("ab", min_size=1, max_size=40))
def test_matching_statistics(text):
    x = np.array([ord(c) for c in text] + [999])
    s = text + "\0"
    order = sorted(range(len(x)), key=lambda i: x[i:].tolist())
    assert repeats.suffix_array(x).tolist() == order
    want = [max((k for k in range(len(s) - i) for j in range(len(s)) if j != i and s[i : i + k] == s[j : j + k] and j + k <= len(s)), default=0) for i in range(len(s))]
    index = repeats.RunLengthIndex(x)
    assert index.matching_statistics().tolist() == want
    assert index.run_lengths.sum() == len(x)


def test_top_k(spark):
    r = np.random.default_rng(0)
    rows = [(i, r.normal(0, 0.1, 8).astype(np.float32).tolist(), 0) for i in range(300)]
    rows[7] = (7, None, 0)
    rows[9] = (9, [*rows[9][1][:7], None], 0)
    rows[11] = (11, [*rows[11][1][:7], float("nan")], 0)
    rows[100] = (100, [float("inf")] * 8, 0)
    rows += [(200, rows[200][1], 1), (301, [], 0), (None, rows[5][1], 0)] + [(400 + i, rows[0][1], 0) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, row int")
    got = topk.top_k(df, F.col("vec_id") % 100 == 0, 10, vectors=64, queries=2).collect()
    ok = [(n, k, np.floor(1024 * np.array(v, np.float64)).astype(int)) for n, (k, v, _) in enumerate(rows) if v is not None and None not in v and all(map(math.isfinite, v))]
    want = []
    for n, k, v in ok:
        if k is not None and k % 100 == 0:
            best = sorted((-int(v[: len(x)] @ x[: len(v)]), j is None, j or 0, m) for m, j, x in ok if m != n)[:10]
            want += [(k, i + 1, None if none else j, -s) for i, (s, none, j, _) in enumerate(best)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("kind, sizes", [("float", (1.0, 1e6)), ("float", (1e-3, 40000.0, 1e37)), ("double", (1.0, 1e15, 1e308))])
def test_top_k_of_large_components(spark, kind, sizes):
    """Finite components of any size take part; scores beyond 64 bits are ranked exactly."""
    r = random.Random(5)
    rows = [(i, [float(np.float32(r.gauss(0, 1) * r.choice(sizes))) if kind == "float" else r.uniform(-1, 1) * r.choice(sizes) for _ in range(4)]) for i in range(300)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    got = topk.top_k(df, F.col("vec_id") % 100 == 0, 10, vectors=64, queries=2).collect()
    ints = [[math.floor(1024 * Fraction(x)) if abs(x) < 2**50 else 1024 * int(x) for x in v] for _, v in rows]
    want = []
    for q in range(0, 300, 100):
        best = sorted((-sum(a * b for a, b in zip(ints[q], x, strict=True)), i) for i, x in enumerate(ints) if i != q)[:10]
        want += [(q, n + 1, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == want


def test_benchmark_in_many_passes(spark):
    """One item far above the size of a pass is cut into pieces with the same windows."""
    r = random.Random(8)
    item = [f"w{r.randrange(500)}" for _ in range(400)]
    items = [(1, " ".join(item)), (2, "a b c"), (3, None), (4, " ".join(item[100:108]))]
    docs = [(i, " ".join(["x"] * i + item[i * 7 : i * 7 + 9 + i % 3] + ["y a b c"] * (i % 2))) for i in range(40)] + [(50, None), (51, " ".join(item))]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(items, "item_id long, text string")
    a, b = ([(x["doc_id"], x["n_words"], x["hit_words"], x["items"]) for x in mark_benchmark(docs, items, pass_bytes=p).orderBy("doc_id").collect()] for p in (1 << 20, 500))
    assert a == b and sum(bool(x[2]) for x in a) > 20


def test_word_cells(monkeypatch):
    """Cells cover all strings of so many words once; equal strings have one anchor hash, also where a text is hashed in several stretches."""
    r = random.Random(3)
    text = lambda n: r.choice(["", " ", "\n"]) + "".join(r.choice(["a", "bc", "d" * 30, "é"]) + r.choice([" ", "  ", "\t"]) for _ in range(n))
    part = text(70).strip()
    raws = [x.encode() for x in ("", "one", text(200) + part + " " + text(90), part, text(9) + part, "ab " * 300)]
    for stretch in (repeats.STRETCH, 64):
        monkeypatch.setattr(repeats, "STRETCH", stretch)
        repeats._powers.cache_clear()
        kind = {}
        for raw in raws:
            start, stop = repeats.word_bounds(np.frombuffer(raw, np.uint8))
            want = [(s, e) for s, e in zip(start.tolist(), stop[50:].tolist())]
            got = []
            for k, s, n, _ in repeats.word_cells(raw):
                own = [(a, z) for a, z in want if s <= a and z <= s + n]
                assert own[0][0] == s and own[-1][1] == s + n
                for a, z in own:
                    assert kind.setdefault(raw[a:z], k) == k
                got += own
            assert got == want
    repeats._powers.cache_clear()
