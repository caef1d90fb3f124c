"""The pipeline's stages against brute force on what each gets."""

import corpus_pipeline as p
import pytest

from siltstone.llm import decontaminate, neardup, repeats

from .fixtures import documents, saved

ROWS = documents(3)
ITEMS = [(1, ROWS[5][1]), (2, ROWS[9][1])]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = saved(spark, ROWS, str(tmp_path_factory.mktemp("docs")), ITEMS, extra=False)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = {"": docs.collect()}
    for name, f in p.STAGES:
        path = f"{folder}/{name}"
        f(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs.collect()
    return out


def test_columns(stages):
    for name, _ in p.STAGES[:-1]:
        assert list(stages[name][0].asDict()) == p.COLUMNS


def test_language(stages):
    kept = {(r.doc_id, r.text) for r in stages["language_id"]}
    assert {r.doc_id for r in stages[""] if r.text and r.text.startswith("the ")} <= {k for k, _ in kept}
    assert not any(t is None or t.strip(" \n\t.") == "" for _, t in kept)


def test_near_duplicates(stages):
    before, after = stages["language_id"], stages["near_duplicates"]
    named = [r for r in after if r.doc_id is not None]
    assert len({r.doc_id for r in named}) == len(named)
    for r in before:
        assert r.doc_id is None or any(r.text == k.text or neardup.similar(r.text, k.text) for k in after)
    for i, a in enumerate(named):
        assert not any(a.text == b.text for b in named[:i])


def test_repeats(stages):
    before, after = {r.doc_id: r.text for r in stages["near_duplicates"]}, {r.doc_id: r for r in stages["repeated_passages"]}
    assert set(before) == set(after)
    size, seen = p.PASSAGE, {}
    for t in before.values():
        raw = t.encode()
        for i in range(len(raw) - size + 1):
            seen[raw[i : i + size]] = seen.get(raw[i : i + size], 0) + 1
    for k, t in before.items():
        raw = t.encode()
        hit = [(i, i + 1) for i in range(len(raw) - size + 1) if seen[raw[i : i + size]] > 1]
        at, out = 0, b""
        for s, e in repeats.covered(hit, size):
            out, at = out + raw[at:s], e
        want = (out + raw[at:]).decode("utf-8", "ignore")
        assert after[k].text == want and after[k].n_chars == len(want)


def test_benchmark(stages):
    items = [decontaminate.words_of(t) for _, t in ITEMS]
    windows = {tuple(w[j : j + 10]) for w in items for j in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    clean = []
    for r in stages["repeated_passages"]:
        w = decontaminate.words_of(r.text)
        if not any(tuple(w[j : j + n]) in windows for n in sizes for j in range(len(w) - n + 1)):
            clean.append(str(r))
    assert sorted(clean) == sorted(str(r) for r in stages["benchmark_passages"])


def test_packing(stages):
    assert {r.doc_id for r in stages["best_fit_packing"]} == {r.doc_id for r in stages["benchmark_passages"]}


def test_repeats_of_short_words(spark):
    """A passage of 51 words goes at whatever length in bytes, one of 50 short words stays."""
    one, two = " ".join("abcdefghij"[i % 7 + i % 4] for i in range(51)), " ".join("klmnopqrst"[i % 7 + i % 4] + "u" for i in range(50))
    rows = [(1, f"first {one} end of it {two} here"), (2, f"second {one}\nother words {two}"), (3, "Nothing repeats here. " + " ".join(map(str, range(70))))]
    docs = spark.createDataFrame([(k, t, "en", "src", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in p.repeated_passages(spark, docs, "").collect()}
    assert len(one.encode()) == 101
    want = {1: f"first  end of it {two} here", 2: f"second \nother words {two}", 3: rows[2][1]}
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_chars == len(want[k]) for k, r in got.items())


def test_near_duplicates_with_one_id(spark):
    """Different texts under one id each stay, also beside classes; copies without an id go."""
    text = lambda a, n=40: " ".join(f"{a}{i}" for i in range(n))
    rows = [(1, text("a")), (1, text("b")), (2, text("b")), (2, text("c")), (0, text("c") + " more"), (None, text("a")), (None, text("d")), (None, text("d")), (3, text("e")), (3, text("e"))]
    docs = spark.createDataFrame([(k, t, "en", "src", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in p.near_duplicates(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(1, text("a")), (1, text("b")), (0, text("c") + " more"), (None, text("d")), (3, text("e"))], key=str)
