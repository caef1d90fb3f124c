"""Queries over chunks of long documents against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from siltstone import queries
from siltstone.functions.kernels import CUTTERS, FeatureParams, super_features

from .test_grouping import greedy

_R = random.Random(4)
_TEXT = lambda n: "".join(_R.choice("abcdefghijklmnop ") for _ in range(n))
_SHARED = _TEXT(90000)
ROWS = [(1, _TEXT(20000) + _SHARED, "en"), (2, _SHARED + _TEXT(15000), "en"), (3, "short", "fr"), (4, _TEXT(30000), "fr"), (5, "short", "en"), (6, "", "en"), (7, None, "fr"), (8, _TEXT(7000) + _SHARED[3000:60000] + "!" + _SHARED[60001:], "fr")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("long"))
    spark.createDataFrame(ROWS, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("method", ["ae", "rabin"])
def test_chunked(spark, folder, method):
    chunks = []
    for k, t, lang in ROWS:
        raw, at = (t or "").encode(), 0
        for seq, n in enumerate(CUTTERS[method](raw)):
            chunks.append((k, seq, raw[at : at + n], hashlib.sha1(raw[at : at + n]).hexdigest(), lang))
            at += n
    first, place, end = {}, {}, 0
    for c in chunks:
        if c[3] not in first:
            first[c[3]], place[c[3]] = c, end
            end += len(c[2])
    of = Counter(c[3] for c in chunks)
    assert len(first) < len(chunks) - 5 and max(c[1] for c in chunks) > 5  # parts of long documents repeat
    run = lambda name: sorted(tuple(r) for r in queries.QUERIES[f"{method}_{name}"](spark, folder).collect())
    assert run("dedup_first") == sorted((h, c[0], len(c[2]), of[h]) for h, c in first.items())
    assert run("dup_occurrences") == sorted((c[0], first[c[3]][0], c[3]) for c in chunks if c is not first[c[3]])
    assert run("dup_group_sizes") == sorted(Counter(of.values()).items())
    want = []
    for lang in ("en", "fr"):
        own = [c for c in chunks if c[4] == lang]
        once = [c for c in own if c is first[c[3]]]
        want.append((lang, len(own), len(once), sum(len(c[2]) for c in own), sum(len(c[2]) for c in once)))
    assert run("dedup_by_lang") == want
    if method == "ae":
        assert sorted(tuple(r) for r in queries.flagship(spark, folder).collect()) == want
    assert run("stream_ingest") == sorted((h, len(c[2])) for h, c in first.items())
    assert run("layout_arrival") == sorted((h, i, place[h], len(c[2])) for i, (h, c) in enumerate(first.items()))
    assert run("recipe_rewrite") == sorted((c[0], c[1], place[c[3]], len(c[2])) for c in chunks)
    stats = queries.QUERIES[f"{method}_job_stats"](spark, folder).first()
    assert (stats.chunks, stats.unique_chunks, stats.unique_bytes) == (len(chunks), len(first), end)
    back = {r.h for r in queries.QUERIES[f"{method}_container_roundtrip"](spark, folder).collect()}
    assert {hashlib.sha1(t.encode()).hexdigest() for _, t, _ in ROWS if t} <= back
    params = FeatureParams()
    leaders = greedy([((c[0], c[1]), sf) for c, sf in zip(first.values(), [list(x) for x in super_features([c[2] for c in first.values()], params)], strict=True)])
    assert run("similar_leaders") == sorted((*a, *b) for a, b in leaders.items())
