import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.functions import hashes, kernels


@pytest.mark.parametrize("data, want", [
    (bytes(4759), [4759]), (bytes(4760), [4752, 8]), (bytes(4765), [4757, 8]), (bytes(10000), [4767, 4767, 466]), (bytes(4759) + b"\1", [4760]), (b"", [])])
def test_ae_vectors(data, want):
    assert kernels.ae_cuts(data) == want


@pytest.mark.parametrize("data, want", [(bytes(65537), [65536, 1]), (b"a" * 2048, [2048]), (b"a", [1]), (b"", [])])
def test_rabin_vectors(data, want):
    assert kernels.rabin_cuts(data) == want


def slow_ae(d):
    out, at = [], 0
    while at < len(d):
        r = d[at:]
        n, end, m, i = len(r), len(r) - 8, 0, 1
        cut = n
        if n >= kernels.AE_WINDOW - 8:
            value = lambda k: int.from_bytes(r[k : k + 8], "little")  # noqa: B023, E731
            while i <= end:
                if value(i) > value(m):
                    m = i
                elif i == min(int(m + kernels.AE_WINDOW), end):
                    cut = i
                    break
                i += 1
        out.append(cut)
        at += cut
    return out


@pytest.mark.parametrize("seed", range(4))
def test_ae_equals_loop(seed):
    r = random.Random(seed)
    d = bytes(r.choice(b"abcdef ") if seed % 2 else r.randrange(256) for _ in range(20000))
    assert kernels.ae_cuts(d) == slow_ae(d)


def test_fingerprint_equals_rolling():
    d = random.Random(5).randbytes(300)
    p = kernels.RABIN_POLYNOMIAL
    out = [kernels._modulo(int.from_bytes(d[i : i + 48], "big"), p) for i in range(len(d) - 47)]
    assert kernels.fingerprints(np.frombuffer(d, np.uint8), 32).tolist() == [x & 0xFFFFFFFF for x in out]
    assert kernels.fingerprints(np.frombuffer(d, np.uint8), 16).tolist() == [x & 0xFFFF for x in out]


def test_rabin_bounds_and_locality():
    d = random.Random(6).randbytes(300_000)
    cuts = kernels.rabin_cuts(d)
    assert sum(cuts) == len(d) and all(2048 <= c <= 65536 for c in cuts[:-1])
    ends = lambda c: set(np.cumsum(c).tolist())
    moved = {e - 100 for e in ends(kernels.rabin_cuts(random.Random(7).randbytes(100) + d))}
    assert len(ends(cuts) & moved) >= len(cuts) - 4


def test_features():
    p = kernels.FeatureParams()
    assert kernels.features(bytes(100), p).tolist() == p.add.tolist()
    assert kernels.features(bytes(47), p).tolist() == [0] * 4
    f = kernels.features(b"abc" * 100, p)
    want = [hashes.spooky64(f[2 * i : 2 * i + 2].tobytes(), 0x7FF) for i in range(2)]
    assert [int(x) & hashes.M64 for x in kernels.super_features([b"abc" * 100], p)[0]] == want
    wide = kernels.FeatureParams(4, 16)
    f = kernels.features(b"abc" * 100, wide)
    assert [int(x) & hashes.M64 for x in kernels.super_features([b"abc" * 100], wide)[0]] == [hashes.spooky64(f[16 * i : 16 * i + 16].tobytes(), 0x7FF) for i in range(4)]


def test_fnv():
    assert hashes.fnv1(b"foobar") == 0x340D8765A4DDA9C2
    assert hashes.fnv1(b"foobar", xor_first=True) == 0x85944171F73967E8
    assert hashes.fnv1(b"foobar", 32) == 0x31F0B262
    assert hashes.fnv1(b"foobar", 32, xor_first=True) == 0xBF9CF968
    assert hashes.fnv1(b"bar", basis=hashes.fnv1(b"foo")) == hashes.fnv1(b"foobar")


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=30), max_size=12))
def test_fnv_many(rows):
    assert hashes.fnv1_64_many(rows).tolist() == [hashes.fnv1(r) for r in rows]


@pytest.mark.parametrize("size", [0, 1, 15, 16, 31, 32, 63, 191, 192, 500])
def test_spooky_parts(size):
    d = random.Random(size).randbytes(size)
    s = hashes.Spooky(1, 2)
    for i in range(0, size, 37):
        s.update(d[i : i + 37])
    assert s.final() == hashes.spooky128(d, 1, 2)
    assert hashes.spooky64(d) != hashes.spooky64(d + b"\0")
