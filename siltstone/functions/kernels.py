"""Byte kernels over one payload: content-defined cuts and resemblance features, vectorised in numpy.

The Rabin fingerprint of a 48-byte window is linear: the XOR over k of byte[i - k] * x**(8 k) modulo
the polynomial.  At every legal cut the window is full, so cut candidates don't depend on where a
chunk starts and all fingerprints are found at once by 48 table lookups."""

from __future__ import annotations

import numpy as np

from .hashes import spooky64_words

# Chunker and feature parameters.
AE_WINDOW = 8 * 1024 / 1.7183
RABIN_POLYNOMIAL = 0xBFE6B8A5BF378D83
RABIN_WINDOW = 48
RABIN_MIN, RABIN_MAX = 2048, 65536
RABIN_MASK, RABIN_MARK = 0x1FFF, 0x78
FEATURE_SEED = 0x7FF


def _modulo(x: int, p: int) -> int:
    size = p.bit_length()
    while x.bit_length() >= size:
        x ^= p << (x.bit_length() - size)
    return x


def _tables(dtype) -> np.ndarray:
    """48 x 256: byte * x**(8 k) modulo the polynomial, low bits."""
    out = np.zeros((RABIN_WINDOW, 256), np.uint64)
    for k in range(RABIN_WINDOW):
        bit = [_modulo(1 << (8 * k + i), RABIN_POLYNOMIAL) for i in range(8)]
        for b in range(256):
            v = 0
            for i in range(8):
                if b >> i & 1:
                    v ^= bit[i]
            out[k, b] = v
    return out.astype(dtype)


_T16, _T32 = None, None


def fingerprints(data: np.ndarray, bits: int) -> np.ndarray:
    """Low 16 or 32 bits of the fingerprints of all full windows; entry i is of the window that ends at byte i + 47."""
    global _T16, _T32
    if _T16 is None:
        _T16, _T32 = _tables(np.uint16), _tables(np.uint32)
    table = _T16 if bits == 16 else _T32
    n = len(data) - RABIN_WINDOW + 1
    if n <= 0:
        return np.zeros(0, table.dtype)
    out = np.empty(n, table.dtype)
    for s in range(0, n, 1 << 16):  # stays in cache
        e = min(n, s + (1 << 16))
        acc = table[RABIN_WINDOW - 1][data[s:e]]
        for k in range(RABIN_WINDOW - 1):
            at = RABIN_WINDOW - 1 - k
            acc ^= table[k][data[s + at : e + at]]
        out[s:e] = acc
    return out


def rabin_cuts(raw: bytes) -> list[int]:
    """Chunk lengths: the first length of at least RABIN_MIN whose last window has the mark, else RABIN_MAX, else the rest."""
    n, out, at = len(raw), [], 0
    if not n:
        return out
    marks = np.flatnonzero((fingerprints(np.frombuffer(raw, np.uint8), 16) & RABIN_MASK) == RABIN_MARK) + RABIN_WINDOW  # ends
    while at < n:
        i = int(np.searchsorted(marks, at + RABIN_MIN))
        end = min(n, at + RABIN_MAX, int(marks[i]) if i < len(marks) else n)
        out.append(end - at)
        at = end
    return out


def ae_cuts(raw: bytes) -> list[int]:
    """Chunk lengths by asymmetric extremum: the cut is where the leftmost greatest 8-byte value has held for a whole window."""
    n, out, at, window = len(raw), [], 0, int(AE_WINDOW)
    value = np.ndarray((max(0, n - 7),), "<u8", raw, 0, (1,)) if n >= 8 else None
    while at < n:
        rest = n - at
        if rest < AE_WINDOW - 8:
            out.append(rest)
            break
        end, best = rest - 8, 0
        while True:
            edge = min(best + window, end)
            ahead = value[at + best + 1 : at + edge + 1] > value[at + best]
            k = int(ahead.argmax()) if len(ahead) else 0
            if not len(ahead) or not ahead[k]:
                cut = edge
                break
            best += 1 + k
            if best == end:
                cut = rest
                break
        out.append(cut)
        at += cut
    return out


CUTTERS = {"ae": ae_cuts, "rabin": rabin_cuts, "whole": lambda raw: [len(raw)] if raw else []}


class FeatureParams:
    """`groups` super-features of `width` features each; coefficients (odd multiplier, addend) come from a seeded generator, one pair a feature."""

    def __init__(self, groups: int = 2, width: int = 2, seed: int = 48):
        r = np.random.default_rng(seed)
        self.groups, self.width = groups, width
        self.multiply = r.integers(0, 1 << 32, groups * width, dtype=np.uint32) | np.uint32(1)
        self.add = r.integers(0, 1 << 32, groups * width, dtype=np.uint32)


def features(raw: bytes, params: FeatureParams) -> np.ndarray:
    """The greatest value of each linear map over all window fingerprints; 0 for payloads shorter than a window."""
    fp = fingerprints(np.frombuffer(raw, np.uint8), 32)
    out = np.zeros(len(params.add), np.uint64)
    for j in range(len(out) if len(fp) else 0):
        out[j] = (fp * params.multiply[j] + params.add[j]).max()
    return out


def super_features(rows: list[bytes], params: FeatureParams) -> np.ndarray:
    """rows x groups, as signed 64-bit patterns."""
    f = np.array([features(x, params) for x in rows], np.uint64).reshape(len(rows) * params.groups, params.width)
    if params.width % 2:
        f = np.concatenate([f, np.zeros((len(f), 1), np.uint64)], 1)
    return spooky64_words(np.ascontiguousarray(f), FEATURE_SEED).reshape(len(rows), params.groups).view(np.int64)
