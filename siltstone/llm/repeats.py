"""Operator 5, removal of repeated byte strings: a run-length index over compressed texts.

Every string of `LENGTH` bytes (a window) that starts at two places or more is found exactly; each byte
it covers is removed.  Matches never cross texts.

1. A window's anchor is the leftmost least hash among its `GRAM`-byte substrings.  Equal windows have
   equal anchors at equal offsets, so a text falls into cells, runs of windows with one anchor hash.
   Cells are grouped by anchor hash.  A hash with one cell has only unique windows, one whose cells
   are all equal has only repeated windows; neither needs an index.
2. The other, mixed cells are cut by anchor offset into sub-cells of up to `WIDE` windows.  The bytes
   that all windows of a sub-cell share are its core; equal windows have equal cores, so a core becomes
   one symbol and only up to WIDE - 1 bytes on either side are left: a window of LENGTH bytes is then
   a string of exactly WIDE symbols.
3. These compressed texts, grouped by core and each kept once with its number of occurrences, are
   indexed: from a suffix array come the runs of the Burrows-Wheeler transform, and text positions are
   sampled at both ends of every run.  Matching statistics are streamed in text order: at a sampled
   position the common prefix with the neighbouring suffix is compared, and where the next position is
   inside a run it is one less.  A statistic of WIDE or more marks a window that occurs elsewhere.
   A group of more than `GROUP` different compressed texts is halved first: of a window's WIDE - 1 bytes
   beside the core, half or more are on its left or its right, and these join the core.  So windows of
   half the width are looked for in finer groups, again and again, until a window is all core.
4. Marks go back to the texts, whose covered bytes are removed.

A number of words may be given besides: then repeated strings of so many words (between ASCII white space)
go too where they are shorter than LENGTH.  These are counted one by one by 128-bit hash; longer ones hold a window.
Or such strings, of any length in bytes, are counted apart and nothing more goes: words then make cells as bytes do,
anchored at the least hash of `GRAM_WORDS` words, and only the strings of mixed cells are counted one by one.

`LENGTH` may be any from 128 bytes on.  Hashes stand for equality only at 128 bits.

Defined cases: a null text counts as empty: nothing is removed; texts shorter than LENGTH lose nothing;
repeated rows are repeats of each other; a text may repeat itself, and overlapping occurrences count;
an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, partitions, read_table, small_batches

LENGTH = 400
GRAM = 24
WIDE = 64
GROUP = 10_000
#: Words of a passage that is counted apart, and of its anchor.
WORDS = 51
GRAM_WORDS = 8
#: Bytes of a text hashed at a time.
STRETCH = 1 << 19

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_FAR = _U(0xFFFFFFFFFFFFFFFF)
_WORDS = np.ones(256, bool)
_WORDS[[0x20, *range(0x09, 0x0E)]] = False
_POS = 20  # bits of a position in a stretch


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> _U(32)) * _U(0xD6E8FEB86659FD93)
    return h ^ h >> _U(32)


def _grams(b: np.ndarray) -> np.ndarray:
    """Hashes of all substrings of 24 bytes, by doubling."""
    power = lambda n: _U(pow(_BASE, n, 1 << 64))
    h, size, by_size = b.astype(np.uint64) + _U(1), 1, {}
    with np.errstate(over="ignore"):
        while size < 16:
            h = h[:-size] * power(size) + h[size:]
            size *= 2
            by_size[size] = h
        h = h[:-8] * power(8) + by_size[8][16:]
        return _mixed(h)


def _least(h: np.ndarray, wide: int) -> np.ndarray:
    """The position of the leftmost least of every `wide` hashes in a row; h is one stretch."""
    v = h >> _U(_POS) << _U(_POS) | np.arange(len(h), dtype=np.uint64)
    n = len(h) - wide + 1
    x = np.full(-(-len(h) // wide) * wide, _FAR)
    x[: len(h)] = v
    x = x.reshape(-1, wide)
    ahead = np.minimum.accumulate(x, 1).reshape(-1)
    back = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].reshape(-1)
    return (np.minimum(back[:n], ahead[wide - 1 : wide - 1 + n]) & _U((1 << _POS) - 1)).astype(np.int64)


def _anchors(b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor position of each window and all substring hashes; b is one stretch."""
    h = _grams(b)
    return _least(h, length - GRAM + 1), h


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.flatnonzero(np.diff(x)) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(x)]])


def cells(raw: bytes, length: int = LENGTH) -> Iterator[tuple[int, int, int, bool]]:
    """(anchor hash, first window, windows, whether several places hold that hash) for the cells of a text."""
    for base in range(0, max(0, len(raw) - length + 1), STRETCH):
        b = np.frombuffer(raw, np.uint8)[base : base + STRETCH + length - 1]
        at, h = _anchors(b, length)
        kind = h[at]
        start, stop = _runs(kind)
        several = at[start] != at[stop - 1]
        yield from zip(kind[start].view(np.int64).tolist(), (start + base).tolist(), (stop - start).tolist(), several.tolist(), strict=True)


def word_bounds(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first byte of each word and the byte after it."""
    inside = np.zeros(len(b) + 2, bool)
    inside[1:-1] = _WORDS[b]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


@functools.cache
def _powers(base: int) -> np.ndarray:
    out = np.full(STRETCH, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _spans_hashed(b: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the bytes in spans (both sorted), from sums over all bytes before; a stretch of bytes at a time."""
    if len(b) < STRETCH:
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b + _U(1)) * _powers(_BACK)[: len(b)], out=sums[1:])
        return _mixed((sums[stop] - sums[start]) * _powers(_BASE)[start])
    total, at_start, at_stop = 0, np.zeros(len(start), np.uint64), np.zeros(len(stop), np.uint64)
    for base in range(0, len(b) + 1, STRETCH):
        x = b[base : base + STRETCH].astype(np.uint64) + _U(1)
        x *= _powers(_BACK)[: len(x)]
        sums = np.concatenate([[_U(total)], np.cumsum(x, dtype=np.uint64) * _U(pow(_BACK, base, 1 << 64)) + _U(total)])
        for at, out in ((start, at_start), (stop, at_stop)):
            own = slice(*np.searchsorted(at, (base, base + STRETCH)))
            out[own] = sums[at[own] - base]
        total = int(sums[-1])
    power = np.fromiter((pow(_BASE, i * STRETCH, 1 << 64) for i in range(len(b) // STRETCH + 1)), np.uint64)
    return _mixed((at_stop - at_start) * _powers(_BASE)[start % STRETCH] * power[start // STRETCH])


def word_cells(raw: bytes, words: int = WORDS) -> Iterator[tuple[int, int, int, bool]]:
    """(anchor hash, first byte, bytes, whether several places hold that hash) for the cells of a text's strings of so many words."""
    b = np.frombuffer(raw, np.uint8)
    start, stop = word_bounds(b)
    gram = min(GRAM_WORDS, words)
    wide, n = words - gram + 1, len(start) - words + 1
    if n < 1:
        return
    h = _spans_hashed(b, start[: len(start) - gram + 1], stop[gram - 1 :])
    for base in range(0, n, STRETCH):
        own = h[base : base + STRETCH + wide - 1]
        at = _least(own, wide)
        kind = own[at]
        s, e = _runs(kind)
        first = start[base + s]
        several = at[s] != at[e - 1]
        yield from zip(kind[s].view(np.int64).tolist(), first.tolist(), (stop[base + e + words - 2] - first).tolist(), several.tolist(), strict=True)


def sub_cells(x: bytes, length: int = LENGTH) -> Iterator[tuple[int, int, bytes, bytes, bytes]]:
    """(anchor position, offset group, core, left bytes, right bytes) of the sub-cells of a mixed cell's bytes."""
    for base in range(0, len(x) - length + 1, STRETCH):
        at, _ = _anchors(np.frombuffer(x, np.uint8)[base : base + STRETCH + length - 1], length)
        start, stop = _runs(at)
        for p, s, e in zip((at[start] + base).tolist(), (start + base).tolist(), (stop + base).tolist(), strict=True):
            low, high = p - (e - 1), p - s  # offsets of the anchor in these windows
            for g in range(low // WIDE, high // WIDE + 1):
                a, z = max(low, g * WIDE), min(high, g * WIDE + WIDE - 1)
                edge, end = p - g * WIDE, p - g * WIDE - WIDE + 1 + length
                yield p, g, x[edge:end], x[p - z : edge], x[end : p - a + length]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions in order of their suffixes, by prefix doubling; only positions whose order is open are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    new = np.concatenate([[True], np.diff(text[order]) != 0])
    rank = np.empty(n + 1, np.int64)
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = first + 1  # a rank is its group's first place, plus 1; past the end it is 0
    rank[n] = 0
    size = 1
    while True:
        stop = np.append(new[1:], True)
        open_ = np.flatnonzero(~(new & stop))
        if not len(open_):
            return order
        own = order[open_]
        key = rank[own] << np.int64(32) | rank[np.minimum(own + size, n)]
        by = np.argsort(key, kind="stable")
        order[open_] = own[by]
        key = key[by]
        fresh = np.concatenate([[True], np.diff(key) != 0])
        new[open_] = fresh
        rank[order[open_]] = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(open_)), 0))] + 1
        size *= 2


class RunLengthIndex:
    """Run-length BWT of a text of symbols in which every separator is a symbol of its own, with text positions sampled at both ends of every run."""

    def __init__(self, text: np.ndarray):
        self.text = text
        order = suffix_array(text)
        last = text[order - 1]  # the text's first position follows its last symbol, a separator
        head = np.concatenate([[True], last[1:] != last[:-1]])
        self.run_symbols, self.run_lengths = last[head], np.diff(np.append(np.flatnonzero(head), len(text)))
        ends = np.cumsum(self.run_lengths) - 1
        starts = ends - self.run_lengths + 1
        # text positions at run heads with the suffix before each, and at run ends with the suffix after each
        self.heads = order[starts], np.where(starts > 0, order[starts - 1], -1)
        after = ends + 1 < len(order)
        self.ends = order[ends], np.where(after, order[np.minimum(ends + 1, len(order) - 1)], -1)

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of the suffixes at a and b (b -1: none)."""
        out, live, k, n = np.zeros(len(a), np.int64), np.flatnonzero(b >= 0), 0, len(self.text)
        while len(live):
            x, y = a[live] + k, b[live] + k
            ok = (x < n) & (y < n)
            ok[ok] = self.text[x[ok]] == self.text[y[ok]]
            live = live[ok]
            k += 1
            out[live] = k
        return out

    def matching_statistics(self) -> np.ndarray:
        """For every position, the longest string from there that also starts elsewhere."""
        best = np.zeros(len(self.text), np.int64)
        at = np.arange(len(self.text))
        for places, others in (self.heads, self.ends):
            value = np.full(len(self.text), -1, np.int64)
            value[places] = self._common(places, others)
            known = np.maximum.accumulate(np.where(value >= 0, at, 0))
            best = np.maximum(best, value[known] - (at - known))
        return best


def marks(group: np.ndarray, times: np.ndarray, left: list[bytes], right: list[bytes], wide: int = WIDE) -> np.ndarray:
    """For compressed texts (core's number, occurrences, bytes before and after the core): bit i is set if the window with i bytes before the core occurs twice or more."""
    n = len(left)
    nl, nr = np.fromiter(map(len, left), np.int64, n), np.fromiter(map(len, right), np.int64, n)
    size = nl + nr + 2
    start = np.cumsum(size) - size
    text = np.empty(int(size.sum()), np.int64)
    flat = np.frombuffer(b"".join(x for pair in zip(left, right, strict=True) for x in pair), np.uint8)
    core = start + nl
    plain = np.ones(len(text), bool)
    plain[core] = plain[start + size - 1] = False
    text[plain] = flat
    text[core] = 256 + group
    text[start + size - 1] = 256 + int(group.max(initial=0)) + 1 + np.arange(n)
    long = RunLengthIndex(text).matching_statistics() >= wide
    out = np.zeros(n, np.uint64)
    for i in range(wide):
        has = (i <= nl) & (wide - 1 - i <= nr)
        hit = has & (long[np.where(has, core - i, 0)] | (times > 1))
        out |= hit.astype(np.uint64) << _U(i)
    return out


def covered(windows: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal byte spans covered by runs of windows (first, past the last)."""
    out: list[list[int]] = []
    for s, e in sorted(windows):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e - 1 + length)
        else:
            out.append([s, e - 1 + length])
    return [(s, e) for s, e in out]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch as one."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _measured(spans: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's spans (first, n): the maximal runs, touching ones as one, and the bytes they cover."""
    size = spans.value_lengths().to_numpy(zero_copy_only=False)
    flat = spans.flatten()
    far = np.repeat(np.arange(len(size)), size) << np.int64(40)  # rows lie apart
    start = flat.field("first").to_numpy() + far
    by = np.argsort(start, kind="stable")
    start, stop = start[by], np.maximum.accumulate((start + flat.field("n").to_numpy())[by])
    new = np.flatnonzero(np.concatenate([[True], start[1:] > stop[:-1]])[: len(start)])
    row = start[new] >> np.int64(40)
    covers = stop[np.append(new[1:], len(start))[: len(new)] - 1] - start[new]
    runs, total = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    np.add.at(runs, row, 1)
    np.add.at(total, row, covers)
    return runs, total


def _mask_runs(p: int, g: int, mask: int) -> list[tuple[int, int]]:
    """Windows of a sub-cell's mask, as runs."""
    out = []
    i, bits = 0, mask & 0xFFFFFFFFFFFFFFFF
    while bits:
        skip = (bits & -bits).bit_length() - 1
        bits >>= skip
        i += skip
        size = (~bits & (bits + 1)).bit_length() - 1
        first = p - (g * WIDE + i + size - 1)
        out.append((first, first + size))
        bits >>= size
        i += size
    return out


def _halves(digests: list[bytes]) -> list[pa.Array]:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return [pa.array(both[:, 0]), pa.array(both[:, 1])]


def _list_cells(df: DataFrame, text: str, length: int, words: int = 0) -> DataFrame:
    """Cells of all texts: anchor hash, 128-bit hash of the cell's bytes, the text's hash, first window, windows, several, occurrences, whether it is a cell
    of bytes; of words: its first byte and its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for b in batches:
            texts: dict[str, int] = {}
            for t in b.column("t").to_pylist():
                texts[t] = texts.get(t, 0) + 1
            kind, own, whose, first, n, several, times, plain = [], [], [], [], [], [], [], []
            for t, m in texts.items():
                raw = t.encode("utf-8", "surrogatepass")
                name = digest(raw)
                for by, more, found in ((True, length - 1, cells(raw, length)), (False, 0, word_cells(raw, words) if words else ())):
                    for k, s, z, many in found:
                        kind.append(k)
                        own.append(digest(raw[s : s + z + more]))
                        whose.append(name)
                        first.append(s)
                        n.append(z)
                        several.append(many)
                        times.append(m)
                        plain.append(by)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind, pa.int64()), *_halves(own), *_halves(whose), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(several, pa.bool_()), pa.array(times, pa.int64()), pa.array(plain, pa.bool_())],
                ["kind", "h1", "h2", "t1", "t2", "first", "n", "several", "times", "plain"])

    long = df.where(F.octet_length(text) >= (min(length, 2 * words - 1) if words else length)).select(F.col(text).alias("t"))
    return long.mapInArrow(run, "kind long, h1 long, h2 long, t1 long, t2 long, first long, n long, several boolean, times long, plain boolean")


def _hash_texts(df: DataFrame, key: str, text: str, carry: list[str]) -> DataFrame:
    frame = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.struct(*[F.col(c).alias(f"c{j}") for j, c in enumerate(carry)], F.lit(0).alias("none")).alias("rest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            names = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("t"), b.column("rest"), *_halves(names)], ["k", "t", "rest", "t1", "t2"])

    return frame.mapInArrow(run, ", ".join(f"{n} {frame.schema[n].dataType.simpleString()}" for n in ("k", "t", "rest")) + ", t1 long, t2 long")


def short_passages(raw: bytes, words: int, length: int) -> list[tuple[int, int]]:
    """(first byte, bytes) of all strings of so many words that are shorter than `length`."""
    start, stop = word_bounds(np.frombuffer(raw, np.uint8))
    size = stop[words - 1 :] - start[: max(0, len(start) - words + 1)]
    own = np.flatnonzero(size < length)
    return list(zip(start[own].tolist(), size[own].tolist(), strict=True))


def _list_short(df: DataFrame, text: str, words: int, length: int) -> DataFrame:
    """(t1, t2, spans): the strings of so many words, shorter than `length`, that several places hold, by the text's hash."""
    frame = df.where(F.octet_length(text) >= 2 * words - 1).select(F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for b in batches:
            own, name, first, n = [], [], [], []
            for t in b.column("t").to_pylist():
                raw = t.encode("utf-8", "surrogatepass")
                found = short_passages(raw, words, length)
                if found:
                    own += [digest(raw[s : s + z]) for s, z in found]
                    name += [digest(raw)] * len(found)
                    first += [s for s, _ in found]
                    n += [z for _, z in found]
            yield pa.RecordBatch.from_arrays([*_halves(own), *_halves(name), pa.array(first, pa.int64()), pa.array(n, pa.int64())], ["h1", "h2", "t1", "t2", "first", "n"])

    listed = materialise(frame.mapInArrow(run, "h1 long, h2 long, t1 long, t2 long, first long, n long"), "short")
    twice = materialise(listed.groupBy("h1", "h2").agg(F.count("*").alias("all")).where("all > 1").select("h1", "h2"), "twice")  # so that the join can split a hot one
    out = materialise(listed.join(twice, ["h1", "h2"]).groupBy("t1", "t2").agg(F.collect_set(F.struct("first", "n")).alias("spans")), "spans")
    discard(listed, twice)
    return out


def _list_loose(pending: DataFrame, words: int) -> DataFrame:
    """(id, spans): the strings of so many words in the mixed cells of pending texts that several places hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        own, ids, first, n = [], [], [], []

        def taken() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([*_halves(own), *[pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (ids, first, n)]], ["h1", "h2", "id", "first", "n"])
            for x in (own, ids, first, n):
                x.clear()
            return out

        for b in batches:
            for i, t, loose in zip(b.column("id").to_pylist(), b.column("t").to_pylist(), b.column("loose").to_pylist(), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                for c in loose:
                    x = raw[c["first"] : c["first"] + c["n"]]
                    start, stop = word_bounds(np.frombuffer(x, np.uint8))
                    start, stop = start[: len(start) - words + 1], stop[words - 1 :]
                    own += [digest(x[s:e]) for s, e in zip(start.tolist(), stop.tolist(), strict=True)]
                    first.append(start + c["first"])
                    n.append(stop - start)
                    ids.append(np.full(len(start), i))
                    if len(own) > 1 << 16:
                        yield taken()
        yield taken()

    listed = materialise(pending.mapInArrow(run, "h1 long, h2 long, id long, first long, n long"), "loose")
    twice = materialise(listed.groupBy("h1", "h2").agg(F.count("*").alias("all")).where("all > 1").select("h1", "h2"), "twice")  # so that the join can split a hot one
    out = materialise(listed.join(twice, ["h1", "h2"]).groupBy("id").agg(F.collect_list(F.struct("first", "n")).alias("found")), "spans")
    discard(listed, twice)
    return out


def _list_sub_cells(pending: DataFrame, length: int, with_bytes: bool) -> DataFrame:
    """Sub-cells of the mixed cells of pending texts: core hash, hash of the compressed text, and either that text or its place."""
    more = "left binary, right binary" if with_bytes else "id long, p long, g int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for b in batches:
            core, own, cols = [], [], ([], [], [])
            for i, t, mixed in zip(b.column("id").to_pylist(), b.column("t").to_pylist(), b.column("mixed").to_pylist(), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                for c in mixed:
                    s = c["first"]
                    for p, g, middle, left, right in sub_cells(raw[s : s + c["n"] - 1 + length], length):
                        name = digest(b"%d " % g + middle)
                        core.append(name)
                        own.append(digest(b"%s%d %s%s" % (name, len(left), left, right)))
                        for col, x in zip(cols, (left, right) if with_bytes else (i, s + p, g)):  # noqa: B905
                            col.append(x)
            if with_bytes:
                rest, names = [pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary())], ["left", "right"]
            else:
                rest, names = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())], ["id", "p", "g"]
            yield pa.RecordBatch.from_arrays([*(_halves(core) if with_bytes else []), *_halves(own), *rest], [*(["g1", "g2"] if with_bytes else []), "c1", "c2", *names])

    return pending.mapInArrow(run, ("g1 long, g2 long, " if with_bytes else "") + f"c1 long, c2 long, {more}")


def _index_groups(classes: DataFrame, wide: int) -> DataFrame:
    """(c1, c2, mask) of compressed texts whose marks aren't empty; a group's rows come one after the other."""
    at_once = GROUP  # compressed texts in one index, but for a larger group

    def solve(rows: pa.Table):
        g1, g2 = rows.column("g1").to_numpy(), rows.column("g2").to_numpy()
        new = np.concatenate([[True], (np.diff(g1) != 0) | (np.diff(g2) != 0)])
        group = np.cumsum(new) - 1
        times = rows.column("times").to_numpy()
        many = np.bincount(group)[group] > 1
        keep = np.flatnonzero(many | (times > 1))
        if not len(keep):
            return
        rows = rows.take(pa.array(keep))
        got = marks(group[keep], times[keep], rows.column("left").to_pylist(), rows.column("right").to_pylist(), wide)
        hit = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([rows.column("c1").combine_chunks().take(pa.array(hit)), rows.column("c2").combine_chunks().take(pa.array(hit)), pa.array(got[hit].view(np.int64))], ["c1", "c2", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= at_once:
                rows = pa.Table.from_batches(held)
                g1, g2 = rows.column("g1").to_numpy(), rows.column("g2").to_numpy()
                edge = np.flatnonzero((g1 != g1[-1]) | (g2 != g2[-1]))
                if len(edge):  # the last group may go on
                    cut = int(edge[-1]) + 1
                    yield from solve(rows.slice(0, cut))
                    held = rows.slice(cut).to_batches()
        if held:
            yield from solve(pa.Table.from_batches(held))

    ordered = classes.repartition(partitions(classes.sparkSession), "g1", "g2").sortWithinPartitions("g1", "g2")
    return ordered.mapInArrow(run, "c1 long, c2 long, mask long")


def _halved(classes: DataFrame, wide: int) -> DataFrame:
    """Two compressed texts of half the width for each: (c1, c2, shift, n1, n2, g1, g2, left, right, times); n is the new one's hash, shift the bits that its windows are behind."""
    half = wide // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for b in batches:
            rows, shift, core, own, lefts, rights = [], [], [], [], [], []
            for r, (a, z, left, right) in enumerate(zip(*[b.column(c).to_pylist() for c in ("g1", "g2", "left", "right")], strict=True)):
                for by, bytes_in, x, y in ((0, right[:half], left[max(0, len(left) - half + 1) :], right[half : 2 * half - 1]), (half, left[max(0, len(left) - half) :], left[max(0, len(left) - 2 * half + 1) : max(0, len(left) - half)], right[: half - 1])):
                    if len(bytes_in) == half:
                        name = digest(b"%d %d %d " % (a, z, by) + bytes_in)
                        rows.append(r)
                        shift.append(by)
                        core.append(name)
                        own.append(digest(b"%s%d %s%s" % (name, len(x), x, y)))
                        lefts.append(x)
                        rights.append(y)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c).take(take) for c in ("c1", "c2")], pa.array(shift, pa.int32()), *_halves(own), *_halves(core), pa.array(lefts, pa.binary()), pa.array(rights, pa.binary()), b.column("times").take(take)],
                ["c1", "c2", "shift", "n1", "n2", "g1", "g2", "left", "right", "times"])

    return classes.mapInArrow(run, "c1 long, c2 long, shift int, n1 long, n2 long, g1 long, g2 long, left binary, right binary, times long")


def _masks(classes: DataFrame, group: int, wide: int = WIDE) -> DataFrame:
    """(c1, c2, mask) of compressed texts whose marks aren't empty; groups above `group` are halved in width until they are small or a window is all core."""
    large = classes.groupBy("g1", "g2").agg(F.count("*").alias("size")).where(F.col("size") > group).select("g1", "g2")
    if wide == 1 or large.isEmpty():
        return _index_groups(classes, wide)
    halves = materialise(_halved(classes.join(large, ["g1", "g2"], "left_semi"), wide), "halves")
    finer = materialise(halves.groupBy("n1", "n2", "g1", "g2", "left", "right").agg(F.sum("times").alias("times")).withColumnsRenamed({"n1": "c1", "n2": "c2"}), "finer")
    found = halves.join(_masks(finer, group, wide // 2).withColumnsRenamed({"c1": "n1", "c2": "n2"}), ["n1", "n2"])
    found = found.groupBy("c1", "c2").agg(F.bit_or(F.expr("shiftleft(mask, shift)")).alias("mask"))
    return _index_groups(classes.join(large, ["g1", "g2"], "left_anti"), wide).unionByName(found)


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, carry: tuple[str, ...] = (), group: int = GROUP, words: int = 0, apart: bool = False) -> DataFrame:
    """Every row with its text and what is found in it: cells of repeated windows only, marks of mixed ones, and spans of strings of so many words
    (those shorter than `length`, or with `apart` all, by cells)."""
    spark = df.sparkSession
    small_batches(spark)
    listed = materialise(_list_cells(df, text, length, words if apart else 0), "cells")
    kinds = listed.groupBy("kind").agg(
        F.sum("times").alias("all"), F.max("several").alias("any"), ((F.min("h1") != F.max("h1")) | (F.min("h2") != F.max("h2"))).alias("differ")
    ).where("all > 1 or any").select("kind", (F.col("any") | F.col("differ")).alias("mixed"))
    found = listed.select("kind", "t1", "t2", "first", "n", "plain").join(kinds, "kind").groupBy("t1", "t2").agg(F.collect_set(F.struct("first", "n", "mixed", "plain")).alias("cells"))
    some = lambda plain, mixed: F.transform(F.filter("cells", lambda c: (c["plain"] == plain) & (c["mixed"] == mixed)), lambda c: F.struct(c["first"].alias("first"), c["n"].alias("n")))
    short = _list_short(df, text, words, length) if words and not apart else None
    found = found.join(short, ["t1", "t2"], "full") if short is not None else found.withColumn("spans", some(False, False))
    found = materialise(found, "found")  # so that the join below can split the rows of a text with many copies
    texts = _hash_texts(df, key, text, list(carry)).join(found, ["t1", "t2"], "left")
    empty = F.array().cast("array<struct<first:bigint,n:bigint>>")
    table = materialise(
        texts.select("k", "t", "rest", "spans", *[F.coalesce(some(*x), empty).alias(c) for c, x in (("whole", (True, False)), ("mixed", (True, True)), ("loose", (False, True)))]).withColumn("id", F.monotonically_increasing_id()), "repeats")
    discard(listed, found, *([short] if short is not None else []))
    pending = table.where(F.size("mixed") > 0).select("id", "t", "mixed")
    classes = materialise(_list_sub_cells(pending, length, True).groupBy("g1", "g2", "c1", "c2", "left", "right").agg(F.count("*").alias("times")), "classes")
    masks = _masks(classes, group)
    places = _list_sub_cells(pending, length, False).join(masks, ["c1", "c2"]).groupBy("id").agg(F.collect_list(F.struct("p", "g", "mask")).alias("masks"))
    if apart:
        loose = _list_loose(table.where(F.size("loose") > 0).select("id", "t", "loose"), words)
        places = places.join(loose, "id", "full")
    else:
        places = places.withColumn("found", F.lit(None).cast("array<struct<first:bigint,n:bigint>>"))
    open_ = (F.size("mixed") > 0) | (F.size("loose") > 0)
    whole = table.where(~open_).withColumn("masks", F.array().cast("array<struct<p:bigint,g:int,mask:bigint>>")).withColumn("found", empty)
    mixed = table.where(open_).join(places, "id", "left")
    columns = ["k", "t", "rest", "whole", "masks", F.concat(F.coalesce("spans", empty), F.coalesce("found", empty)).alias("spans")]
    return mixed.select(*columns).unionByName(whole.select(*columns))


def _finish(rows: DataFrame, key: str, carry: tuple[str, ...], length: int, form: str, apart: bool) -> DataFrame:
    """Results of every row: counts and what stays."""
    more = ["n_passages", "n_passage_bytes"] if apart else []
    kinds = {"bytes": (pa.binary(), "binary", bytes), "text": (pa.string(), "string", lambda x: x.decode("utf-8", "ignore")), "sha256": (pa.string(), "string", lambda x: hashlib.sha256(x).hexdigest())}
    kind, sql, made = kinds[form]
    schema = f"k {rows.schema['k'].dataType.simpleString()}, rest {rows.schema['rest'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept {sql}" + "".join(f", {c} long" for c in more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, spans, kept = [], [], [], []
            shorts = [()] * b.num_rows if apart else b.column("spans").to_pylist()
            for t, whole, masks, short in zip(*[b.column(c).to_pylist() for c in ("t", "whole", "masks")], shorts, strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                windows = [(c["first"], c["first"] + c["n"]) for c in whole]
                for m in masks or ():
                    windows += _mask_runs(m["p"], m["g"], m["mask"])
                cut, at, parts = covered(windows, length), 0, []
                if short:
                    cut = merged([*cut, *((c["first"], c["first"] + c["n"]) for c in short)])
                for s, e in cut:
                    parts.append(raw[at:s])
                    at = e
                left = b"".join([*parts, raw[at:]])
                n.append(len(raw))
                gone.append(len(raw) - len(left))
                spans.append(len(cut))
                kept.append(made(left))
            yield pa.RecordBatch.from_arrays(
                [b.column("k"), b.column("rest"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, kind), *[pa.array(x) for x in (_measured(b.column("spans")) if apart else ())]],
                ["k", "rest", "n_bytes", "n_removed", "n_spans", "kept", *more])

    out = rows.select("k", "t", "rest", "whole", "masks", "spans").mapInArrow(run, schema)
    return out.select(F.col("k").alias(key), *[F.col(f"rest.c{j}").alias(c) for j, c in enumerate(carry)], "n_bytes", "n_removed", "n_spans", "kept", *more)


def kept_bytes(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, carry: tuple[str, ...] = (), form: str = "bytes", group: int = GROUP, words: int = 0, apart: bool = False) -> DataFrame:
    """(key, carried columns, n_bytes, n_removed, n_spans, kept) of every row; kept is the remaining bytes, as form says:
    `bytes`, `text` (of a character that a cut divides nothing stays) or their `sha256`.  With `apart` repeated strings of so many
    words stay, and n_passages and n_passage_bytes follow: the maximal runs of bytes that they cover and those bytes."""
    return _finish(remove_repeats(df, key, text, length, carry, group, words, apart), key, carry, length, form, apart)


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated strings of 400 bytes; beside these, what repeated strings of 51 words cover, which may be shorter and stay."""
    return kept_bytes(read_table(spark, sf_dir, "documents"), form="sha256", words=WORDS, apart=True).withColumnRenamed("kept", "kept_sha256")
