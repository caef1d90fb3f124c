"""Operator 8, near duplicates: order MinHash, then banded alignment.

Texts are ASCII-lower-cased words between ASCII white space.  Their shingles of `SHINGLE` words get the
number of their occurrence in the text, so that repeats differ.  Each of `SKETCHES` hash functions takes
the `SAMPLED` shingles with the least hashes and keeps them in text order; two texts agree in a sketch if
they sampled the same shingles in the same order, which depends on order as edit distance does.  Texts
of up to `SHORT` words have `FINE` sketches of two-word shingles besides, as few of their longer ones
outlast an edit.  Those of up to `TINY` words, where a link is an edit of one word at most, also agree if
they are equal after one word or none is left out of each: all links among these meet.

Equal texts are one node.  In each bucket (texts that agree in a sketch) every node is paired with the
least one, and two nodes that other links connect needn't be looked at.  Pairs are verified by the edit distance of their words, computed in a band that is as wide
as a similarity of `SIMILARITY` (1 - distance / words of the longer one) allows; a pair is a link if
the distance is within it.  A bucket whose other nodes are in one component is done.  The nodes of all
other buckets are mixed: any two of them that share a bucket and are in different components may still
be a link, so that a third text never hides one.  A link leaves a text at least so many of its words
that one of its rarest, a prefix of the words in the order of their frequency among mixed nodes, is
among those of the other text.  A text keeps such a word only if another text that has it has another
component and may be a link by the lengths and parities (below) of both; words of more than `FEW` texts
are kept without that.  So two mixed nodes are paired where they meet in such a word, share a bucket, differ in component and are near in length, at the first word they meet in, unless the parities
of their words by class already differ in more places than a link can change.  Texts that share only a
frequent passage have rare words of their own and are seldom paired.  Classes are the connected
components of links.  No bucket is cut or capped.

Defined cases: rows with equal texts, the empty one too, are one class; a null text is a class of its
own with its own key as id; texts under three words have one shingle of all their words; texts of white
space alone are linked to nothing but equal texts; class ids are the least key of the class (null keys
only if it has no other); repeated rows each get a row; only the named columns are read.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, read_table, small_batches
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
SAMPLED = 2
SKETCHES = 120
FINE = 48
SHORT = 75
TINY = 9
#: Bits of the classes of words whose frequencies order words; any order is right, rare words first is fast.  Which words meet is counted by the words themselves.
CLASSES = 20
#: Bits of the parities of words that are compared, in texts of up to as many words, before a pair is verified.
PARITIES = 1024
#: Rare words before one that are compared to tell whether two texts met in one of them already, in texts with parities and in longer ones.
BEFORE = 128, 8
#: Texts that meet in a word of which it is told for each whether one of the others may be a link, and those that are gathered at most (by the frequencies above, which are never too low).
FEW, GATHERED = 64, 1024

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> _U(32)) * _U(0xD6E8FEB86659FD93)
    h = (h ^ h >> _U(32)) * _U(0xD6E8FEB86659FD93)
    return h ^ h >> _U(32)


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = pow(_BASE, -1, 1 << 64)
            with np.errstate(over="ignore"):
                self.up = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(n - 1, _BASE, np.uint64)]))
                self.down = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(n - 1, inverse, np.uint64)]))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words and the number of words of each text."""
    flat = np.frombuffer(b" ".join([*texts, b""]).lower(), np.uint8)
    space = _SPACES[flat]
    edge = np.diff(np.concatenate([[1], space.astype(np.int8), [1]]))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _POWERS.get(len(flat) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([[_U(0)], np.cumsum((flat.astype(np.uint64) + _U(1)) * up[: len(flat)], dtype=np.uint64)])
        h = _mixed((total[stop] - total[start]) * down[start])
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    bounds = np.concatenate([[0], np.cumsum(size + 1)])
    return h, np.diff(np.searchsorted(start, bounds))


def sketches(texts: list[bytes], count: int = SKETCHES, sampled: int = SAMPLED, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order MinHash of each text: texts x sketches (64-bit), whether it has words, and its words."""
    words, n = word_hashes(texts)
    first = np.cumsum(n) - n
    shingles = np.maximum(n - width + 1, np.minimum(n, 1))
    total = int(shingles.sum())
    row = np.repeat(np.arange(len(texts)), shingles)
    at = np.repeat(first - (np.cumsum(shingles) - shingles), shingles) + np.arange(total)
    with np.errstate(over="ignore"):
        h, end = np.zeros(total, np.uint64), (first + n)[row]
        for j in range(width):
            i = at + j
            h = _mixed(h * _U(_BASE) + np.where(i < end, words[np.minimum(i, max(0, len(words) - 1))] if len(words) else 0, _U(0)).astype(np.uint64) + _U(1))
        order = np.lexsort((h, row))  # stable: equal shingles of a text stay in text order
        same = np.concatenate([[False], (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])]) if total else np.zeros(0, bool)
        begin = np.maximum.accumulate(np.where(same, 0, np.arange(total)))
        nth = np.empty(total, np.uint64)
        nth[order] = (np.arange(total) - begin).astype(np.uint64)
        h = _mixed(h + nth * _U(_BASE))
        has = shingles > 0
        out = np.zeros((len(texts), count), np.uint64)
        if total:
            starts = (np.cumsum(shingles) - shingles)[has]
            bits = max(20, int(total).bit_length())
            low, number, top = _U((1 << bits) - 1), np.arange(total, dtype=np.uint64), _U(0xFFFFFFFFFFFFFFFF)
            many = np.random.default_rng(8).integers(1, 1 << 62, count, dtype=np.int64).astype(np.uint64) * _U(2) + _U(1)
            for s in range(count):
                v = h * many[s] & ~low | number
                picks = []
                for _ in range(sampled):
                    least = np.minimum.reduceat(v, starts)
                    i = (least & low).astype(np.int64)
                    picks.append(np.where(least == top, total, i))  # fewer shingles than sampled
                    v[i[least != top]] = top
                picks = np.sort(np.stack(picks, 1), axis=1)
                value = np.append(h, _U(0))[picks]
                key = np.full(len(starts), s + 1, np.uint64)
                for k in range(sampled):
                    key = _mixed(key * _U(_BASE) + value[:, k])
                out[has, s] = key
    return out, has, n


def left_out(texts: list[bytes]) -> list[list[int]]:
    """For texts of 1 to `TINY` words: a 64-bit hash of their words, and where a word is an edit within a link those of all words but one."""
    words, n = word_hashes(texts)
    first, out = np.cumsum(n) - n, []
    for i, k in enumerate(n.tolist()):
        if not 0 < k <= TINY:
            out.append([])
            continue
        w = words[first[i] : first[i] + k]
        forms = np.stack([np.concatenate([w, [_U(0)]]), *(np.concatenate([np.delete(w, j), [_U(0)] * 2]) for j in range(k if k > 4 else 0))])
        h = np.full(len(forms), 0, np.uint64)
        with np.errstate(over="ignore"):
            for c in range(forms.shape[1]):
                h = np.where(forms[:, c] != 0, _mixed(h * _U(_BASE) + forms[:, c] + _U(1)), h)
        out.append(np.unique(h.view(np.int64)).tolist())
    return out


def all_keys(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """The keys of the buckets that each text is in, and its words."""
    sig, has, n = sketches(texts)
    none = np.zeros(0, np.int64)
    keys = [x if ok else none for x, ok in zip(sig.view(np.int64), has, strict=True)]
    short = np.flatnonzero(has & (n <= SHORT)).tolist()
    if short:
        some = [texts[i] for i in short]
        more = sketches(some, FINE, width=2)[0].view(np.int64)
        for i, x, y in zip(short, more, left_out(some), strict=True):
            keys[i] = np.concatenate([keys[i], x, np.array(y, np.int64)])
    return keys, n


def banded_distance(a: list, b: list, band: int) -> int | None:
    """Edit distance of two sequences if at most `band`, else None.

    Column by column, the cells within `band` of the diagonal are kept as two bit strings of vertical
    differences (+1 and -1); the window moves down by one row a column."""
    i, n, m = 0, len(a), len(b)
    while i < n and i < m and a[i] == b[i]:
        i += 1
    while n > i and m > i and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b = a[i:n], b[i:m]
    n, m = len(a), len(b)
    if abs(n - m) > band:
        return None
    if not n or not m:
        return max(n, m)
    left: dict = {}
    for x in a:
        left[x] = left.get(x, 0) + 1
    common = 0
    for x in b:
        if left.get(x, 0):
            left[x] -= 1
            common += 1
    if max(n, m) - common > band:  # the distance is at least this
        return None
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    width = 2 * band + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)
    plus, minus = mask >> (band + 1) << (band + 1), 0
    distance = min(band, n)
    for j in range(1, m + 1):
        plus, minus = plus >> 1 | top, minus >> 1
        eq = where.get(b[j - 1], 0)
        eq = (eq >> (j - band - 1) if j > band else eq << (band + 1 - j)) & mask
        same = ((((eq & plus) + plus) ^ plus) | eq | minus) & mask
        up = (minus | ~(same | plus)) & mask
        down = same & plus
        if j + band <= n:
            distance += not same & top
        else:
            bit = 1 << (n - j + band)
            distance += bool(up & bit) - bool(down & bit)
            if distance - (m - j) > band:
                return None
        up = (up << 1 | 1) & mask
        plus, minus = ((down << 1) | ~(same | up)) & mask, same & up
    return distance if distance <= band else None


def similar(a: str, b: str, least: float = SIMILARITY) -> bool:
    """Whether 1 - edit distance / words of the longer one is at least `least`."""
    x, y = a.encode("utf-8", "surrogatepass").lower().split(), b.encode("utf-8", "surrogatepass").lower().split()
    return banded_distance(x, y, int((1 - least) * max(len(x), len(y)) + 1e-9)) is not None


def _signatures(df: DataFrame, key: str, text: str) -> DataFrame:
    """(k, hash, n, sig): 128-bit hash of the text, its words, its sketches (none without words); rows with a text."""
    frame = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in b.column("t").to_pylist()]
            numbers: dict[bytes, int] = {}
            which = [numbers.setdefault(t, len(numbers)) for t in texts]  # equal texts of a batch are sketched once
            keys, n = all_keys(list(numbers))
            own = [keys[i] for i in which]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *own])))
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary()), pa.array(n[np.array(which, np.int64)], pa.int64()), lists], ["k", "hash", "n", "sig"])

    return frame.mapInArrow(run, f"k {frame.schema['k'].dataType.simpleString()}, hash binary, n long, sig array<long>")


def labelled_words(text: bytes) -> np.ndarray:
    """64-bit hashes of a text's words with the number of their occurrence, so that no two are equal."""
    words, _ = word_hashes([text])
    order = np.argsort(words, kind="stable")
    new = np.concatenate([[True], words[order][1:] != words[order][:-1]])[: len(words)]
    at = np.arange(len(words))
    nth = np.empty(len(words), np.uint64)
    nth[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    with np.errstate(over="ignore"):
        return _mixed(words + nth * _U(_BASE))


def rare_words(words: np.ndarray, often: np.ndarray, least: float) -> np.ndarray:
    """The words among which every text that is linked to this one has one, rarest first."""
    n = len(words)
    prefix = min(n, int((1 - least) * n + 1e-9) + 1)  # the two texts have at least n - prefix + 1 words in common
    times = often[(words >> _U(64 - CLASSES)).astype(np.int64)]
    return words[np.lexsort((words, times))[:prefix]]


def parities(words: np.ndarray) -> np.ndarray:
    """For texts of up to `PARITIES` words, a bit for each class of hashes: whether the text has an odd number of words there."""
    if len(words) > PARITIES:
        return np.zeros(0, np.int64)
    odd = np.bincount((words & _U(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _often(texts: DataFrame) -> np.ndarray:
    """How many labelled words of the texts (t) fall in each class of hashes: a number a class, at any size of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << CLASSES, np.int64)
        for b in batches:
            words = np.concatenate([np.zeros(0, np.uint64), *(labelled_words(t.encode("utf-8", "surrogatepass")) for t in b.column("t").to_pylist())])
            sums += np.bincount((words >> _U(64 - CLASSES)).astype(np.int64), minlength=1 << CLASSES)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["class", "times"])

    found = texts.select("t").mapInArrow(run, "class long, times long").groupBy("class").agg(F.sum("times").alias("times")).toArrow()
    out = np.zeros(1 << CLASSES, np.int32)
    out[found.column("class").to_numpy()] = np.minimum(found.column("times").to_numpy(), 2**31 - 1)
    return out


def _rare(texts: DataFrame, often: np.ndarray, least: float) -> DataFrame:
    """(id, words, few, odd): the rare words of each text (id, t), rarest first, how many of them at most `GATHERED` texts have for certain,
    and the text's parities; a row a text."""
    held, most = texts.sparkSession.sparkContext.broadcast(often), GATHERED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = [labelled_words(t.encode("utf-8", "surrogatepass")) for t in b.column("t").to_pylist()]
            rare = [rare_words(w, held.value, least) for w in every]
            few = [int((held.value[(w >> _U(64 - CLASSES)).astype(np.int64)] <= most).sum()) for w in rare]
            odd = [parities(w) for w in every]
            words = pa.array([w.view(np.int64) for w in rare], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), words, pa.array(few, pa.int64()), pa.array(odd, pa.list_(pa.int64()))], ["id", "words", "few", "odd"])

    return texts.select("id", "t").mapInArrow(run, "id long, words array<long>, few long, odd array<long>")


def _may_link(x: Callable[[str], Column], y: Callable[[str], Column], odd: list[tuple[Column, Column]], least: float) -> Column:
    """Whether the lengths (n) of two texts and the parities of their words, where both have them, allow a link."""
    longer, apart = F.greatest(x("n"), y("n")) * (1 - least) + 1e-9, F.abs(x("n") - y("n"))
    differ = sum((F.bit_count(a.bitwiseXOR(b)) for a, b in odd), F.lit(0))
    # of the edits of a link, at least as many as the lengths differ by insert or delete a word, which changes one parity; the others change two at most
    return (apart <= longer) & F.coalesce(differ <= 2 * F.floor(longer) - apart, F.lit(True))


def _meetings(rare: DataFrame, least: float) -> DataFrame:
    """For each rare word of a text (id, n, group, label, words, few, odd, ...) that a text of its group with another label has too, one that may be
    a link where `FEW` or fewer have it, a hash of group and word (word), up to so many such words before it (prev), and the text's other columns.
    Only thin rows are exchanged: the rest is joined once a text."""
    every, folded = PARITIES // 64, 4  # parities of fewer, larger classes of words: their differences are no more
    odd = [functools.reduce(Column.bitwiseXOR, (F.get("odd", F.lit(i)) for i in range(j, every, folded))).alias(f"p{j}") for j in range(folded)]
    thin = rare.select("id", "group", "label", "n", "few", *odd, F.posexplode("words").alias("at", "w")).withColumn("word", F.xxhash64("group", "w"))
    lo_hi = F.min("label").alias("lo"), F.max("label").alias("hi")
    some = thin.where("at < few").groupBy("word").agg(*lo_hi, F.collect_list(F.struct("id", "at", "label", "n", *(f"p{j}" for j in range(folded)))).alias("of")).where("lo <> hi")
    linkable = lambda x, y: (x["label"] != y["label"]) & _may_link(x.getField, y.getField, [(x[f"p{j}"], y[f"p{j}"]) for j in range(folded)], least)
    of = F.when(F.size("of") <= FEW, F.filter("of", lambda x: F.exists("of", lambda y: linkable(x, y)))).otherwise(F.col("of"))
    some = some.select("word", F.explode(of).alias("x")).select("x.id", "x.at", "word")
    frequent = thin.where("at >= few").select("id", "label", "at", "word")
    shared = frequent.groupBy("word").agg(*lo_hi).where("lo <> hi").select("word")
    both = some.unionByName(frequent.join(shared, "word").select("id", "at", "word"))
    left = both.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))  # at most the rare words of a text
    rows = left.select("id", F.col("w.word").alias("words")).join(rare.drop("words", "few", "group"), "id")
    each = rows.select("*", F.posexplode("words").alias("at", "word"))
    size = F.least(F.col("at"), F.when(F.size("odd") == 0, BEFORE[1]).otherwise(BEFORE[0]))
    return each.withColumn("prev", F.slice("words", F.col("at") - size + 1, size)).drop("words", "at")


def _text_of(df: DataFrame, key: str, text: str) -> DataFrame:
    frame = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            hashes = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(hashes, pa.binary()), b.column("t")], ["k", "hash", "t"])

    return frame.mapInArrow(run, f"k {frame.schema['k'].dataType.simpleString()}, hash binary, t string")


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links among pairs (a, b) of nodes."""
    left, right = texts.select(F.col("id").alias("a"), F.col("t").alias("x")), texts.select(F.col("id").alias("b"), F.col("t").alias("y"))
    both = pairs.join(left, "a").join(right, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(x, y, least) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _joined(pairs: DataFrame, texts: DataFrame, labels: DataFrame | None, least: float) -> tuple[DataFrame, DataFrame]:
    """The labels of nodes with the links among pairs besides those that `labels` stand for, and the table of these."""
    links = _verified(pairs, texts, least)
    if labels is not None:
        links = labels.where("id <> label").select(F.col("id").alias("a"), F.col("label").alias("b")).unionByName(links)  # as connected as the links so far
    links = materialise(links, "links")
    return components(links), links


def _stars(buckets: DataFrame) -> DataFrame:
    """Pairs (a, b) of the least node of each bucket (key, id, n) with its others, if their lengths allow a link."""
    least = buckets.groupBy("key").agg(F.min(F.struct("id", "n")).alias("m"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("key", "m")
    return buckets.join(least, "key").select(F.col("m.id").alias("a"), F.col("id").alias("b"), F.col("m.n").alias("na"), F.col("n").alias("nb"), "key").where("a <> b")


def _apart(stars: DataFrame, labels: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of nodes that share a bucket but no label and may be a link; none of the least node of a bucket, which was paired with all."""
    members = stars.select("key", F.col("b").alias("id"), F.col("nb").alias("n")).join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    members = materialise(members, "members")
    mixed = members.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("id").alias("head")).where("lo <> hi").select("key", "head")
    some = materialise(members.join(mixed, "key"), "mixed-members")
    edges = materialise(some.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), "bucket-edges")
    group = components(edges).select("id", F.col("label").alias("group"))  # texts that share a bucket are in one group
    nodes = some.groupBy("id", "n", "label").agg(F.collect_set("key").alias("keys"))  # as many keys as sketches at most
    nodes = materialise(nodes.join(group, "id"), "mixed")
    own = materialise(texts.join(nodes.select("id"), "id"), "mixed-texts")
    rare = materialise(_rare(own, _often(own), least).join(nodes, "id"), "rare")
    rows = materialise(_meetings(rare, least), "meetings")
    x, y = rows.alias("x"), rows.alias("y")
    odd = [(F.get("x.odd", F.lit(i)), F.get("y.odd", F.lit(i))) for i in range(PARITIES // 64)]
    of = lambda side: lambda name: F.col(f"{side}.{name}")
    meets = (
        (F.col("x.word") == F.col("y.word")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.label") != F.col("y.label")) & _may_link(of("x"), of("y"), odd, least)
        & F.arrays_overlap("x.keys", "y.keys") & ~F.arrays_overlap("x.prev", "y.prev")
    )
    out = materialise(x.join(y, meets).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct(), "apart")
    discard(members, some, edges, nodes, own, rare, rows)
    return out


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(key, class_id) of every row."""
    sigs, classes = _classes(df, key, text, least)
    ids = materialise(classes.groupBy("label").agg(F.min("rep").alias("class_id")), "classes")  # so that the join below can split a large class
    found = sigs.select("k", "hash").join(classes.join(ids, "label").select("hash", "class_id"), "hash").select(F.col("k").alias(key), "class_id")
    return found.unionByName(df.where(F.col(text).isNull()).select(F.col(key), F.col(key).alias("class_id")))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row of each class, whole: of its rows with the least key (a null key only if it has no other) one.  Every row with a null text stays."""
    _, classes = _classes(df, key, text, least)
    kept = classes.groupBy("label").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), F.col("rep"), F.col("hash"))).alias("m"))
    kept = materialise(kept.select("m.hash", F.xxhash64("m.rep").alias("h"), F.col("m.rep").alias("rep")), "kept")
    rows = with_hash(df.where(F.col(text).isNotNull()).select(F.struct(*df.columns).alias("row"), F.col(key).alias("k")), text).withColumn("h", F.xxhash64("k"))
    rows = rows.join(kept, ["hash", "h"]).where(F.col("k").eqNullSafe(F.col("rep"))).dropDuplicates(["hash", "h"]).select("row.*")  # one shuffle of texts
    return rows.unionByName(df.where(F.col(text).isNull()))


def with_hash(rows: DataFrame, text: str) -> DataFrame:
    """(row, k, hash) of (row, k): with the 128-bit hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            hashes = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in b.column("row").field(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("k"), pa.array(hashes, pa.binary())], ["row", "k", "hash"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, k {rows.schema['k'].dataType.simpleString()}, hash binary")


def _classes(df: DataFrame, key: str, text: str, least: float) -> tuple[DataFrame, DataFrame]:
    """The sketches of rows, and (hash, rep, label) of every text: its least key and its class."""
    spark = df.sparkSession
    small_batches(spark)
    wide = materialise(_signatures(df, key, text), "sketches")
    full = materialise(
        wide.groupBy("hash").agg(F.min("k").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")).withColumn("id", F.monotonically_increasing_id()), "nodes")
    sigs = materialise(wide.select("k", "hash"), "texts-of-keys")
    discard(wide)  # sketches are most of what is written: each table of them goes as soon as it was read
    buckets = full.where(F.size("sig") > 0).select("id", "n", F.explode("sig").alias("key"))
    near_in_size = (F.abs(F.col("na") - F.col("nb")) <= F.greatest("na", "nb") * (1 - least) + 1e-9)
    stars = materialise(_stars(buckets), "stars")
    nodes = materialise(full.select("hash", "id", "rep"), "nodes")
    discard(full)
    pairs = materialise(stars.where(near_in_size).select("a", "b").distinct(), "pairs")
    wanted = materialise(stars.select(F.col("a").alias("id")).union(stars.select("b")).distinct(), "wanted")
    own = nodes.join(wanted, "id", "left_semi").select("id", "hash", F.col("rep").alias("k"))
    # the one shuffle of texts: those of nodes that share a bucket stay
    same = (F.col("d.hash") == F.col("o.hash")) & F.col("d.k").eqNullSafe(F.col("o.k"))
    texts = materialise(_text_of(df, key, text).alias("d").join(own.alias("o"), same).select("o.id", "d.t").dropDuplicates(["id"]), "texts")
    # one pair of each node first: most of the others then have one label and needn't be verified
    first = materialise(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first")
    labels, done = _joined(first, texts, None, least)
    a_label, b_label = (labels.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label")) for c in ("a", "b"))
    rest = pairs.join(first, ["a", "b"], "left_anti").join(a_label, "a", "left").join(b_label, "b", "left").where(F.coalesce("a_label", "a") != F.coalesce("b_label", "b"))
    labels, more_done = _joined(materialise(rest.select("a", "b"), "rest"), texts, labels, least)
    apart = materialise(_apart(stars, labels, texts, least).join(pairs, ["a", "b"], "left_anti"), "more")
    labels, last_done = _joined(apart, texts, labels, least)
    discard(stars, wanted, pairs, texts, first, apart, done, more_done, last_done)
    return sigs, nodes.select("hash", "id", "rep").join(labels, "id", "left").select("hash", "rep", F.coalesce("label", "id").alias("label"))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))
