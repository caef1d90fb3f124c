"""Operator 4, best-fit packing: exact complements by hashing, then best fit.

Texts become pieces of at most `capacity` tokens.  Only the histogram of piece lengths, which has at
most `capacity` entries at any size of the corpus, goes to the driver.  There the longest lengths are
completed first: tables of single, pair and triple sums say which lengths exactly fill a sequence's
gap, and a combination is used as often as the counts of its lengths allow.  What stays is packed by
best fit, longest first, again by length and count.  The plan is a bounded table of rank intervals by
length.  Every piece gets its rank among the pieces of its length by a two-level count, and looks up its
sequence and offset in the plan.

Defined cases: a null or empty text is one piece that holds the end id alone; a text of exactly
`capacity` tokens is one piece; equal lengths are ranked by key, piece and a row tag, so repeated rows
and keys are packed each for itself; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, partitions, read_table, small_batches
from .tokens import tokenizer

CAPACITY = 4096
END_ID = 1


def tokenizer_path(name: str) -> str:
    """A public vocabulary file's place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def cut_pieces(df: DataFrame, vocabulary: str, kind: str, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(k, piece, start, length, ids_crc32[, ids]) of every piece of every text; one end id is appended to a text's ids."""
    small_batches(df.sparkSession)
    frame = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    schema = f"k {frame.schema['k'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(vocabulary, kind)
        for b in batches:
            ids, bounds = words.encode(b.column("t").to_pylist())
            rows, piece, start, length, crc, lists = [], [], [], [], [], []
            for i in range(len(bounds) - 1):
                own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4")
                for j, at in enumerate(range(0, len(own), capacity)):
                    part = own[at : at + capacity]
                    rows.append(i)
                    piece.append(j)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        lists.append(part.astype(np.int32))
            cols = [b.column("k").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["k", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return frame.mapInArrow(run, schema)


class _Sums:
    """Which lengths are there, and which sums two of them make; the pair table is rebuilt after `STALE` lengths ran out."""

    STALE = 64

    def __init__(self, left: np.ndarray):
        self.left, self.gone = left, self.STALE

    def pair(self, total: int, used: dict[int, int]) -> tuple[int, int] | None:
        """The pair with the longest member that makes `total` with what is left besides `used`."""
        if total < 2:
            return None
        a = np.arange(total - 1, (total - 1) // 2, -1)
        for x in a[(self.left[a] > 0) & (self.left[total - a] > 0)]:
            x, y = int(x), int(total - x)
            if self.left[x] - used.get(x, 0) >= 1 + (x == y) and self.left[y] - used.get(y, 0) >= 1:
                return x, y
        return None

    def complement(self, gap: int, first: int, most: int) -> tuple[int, ...] | None:
        """One, two or three lengths, `most` at most, that fill `gap` exactly besides one `first`."""
        used = {first: 1}
        if self.left[gap] - used.get(gap, 0) >= 1:
            return (gap,)
        if most > 1 and (found := self.pair(gap, used)):
            return found
        if most < 3:
            return None
        if self.gone >= self.STALE:
            here = (self.left > 0).astype(np.float64)
            n = len(here)
            self.pairs = np.fft.irfft(np.fft.rfft(here, 2 * n) ** 2, 2 * n)[:n] > 0.5
            self.gone = 0
        x = np.arange(gap - 2, 0, -1)
        for a in x[(self.left[x] > 0) & self.pairs[gap - x]]:
            a = int(a)
            if self.left[a] - used.get(a, 0) >= 1 and (found := self.pair(gap - a, {**used, a: used.get(a, 0) + 1})):
                return (a, *found)
        return None


def plan_packing(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rows (length, first rank, pieces, first sequence, offset, copies in a sequence) and the number of sequences.

    The pieces of a length with ranks from first rank on go to the sequences from first sequence on,
    `copies` to each, side by side from `offset`.  Exact complements of up to three lengths are tried
    first; if the residuals then need more sequences than with smaller complements, those are used."""
    least = -(-sum(length * n for length, n in counts.items()) // capacity)
    best = None
    for most in (3, 2, 1, 0):
        plan = _plan(counts, capacity, most)
        if best is None or plan[1] < best[1]:
            best = plan
        if best[1] <= least:
            break
    return best


def _plan(counts: dict[int, int], capacity: int, most: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    bins: list[tuple[tuple[tuple[int, int], ...], int]] = []  # ((length, copies), ...), how many sequences
    if left[capacity]:
        bins.append((((capacity, 1),), int(left[capacity])))
        left[capacity] = 0
    sums = _Sums(left)
    for first in range(capacity - 1, 0, -1):
        while most and left[first] > 0 and (found := sums.complement(capacity - first, first, most)):
            need: dict[int, int] = {}
            for x in (first, *found):
                need[x] = need.get(x, 0) + 1
            times = min(int(left[x]) // n for x, n in need.items())
            for x, n in need.items():
                left[x] -= times * n
                sums.gone += left[x] == 0
            bins.append((tuple(need.items()), times))
    gaps: list[int] = []  # sorted gaps of the open sequences
    open_bins: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}

    def put(gap: int, pattern, times: int) -> None:
        if gap not in open_bins:
            bisect.insort(gaps, gap)
        open_bins.setdefault(gap, []).append((pattern, times))

    for length in range(capacity - 1, 0, -1):
        n = int(left[length])
        while n:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                gap, pattern, times = capacity, (), n  # new sequences
            else:
                gap = gaps[at]
                pattern, times = open_bins[gap].pop()
                if not open_bins[gap]:
                    del open_bins[gap], gaps[at]
            fit = gap // length
            full = min(times, n // fit)
            if full:
                put(gap - fit * length, (*pattern, (length, fit)), full)
                n -= full * fit
            if n and full < times:
                put(gap - n * length, (*pattern, (length, n)), 1)
                full, n = full + 1, 0
            if full < times and pattern:
                put(gap, pattern, times - full)
    bins += [b for same in open_bins.values() for b in same]
    rows, rank, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for pattern, times in bins:
        offset = 0
        for length, copies in pattern:
            rows.append((length, int(rank[length]), copies * times, sequence, offset, copies))
            rank[length] += copies * times
            offset += length * copies
        sequence += times
    return rows, sequence


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (k, piece, length, ...); every other column is carried."""
    spark = pieces.sparkSession
    # written first, a few bytes a piece: range partitioning reads its input twice, and texts are tokenised once
    tagged = materialise(pieces.withColumn("_tag", F.monotonically_increasing_id()), "pieces")
    order = ["length", "k", "piece", "_tag"]
    ranged = materialise(tagged.repartitionByRange(partitions(spark), *order).withColumn("_part", F.spark_partition_id()), "packing")
    discard(tagged)
    # neighbouring partitions share at most one length: these counts have at most partitions + capacity rows
    counts = ranged.groupBy("length", "_part").agg(F.count("*").alias("n"))
    rows, _ = plan_packing({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}, capacity)
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)
    held = spark.sparkContext.broadcast(table)
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part", "length").orderBy("k", "piece", "_tag")
    ranked = ranged.join(F.broadcast(bases), ["length", "_part"]).withColumn("_rank", F.col("_base") + F.row_number().over(inside) - 1).drop("_base", "_part", "_tag")
    names = [n for n in ranked.columns if n != "_rank"]
    schema = ", ".join(f"{n} {ranked.schema[n].dataType.simpleString()}" for n in names) + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = held.value
        keys = plan[:, 0] << 48 | plan[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            mine = plan[np.searchsorted(keys, length << 48 | rank, side="right") - 1]
            nth, copies = rank - mine[:, 1], mine[:, 5]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(n) for n in names], pa.array(mine[:, 3] + nth // copies), pa.array(mine[:, 4] + nth % copies * length)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4,096 tokens."""
    pieces = cut_pieces(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), "word")
    return pack(pieces).select(F.col("k").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
