"""Operator 7, benchmark decontamination: Wu-Manber multi-pattern search over whole texts.

Benchmark items become windows of ten words.  A window is the byte string of its words, each between
single spaces, with a space at both ends, so that a byte occurrence is a word occurrence.  The matcher
keeps for each class of pattern lengths a table from blocks of bytes to shifts: it reads the block at
the window's end, jumps by the block's shift (by the most possible when the block is in no pattern),
and only where the shift is zero looks up the suffix block's bucket and compares the strings directly.

Defined cases: a null or wordless text has no words and is clean; an item without words or with a null
text has no windows; an item with a null id marks words but is not listed; equal windows of several
items count for each; an empty benchmark marks nothing; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table, small_batches

WINDOW = 10
BLOCK = 8
#: Bytes of item text whose windows one pass holds in memory; a larger benchmark takes more passes.
PASS_BYTES = 1 << 20
SPACE = 0x20

_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else SPACE for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words: runs of digits, letters a to z (A to Z lower-cased) and characters from U+0080 on."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class WuManber:
    """Finds all occurrences of byte strings.  Patterns of similar length share one shift table."""

    CLASSES = (1, 8, 16, 32)

    def __init__(self, patterns: list[bytes], block: int = BLOCK):
        self.patterns = patterns
        self.classes = []
        for k, low in enumerate(self.CLASSES):
            high = self.CLASSES[k + 1] if k + 1 < len(self.CLASSES) else None
            ids = [i for i, p in enumerate(patterns) if len(p) >= low and (high is None or len(p) < high)]
            if ids:
                self.classes.append(self._tables(ids, block))

    def _tables(self, ids: list[int], block: int):
        m = min(len(self.patterns[i]) for i in ids)
        width = min(block, m)
        shift: dict[bytes, int] = {}
        bucket: dict[bytes, dict[bytes, list[int]]] = {}
        for i in ids:
            head = self.patterns[i][:m]
            for j in range(m - width + 1):
                piece = head[j : j + width]
                shift[piece] = min(shift.get(piece, m), m - width - j)
            bucket.setdefault(head[m - width :], {}).setdefault(head, []).append(i)
        return m, width, shift, bucket

    def find(self, text: bytes) -> list[tuple[int, int]]:
        """(start, pattern number) of every occurrence."""
        found = []
        for m, width, shift, bucket in self.classes:
            most, get, at, last = m - width + 1, shift.get, m - width, len(text) - width
            while at <= last:
                jump = get(text[at : at + width], most)
                if jump:
                    at += jump
                    continue
                start = at + width - m
                for i in bucket[text[at : at + width]].get(text[start : start + m], ()):
                    if text.startswith(self.patterns[i], start):
                        found.append((start, i))
                at += 1
        return found


def windows_of(items: list[tuple[object, str | None]], window: int = WINDOW) -> tuple[list[bytes], list[int], list[list[str]]]:
    """Distinct windows, their numbers of words and the ids (as strings) of the items that have them."""
    ids: dict[bytes, set[str]] = {}
    for item, text in items:
        words = words_of(text)
        for j in range(max(1, len(words) - window + 1) if words else 0):
            ids.setdefault(b" " + b" ".join(words[j : j + window]) + b" ", set()).update(() if item is None else (str(item),))
    return list(ids), [p.count(b" ") - 1 for p in ids], [sorted(x) for x in ids.values()]


def _matcher(items: list[tuple[object, str | None]], window: int):
    patterns, n_words, owners = windows_of(items, window)
    machine = WuManber(patterns)

    def match(text: str | None) -> tuple[int, list[int], list[str]]:
        words = words_of(text)
        if not words:
            return 0, [], []
        joined = b" " + b" ".join(words) + b" "
        found = machine.find(joined)
        if not found:
            return len(words), [], []
        spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == SPACE)
        hit, who = set(), set()
        for start, i in found:
            first = int(np.searchsorted(spaces, start))
            hit.update(range(first, first + n_words[i]))
            who.update(owners[i])
        return len(words), sorted(hit), sorted(who)

    return match


def _pieces(items: DataFrame, window: int, size: int) -> DataFrame:
    """Items (i, t) as pieces of about `size` bytes of words at most that have the same windows: neighbours share window - 1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = [], []
            for i, t in zip(b.column("i").to_pylist(), b.column("t").to_pylist(), strict=True):
                words = words_of(t)
                at = 0
                while words:
                    to, held = at, 0
                    while to < len(words) and (held < size or to < at + window):
                        held += len(words[to]) + 1
                        to += 1
                    ids.append(i)
                    texts.append(b" ".join(words[at:to]).decode("utf-8", "surrogatepass"))
                    if to == len(words):
                        break
                    at = to - window + 1
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["i", "t"])

    return items.mapInArrow(run, "i string, t string")


def mark_benchmark(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
                   window: int = WINDOW, carry: tuple[str, ...] = (), pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(key, n_words, hit_words, items) and the carried columns for each row: the numbers of the words
    inside an occurrence and the sorted ids of the items that occur.

    The benchmark goes to the executors in passes of bounded size: within the bound one pass over the
    texts, beyond it one pass for each part of the items, joined by row.  Then long items are cut into
    pieces, so that no part is much above the bound, and the numbered rows are written first, so that
    every pass sees the same numbers."""
    spark = df.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(item).cast("string").alias("i"), F.col(item_text).alias("t"))
    size = items.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    passes = max(1, -(-size // pass_bytes))
    frame = df.select(F.col(key).alias("k"), F.col(text).alias("t"), *[F.col(c).alias(f"c{j}") for j, c in enumerate(carry)])
    kept = [f"c{j}" for j in range(len(carry))]
    schema = ", ".join(f"{n} {frame.schema[n].dataType.simpleString()}" for n in ["k", *kept])
    schema += ", row long, n_words long, hit_words array<int>, items array<string>"
    frame = frame.withColumn("row", F.monotonically_increasing_id())
    if passes > 1:
        frame = materialise(frame, "rows")
        items = materialise(_pieces(items, window, max(1, pass_bytes // 8)).distinct(), "items")

    def one_pass(part: int) -> DataFrame:
        mine = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == part) if passes > 1 else items
        held = spark.sparkContext.broadcast([(r[0], r[1]) for r in mine.collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            match = _matcher(held.value, window)
            for b in batches:
                got = [match(t) for t in b.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column("k"), *[b.column(c) for c in kept], b.column("row"), pa.array([g[0] for g in got], pa.int64()),
                     pa.array([g[1] for g in got], pa.list_(pa.int32())), pa.array([g[2] for g in got], pa.list_(pa.string()))],
                    ["k", *kept, "row", "n_words", "hit_words", "items"])

        return frame.mapInArrow(run, schema)

    out = one_pass(0)
    for part in range(1, passes):
        more = one_pass(part).select("row", F.col("hit_words").alias("h"), F.col("items").alias("w"))
        out = out.join(more, "row").withColumns({"hit_words": F.array_sort(F.array_union("hit_words", "h")), "items": F.array_sort(F.array_union("items", "w"))}).drop("h", "w")
    return out.select(F.col("k").alias(key), *[F.col(f"c{j}").alias(c) for j, c in enumerate(carry)], "n_words", "hit_words", "items")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    out = mark_benchmark(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"),
    )


OP7_SQL = r"""
with doc as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
item as (
  select cast(item_id as varchar) as item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
win as (
  select distinct item_id, len(w[i : i + 9]) as n, array_to_string(w[i : i + 9], ' ') as s
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from item where len(w) > 0)),
sizes as (select distinct n from win),
spot as (
  select r, i, n, array_to_string(w[i : i + n - 1], ' ') as s
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from doc, sizes where len(w) >= n)),
hit as (select spot.r, spot.i, spot.n, win.item_id from spot join win on spot.n = win.n and spot.s = win.s),
words as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from hit) group by r),
who as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct r, item_id from hit) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc left join words using (r) left join who using (r)
"""
