"""Operator 10, token counts: one encoding of the whole text, its tokens attributed to sections.

A text is encoded once.  Every token has a span of characters; sections are intervals of characters
that tile the text.  An interval join of the two sorted lists (by binary search, inside the row)
gives each token to a section.  The rule for tokens that cross a boundary: the section that holds
most of the token's characters gets it, the earlier one if two hold equally many; a token without
characters of its own (a part of a character) goes to the section of its first character.

Sections here are lines: a line's section includes its line feed.

Defined cases: a null or empty text has one section without characters or tokens; a text that ends
in a line feed has no further empty section; repeated rows are counted each for itself; an empty
table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, small_batches
from .packing import tokenizer_path
from .tokens import tokenizer


def line_starts(text: str) -> np.ndarray:
    """First characters of the text's lines."""
    cuts = [0]
    at = text.find("\n")
    while at >= 0 and at + 1 < len(text):
        cuts.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array(cuts, np.int64)


def attribute(begin: np.ndarray, end: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each token's section, and whether it crosses a boundary."""
    first = np.searchsorted(starts, begin, side="right") - 1
    last = np.searchsorted(starts, np.maximum(end - 1, begin), side="right") - 1
    owner = first.copy()
    stops = np.append(starts[1:], size)
    for i in np.flatnonzero(last > first):
        k = np.arange(first[i], last[i] + 1)
        held = np.minimum(end[i], stops[k]) - np.maximum(begin[i], starts[k])
        owner[i] = k[np.argmax(held)]  # the first of equals
    return owner, last > first


def count_by_section(df: DataFrame, vocabulary: str, kind: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, section, start, end, n_tokens, n_crossing): the sections of every text with their tokens, and how many of these cross into another section."""
    small_batches(df.sparkSession)
    frame = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    schema = f"k {frame.schema['k'].dataType.simpleString()}, section int, start long, end long, n_tokens long, n_crossing long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(vocabulary, kind, spans=True)
        for b in batches:
            texts = b.column("t").to_pylist()
            _, bounds, begin, end = words.encode_spans(texts)
            sizes = [len(t) if t else 0 for t in texts]
            starts = [line_starts(t or "") for t in texts]
            # one line of characters for the whole batch: every text keeps a character of its own, so that none touches the next
            n = np.array([len(s) for s in starts], np.int64)
            shift = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) + 1)])
            all_starts = np.concatenate(starts) + np.repeat(shift[:-1], n) if len(texts) else np.zeros(0, np.int64)
            move = np.repeat(shift[:-1], np.diff(bounds))
            owner, crosses = attribute(begin + move, end + move, all_starts, int(shift[-1]))
            firsts = np.cumsum(n) - n
            section = np.arange(len(all_starts)) - np.repeat(firsts, n)
            stops = np.concatenate([np.append(s[1:], z) for s, z in zip(starts, sizes, strict=True)]) if len(texts) else np.zeros(0, np.int64)
            rows = np.repeat(np.arange(len(texts)), n)
            yield pa.RecordBatch.from_arrays(
                [b.column("k").take(pa.array(rows)), pa.array(section, pa.int32()), pa.array(np.concatenate(starts) if len(texts) else [], pa.int64()), pa.array(stops, pa.int64()),
                 pa.array(np.bincount(owner, minlength=len(all_starts)), pa.int64()), pa.array(np.bincount(owner[crosses], minlength=len(all_starts)), pa.int64())],
                ["k", "section", "start", "end", "n_tokens", "n_crossing"])

    return frame.mapInArrow(run, schema)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every line of every document."""
    out = count_by_section(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), "byte")
    return out.withColumnRenamed("k", "doc_id")
