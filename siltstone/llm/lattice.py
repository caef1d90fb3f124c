"""Operator 6, language-model scoring: the marginal likelihood of a subword lattice.

A token is a lower-cased word; its lattice has an edge for every piece of an existing vocabulary that
occurs in "word mark + word", and for a character without a piece an edge of its bytes.  The
vocabulary's own scores weight all segmentations: as they are, if they are log probabilities, else by
rank, as 1 / (rank + 2.7).  One step of expectation over the training tokens turns them into expected
piece counts, and the weights are these counts plus the vocabulary's own weights as pseudo-counts; no
piece is added or taken away.  A text's probability is the product over its tokens of the sum over all
segmentations, by forward recursion in log space, and of the end token's weight.  Pieces never cross
a word mark, so that the product is the marginal of the whole text.

Texts are read in blocks of consecutive rows.  Each block lists its distinct words once, with the rows
they stand in; word counts, weights and word probabilities are joined by word; sums go back by block.
Words so frequent that there can be few of them (each a `HOT`-th of all tokens or more) are joined by
broadcast, so no word's rows meet in one task.

Defined cases: a null or empty text, or one of white space, is the end token alone; without training
texts all counts are 0 and the vocabulary's own weights decide; a row with a null key counts as held
out; repeated rows are scored (and learned from) each for itself; an empty table gives no rows; only
the named columns are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, read_table, small_batches

#: Rows in a block, and the UTF-8 bytes at which it is closed earlier.
BLOCK_ROWS = 4096
BLOCK_BYTES = 16 << 20
#: A word with at least this share of all tokens is hot: there are at most HOT such words.
HOT = 20_000
#: Pseudo-count mass of the vocabulary's own weights.
PRIOR = 1000.0
MARK = "▁"
END = "</s>"

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(0x41, 0x5B)})
_WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def words_of(text: str | None) -> list[str]:
    """Words between the six ASCII spaces, A to Z lower-cased."""
    return _WORD.findall(text.translate(_LOWER)) if text else []


def held_out(key):
    """crc32 of the key's text, modulo 7, is 2; a null key counts as held out."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 7 == 2, F.lit(True))


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 16384) -> Iterator[pa.RecordBatch]:
    """The same rows in larger batches: the lattice works on many words at once."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class _Numbers(dict):
    """Numbers keys in order of first sight."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class Vocabulary:
    """Pieces that can be in a word, byte pieces, the end piece, and their log probabilities."""

    def __init__(self, pieces: list[str], scores: list[float]):
        """The last 257 entries are the 256 byte pieces and the end piece."""
        self.pieces = pieces
        if 0.5 <= sum(math.exp(min(0.0, s)) for s in scores[:-257]) <= 1.5:
            p = np.exp(np.minimum(0.0, np.array(scores)))
        else:
            rank = np.argsort(np.argsort(-np.array(scores[:-257]), kind="stable"), kind="stable")
            p = 1 / (rank + 2.7)
            p = np.append(p, np.full(257, p.min()))
        self.prior = p / p.sum()
        self.log = np.log(self.prior)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        # pieces that can occur in "mark + lower-cased word", with the mark at the start only
        usable = re.compile(f"{MARK}?[^{MARK}A-Z]+|{MARK}")
        own = [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        own = [(p, s) for p, s in own if usable.fullmatch(p)]
        low = min((s for _, s in own), default=0.0)
        return cls([p for p, _ in own] + [f"<0x{b:02X}>" for b in range(256)] + [END], [s for _, s in own] + [low] * 257)

    def learn(self, expected: dict[int, float], prior: float = PRIOR) -> None:
        """Weights from expected counts plus the vocabulary's own weights as pseudo-counts."""
        n = self.prior * prior
        for i, v in expected.items():
            n[i] += v
        self.log = np.log(n / n.sum())


class Lattice:
    """Forward (and backward) sums over many words at once."""

    _MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, vocabulary: Vocabulary):
        own = vocabulary.pieces[:-257]
        self.byte0, self.end = len(own), len(own) + 256
        hashes: dict[int, int] = {}
        prefixes: set[int] = set()
        for i, p in enumerate(own):
            h = 0
            for c in p:
                h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                prefixes.add(h)
            hashes[h] = i
        raw = np.array(list(prefixes), np.uint64)
        order = np.argsort(self._mixed(raw))
        self.keys = self._mixed(raw)[order]
        self.piece = np.array([hashes.get(int(k), -1) for k in raw[order]], np.int64)
        self.longest = max(map(len, own), default=1)
        self.log = vocabulary.log
        # the upper bits of the sorted hashes lead to a short stretch of them
        self.shift = np.uint64(64 - 18)
        self.lead = np.searchsorted(self.keys, np.arange(1 << 18, dtype=np.uint64) << self.shift)
        self.reach = int(np.diff(np.append(self.lead, len(self.keys))).max(initial=1))

    @staticmethod
    def _mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ h >> np.uint64(32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Positions of hashes among the prefixes, -1 if absent."""
        h = self._mixed(h)
        at = self.lead[(h >> self.shift).astype(np.int64)]
        out = np.full(len(h), -1, np.int64)
        last = len(self.keys) - 1
        for k in range(self.reach):
            i = np.minimum(at + k, last)
            out = np.where(self.keys[i] == h, i, out)
        return out

    def _edges(self, codes: np.ndarray):
        """words x characters -> log weights and pieces of edges by (word, start, length - 1); pieces -1: none, -2: bytes."""
        n, size = codes.shape
        most = min(self.longest, size)
        log = np.full((n, size, most), -np.inf)
        piece = np.full((n, size, most), -1, np.int64)
        row, start = np.divmod(np.arange(n * size), size)
        h = np.zeros(n * size, np.uint64)
        for k in range(most):
            h = h * self._MIX + codes[row, start + k].astype(np.uint64) + np.uint64(1)
            at = self._find(h)
            live = at >= 0
            row, start, h, at = row[live], start[live], h[live], at[live]
            got = self.piece[at]
            ok = got >= 0
            piece[row[ok], start[ok], k] = got[ok]
            log[row[ok], start[ok], k] = self.log[got[ok]]
            go = start + k + 1 < size
            row, start, h = row[go], start[go], h[go]
            if not len(row):
                break
        bare = piece[:, :, 0] == -1
        if bare.any():
            for r, s in zip(*np.nonzero(bare), strict=True):
                raw = chr(int(codes[r, s])).encode("utf-8", "surrogatepass")
                log[r, s, 0] = sum(self.log[self.byte0 + b] for b in raw)
                piece[r, s, 0] = -2
        return log, piece

    @staticmethod
    def _sum(x: np.ndarray) -> np.ndarray:
        top = x.max(1)
        safe = np.where(np.isfinite(top), top, 0)
        with np.errstate(divide="ignore"):
            return safe + np.log(np.exp(x - safe[:, None]).sum(1))

    def _forward(self, log: np.ndarray) -> np.ndarray:
        n, size, most = log.shape
        alpha = np.full((n, size + 1), -np.inf)
        alpha[:, 0] = 0
        for e in range(1, size + 1):
            k = np.arange(min(most, e))
            alpha[:, e] = self._sum(alpha[:, e - 1 - k] + log[:, e - 1 - k, k])
        return alpha

    @staticmethod
    def _groups(words: list[str], cells: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers, codes) of words of one length, in bounded batches; the word mark is the first character."""
        size = np.array([len(w) for w in words])
        for length in np.unique(size):
            own = np.flatnonzero(size == length)
            step = max(1, cells // (16 * (int(length) + 1)))
            for i in range(0, len(own), step):
                part = own[i : i + step]
                raw = "".join(words[j] for j in part).encode("utf-32-le", "surrogatepass")
                codes = np.frombuffer(raw, "<u4").reshape(len(part), length).astype(np.int64)
                yield part, np.concatenate([np.full((len(part), 1), ord(MARK)), codes], 1)

    def score(self, words: list[str]) -> np.ndarray:
        """Log probabilities (natural) of the words, over all segmentations."""
        out = np.zeros(len(words))
        for part, codes in self._groups(words):
            out[part] = self._forward(self._edges(codes)[0])[:, -1]
        return out

    def expect(self, words: list[str], times: np.ndarray) -> np.ndarray:
        """Expected counts of all pieces in the words, each `times` there."""
        out = np.zeros(len(self.log))
        for part, codes in self._groups(words):
            log, piece = self._edges(codes)
            n, size, most = log.shape
            alpha = self._forward(log)
            beta = np.full((n, size + 1), -np.inf)
            beta[:, size] = 0
            for s in range(size - 1, -1, -1):
                k = np.arange(min(most, size - s))
                beta[:, s] = self._sum(beta[:, s + 1 + k] + log[:, s, k])
            row, start, k = np.nonzero(piece != -1)
            which = piece[row, start, k]
            mass = np.exp(alpha[row, start] + log[row, start, k] + beta[row, start + k + 1] - alpha[row, -1]) * times[part][row]
            own = which >= 0
            out += np.bincount(which[own], mass[own], len(out))
            for r, s, m in zip(row[~own], start[~own], mass[~own], strict=True):
                for b in chr(int(codes[r, s])).encode("utf-8", "surrogatepass"):
                    out[self.byte0 + b] += m
        return out


_LISTED = "block long, word string, rows array<int>, times long, keys array<{key}>, held array<boolean>, sizes array<int>"


def _list_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct words by block with the rows they stand in (one entry a token) and their training count; one more row a block (word null) lists its texts."""
    small_batches(df.sparkSession)
    frame = df.select(F.col(key).alias("k"), F.col(text).alias("t"), held_out(F.col(key)).alias("h"))
    kind = frame.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, nth = TaskContext.get().partitionId() << 32, 0
        keys, held, sizes, lists, weight = [], [], [], [], 0
        numbers = _Numbers()

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal keys, held, sizes, lists, weight, numbers, nth
            block, words = base + nth, list(numbers)
            which = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            order = np.argsort(which, kind="stable")
            times = np.bincount(which, ~np.array(held, bool)[row], len(words)).astype(np.int64) if words else np.zeros(0, np.int64)
            ends = np.cumsum(np.bincount(which, minlength=len(words))) if words else np.zeros(0, np.int64)
            row, at = row[order], 0
            none = lambda n, t: pa.nulls(n, pa.list_(t))
            key_type = keys_type
            while at < len(words):  # about a million tokens in a batch
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), side="right")))
                first = int(ends[at - 1]) if at else 0
                own = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends[at:to] - first]), pa.int32()), pa.array(row[first : int(ends[to - 1])], pa.int32()))
                n = to - at
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(words[at:to], pa.string()), own, pa.array(times[at:to]), none(n, key_type), none(n, pa.bool_()), none(n, pa.int32())], names)
                at = to
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([None], pa.string()), none(1, pa.int32()), pa.array([len(held) - sum(held)], pa.int64()),
                 pa.array([keys], pa.list_(key_type)), pa.array([held], pa.list_(pa.bool_())), pa.array([sizes], pa.list_(pa.int32()))], names)
            keys, held, sizes, lists, weight, numbers, nth = [], [], [], [], 0, _Numbers(), nth + 1

        names = ["block", "word", "rows", "times", "keys", "held", "sizes"]
        keys_type = None
        for b in batches:
            keys_type = b.schema.field("k").type
            for k, t, h in zip(b.column("k").to_pylist(), b.column("t").to_pylist(), b.column("h").to_pylist(), strict=True):
                words = words_of(t)
                lists.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                keys.append(k)
                held.append(h)
                sizes.append(len(words))
                weight += len(t or "")
                if len(keys) >= BLOCK_ROWS or weight >= BLOCK_BYTES:
                    yield from close()
        if keys:
            yield from close()

    return frame.mapInArrow(run, _LISTED.format(key=kind))


def score_texts(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = df.sparkSession
    listed = materialise(_list_blocks(df, key, text), "words")
    words, texts = listed.where(F.col("word").isNotNull()), listed.where(F.col("word").isNull())
    counts = materialise(words.groupBy("word").agg(F.sum("times").alias("c")), "counts")
    n_words, v_words = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    ends = texts.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    total, distinct = n_words + ends, v_words + (ends > 0)
    base = Vocabulary.load(vocabulary)
    first = spark.sparkContext.broadcast(base)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, sums = Lattice(first.value), 0.0
        for b in _gathered(batches):
            sums = sums + machine.expect(b.column("word").to_pylist(), b.column("c").to_numpy().astype(float))
        if isinstance(sums, np.ndarray):
            i = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(sums[i])], ["piece", "mass"])

    # one row a piece of the vocabulary at most
    mass = counts.where("c > 0").mapInArrow(expect, "piece int, mass double").groupBy("piece").agg(F.sum("mass")).collect()
    model = Vocabulary(base.pieces, [0.0] * len(base.pieces))
    model.prior = base.prior
    model.learn({r[0]: r[1] for r in sorted(mass)} | {len(base.pieces) - 1: float(ends)})
    learned = spark.sparkContext.broadcast(model)
    end_log = float(model.log[-1]) / math.log(10)

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Lattice(learned.value)
        for b in _gathered(batches):
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("c"), pa.array(machine.score(b.column("word").to_pylist()) / math.log(10))], ["word", "c", "log"])

    priced = materialise(counts.mapInArrow(price, "word string, c long, log double"), "prices")
    discard(counts)
    hot = F.col("c") * HOT >= total if total else F.lit(False)
    pairs = words.select("block", "word", "rows")
    few = F.broadcast(priced.where(hot))  # at most HOT words
    joined = pairs.join(few, "word").unionByName(pairs.join(F.broadcast(priced.where(hot).select("word")), "word", "left_anti").join(priced.where(~hot), "word"))
    bottom = float(total + distinct + 1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums by row of a block; a block's rows come one after the other."""
        now, acc = None, None

        def done():
            i = np.flatnonzero(acc[0])
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), *[pa.array([x[i]], pa.list_(t)) for x, t in ((np.arange(BLOCK_ROWS), pa.int32()), (acc[1], pa.int32()), (acc[2], pa.float64()), (acc[3], pa.float64()))]], names)

        names = ["block", "i", "known", "base", "model"]
        for b in batches:
            rows = b.column("rows")
            n = np.diff(rows.offsets.to_numpy())
            flat = rows.flatten().to_numpy()
            c, log = b.column("c").to_numpy(), b.column("log").to_numpy()
            block = np.repeat(b.column("block").to_numpy(), n)
            per = (np.repeat(c > 0, n), np.repeat(np.log10((c + 1) / bottom), n), np.repeat(log, n))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if s == e:
                    continue
                if block[s] != now:
                    if now is not None:
                        yield done()
                    now, acc = int(block[s]), np.zeros((4, BLOCK_ROWS))
                acc[0] += np.bincount(flat[s:e], minlength=BLOCK_ROWS)
                for k in range(3):
                    acc[k + 1] += np.bincount(flat[s:e], per[k][s:e], BLOCK_ROWS)
        if now is not None:
            yield done()

    parts = joined.select("block", "rows", "c", "log").sortWithinPartitions("block").mapInArrow(add, "block long, i array<int>, known array<int>, base array<double>, model array<double>")
    kind = df.select(F.col(key)).schema[0].dataType.simpleString()
    end_base = math.log10((ends + 1) / bottom)

    def finish(part: pa.Table, own: pa.Table) -> pa.Table:
        keys = own.column("keys").combine_chunks().flatten()
        sizes = own.column("sizes").combine_chunks().flatten().to_numpy().astype(np.int64)
        n = len(sizes)
        known, low, high = np.zeros(n), np.zeros(n), np.zeros(n)
        for i, k, x, y in zip(*[part.column(c) for c in ("i", "known", "base", "model")], strict=True):
            at = i.values.to_numpy()
            known[at] += k.values.to_numpy()
            low[at] += x.values.to_numpy()
            high[at] += y.values.to_numpy()
        return pa.table({"k": keys, "held_out": own.column("held").combine_chunks().flatten(), "n_tokens": sizes + 1, "n_known": known.astype(np.int64) + int(ends > 0),
                         "train_tokens": np.full(n, total, np.int64), "base_score": low + end_base, "score": high + end_log})

    out = parts.groupBy("block").cogroup(texts.select("block", "keys", "held", "sizes").groupBy("block")).applyInArrow(
        finish, f"k {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("k", key)


def op6_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    from .packing import tokenizer_path

    return score_texts(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
