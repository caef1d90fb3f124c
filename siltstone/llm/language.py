"""Operator 3, language ID: a byte convolutional network in numpy.

Bytes are embedded; filters of widths 2, 3 and 4 slide over windows of fixed length; each filter's
greatest response in the window goes to a softmax over the learned languages.  A text's distribution
is the mean over all its windows, weighted by their bytes.  Training is plain numpy (Adam) on the
driver, on a bounded sample of labelled texts: at most `SAMPLE` texts a language, `WINDOWS` windows of
each.  For prediction, a filter's response is the sum of two entries of tables over pairs of bytes,
so a batch of windows takes two lookups, one addition and one maximum.

Defined cases: `und` with score 0 if the text is null or has no letter, or if nothing could be learned;
a text shorter than a window is padded with zero bytes; a null label is not learned from; rows with
a null key are predicted, not learned from; repeated rows are predicted each for itself; only the
named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, small_batches

LENGTH = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBED = 8
#: Bounds of the training sample: texts a language, windows a text.
SAMPLE = 400
WINDOWS = 3
STEPS = 300
UNKNOWN = "und"


class ByteCNN:
    """Embedding, multi-width filters, max pooling over a window, softmax."""

    def __init__(self, n_classes: int, seed: int = 0):
        r = np.random.default_rng(seed)
        self.p = {"E": r.normal(0, 0.5, (256, EMBED)), "V": r.normal(0, 0.1, (len(WIDTHS) * FILTERS, n_classes)), "c": np.zeros(n_classes), "b": np.zeros(len(WIDTHS) * FILTERS)}
        for w in WIDTHS:
            self.p[f"W{w}"] = r.normal(0, 1 / np.sqrt(w * EMBED), (w * EMBED, FILTERS))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _forward(self, x: np.ndarray):
        """x: windows x (LENGTH + 3) bytes.  Pooled responses, where they come from, probabilities."""
        e = self.p["E"][x]
        pooled, where = [], []
        for w in WIDTHS:
            cols = np.concatenate([e[:, j : j + LENGTH] for j in range(w)], axis=2)
            z = cols @ self.p[f"W{w}"]
            at = z.argmax(1)
            where.append(at)
            pooled.append(np.take_along_axis(z, at[:, None], 1)[:, 0])
        h = np.concatenate(pooled, 1) + self.p["b"]
        a = np.maximum(h, 0)
        s = a @ self.p["V"] + self.p["c"]
        s = np.exp(s - s.max(1, keepdims=True))
        return e, h, a, where, s / s.sum(1, keepdims=True)

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = 64, rate: float = 0.01, seed: int = 1) -> None:
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        labels = np.unique(y)
        rows = [np.flatnonzero(y == k) for k in labels]
        for t in range(1, steps + 1):
            pick = np.concatenate([r.choice(own, max(1, batch // len(rows))) for own in rows])  # as many of each language
            xb, yb = x[pick], y[pick]
            e, h, a, where, prob = self._forward(xb)
            d = prob
            d[np.arange(len(yb)), yb] -= 1
            d /= len(yb)
            g = {"V": a.T @ d, "c": d.sum(0)}
            dh = d @ self.p["V"].T * (h > 0)
            g["b"] = dh.sum(0)
            ge = np.zeros_like(self.p["E"])
            i = np.arange(len(yb))[:, None]
            for k, w in enumerate(WIDTHS):
                own = dh[:, k * FILTERS : (k + 1) * FILTERS]
                taps = where[k][..., None] + np.arange(w)  # batch x filters x w
                src = e[i[..., None], taps]
                g[f"W{w}"] = np.einsum("bf,bfk->kf", own, src.reshape(*src.shape[:2], -1))
                back = (own[..., None] * self.p[f"W{w}"].T).reshape(*own.shape, w, EMBED)
                np.add.at(ge, xb[i[..., None], taps], back)
            g["E"] = ge
            for k, v in g.items():
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.99 * s[k] + 0.01 * v * v
                self.p[k] -= rate * (1 - 0.7 * t / steps) * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses to a filter's first and last two bytes, by pair of bytes."""
        n, total = len(WIDTHS) * FILTERS, []
        for tap in range(4):
            part = np.zeros((256, n), np.float32)
            for k, w in enumerate(WIDTHS):
                if tap < w:
                    part[:, k * FILTERS : (k + 1) * FILTERS] = self.p["E"] @ self.p[f"W{w}"][tap * EMBED : (tap + 1) * EMBED]
            total.append(part)
        pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, n)
        return pair(total[0] + self.p["b"], total[1]), pair(total[2], total[3])


def padded(raw: bytes, at: int = 0) -> np.ndarray:
    """A training window: LENGTH + 3 bytes from `at`."""
    out = np.zeros(LENGTH + 3, np.uint8)
    part = np.frombuffer(raw[at : at + LENGTH + 3], np.uint8)
    out[: len(part)] = part
    return out


class Predictor:
    """Distributions of whole texts."""

    AT_ONCE = 128  # windows whose responses are in memory

    def __init__(self, model: ByteCNN):
        self.first, self.second = model.tables()
        self.v, self.c = model.p["V"], model.p["c"]

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """texts x languages."""
        size = np.array([len(t) for t in texts], np.int64)
        n = -(-(size + 3) // LENGTH)  # three zero bytes at least after each text
        buffer = np.zeros(int(n.sum()) * LENGTH + 4, np.uint8)
        starts = (np.cumsum(n) - n) * LENGTH
        for s, t in zip(starts.tolist(), texts, strict=True):
            buffer[s : s + len(t)] = np.frombuffer(t, np.uint8)
        pairs = buffer[:-1].astype(np.intp) << 8 | buffer[1:]
        windows = int(n.sum())
        logits = np.empty((windows, len(self.c)), np.float32)
        for i in range(0, windows, self.AT_ONCE):
            a, b = i * LENGTH, min(windows, i + self.AT_ONCE) * LENGTH
            z = self.first[pairs[a:b]]
            z += self.second[pairs[a + 2 : b + 2]]
            logits[i : b // LENGTH] = np.maximum(z.reshape(-1, LENGTH, z.shape[1]).max(1), 0) @ self.v + self.c
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        owner = np.repeat(np.arange(len(texts)), n)
        weight = np.clip(size[owner] - (np.arange(windows) - np.repeat(np.cumsum(n) - n, n)) * LENGTH, 0, LENGTH)
        out = np.stack([np.bincount(owner, weight * p[:, k], len(texts)) for k in range(p.shape[1])], 1)
        return out / np.maximum(size, 1)[:, None]


def held_out(key: Column) -> Column:
    """crc32 of the key's text, modulo 5, is 0; a null key counts as held out."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 5 == 0, F.lit(True))


def learn(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", sample: int = SAMPLE, windows: int = WINDOWS) -> tuple[list[str], ByteCNN | None]:
    """The languages and the trained network, from rows that aren't held out.

    The number of labels is the number of languages; a label's rows are taken with a probability that
    gives about twice `sample` rows, and the first `sample` of these by hash are used."""
    spark = df.sparkSession
    rows = df.where(~held_out(F.col(key)) & F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(label).alias("y"), F.col(text).alias("t"), F.xxhash64(F.col(key).cast("string"), F.lit(7)).alias("h"))
    counts = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    if not counts:
        return [], None
    share = spark.createDataFrame([(y, min(1.0, 2.0 * sample / n)) for y, n in sorted(counts.items())], "y string, share double")
    small_batches(spark)
    taken = rows.join(F.broadcast(share), "y").where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("y", "t", "h")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, h, out = [], [], []
            for label_, t, hash_ in zip(b.column("y").to_pylist(), b.column("t").to_pylist(), b.column("h").to_pylist(), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                for at in sorted({int(i * max(0, len(raw) - LENGTH) / max(1, windows - 1)) for i in range(windows)}):
                    y.append(label_)
                    h.append(hash_)
                    out.append(raw[at : at + LENGTH + 3])
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.string()), pa.array(h, pa.int64()), pa.array(out, pa.binary())], ["y", "h", "x"])

    got = sorted(tuple(r) for r in taken.mapInArrow(cut, "y string, h long, x binary").collect())
    languages = sorted(counts)
    x, y, seen = [], [], {}
    for label_, h, raw in got:
        own = seen.setdefault(label_, set())
        own.add(h)
        if len(own) <= sample:
            x.append(padded(bytes(raw)))
            y.append(languages.index(label_))
    if not x:
        return [], None
    model = ByteCNN(len(languages))
    model.train(np.stack(x), np.array(y))
    return languages, model


def identify(df: DataFrame, languages: list[str], model: ByteCNN | None, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carried columns, lang_pred, score) of every row; only the text decides."""
    spark = df.sparkSession
    small_batches(spark)
    frame = df.select(F.col(key).alias("k"), F.col(text).alias("t"), *[F.col(c).alias(f"c{j}") for j, c in enumerate(carry)], F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    kept = [f"c{j}" for j in range(len(carry))]
    schema = ", ".join(f"{n} {frame.schema[n].dataType.simpleString()}" for n in ["k", *kept]) + ", lang_pred string, score double"
    held = spark.sparkContext.broadcast((languages, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, model = held.value
        machine = Predictor(model) if model else None
        for b in batches:
            texts, letters = b.column("t").to_pylist(), b.column("letters").to_pylist()
            name, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            mine = [i for i, ok in enumerate(letters) if ok] if machine else []
            for j in range(0, len(mine), 64):
                rows = mine[j : j + 64]
                p = machine.predict([texts[i].encode("utf-8", "surrogatepass") for i in rows])
                for i, best, value in zip(rows, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                    name[i], score[i] = languages[best], min(1.0, value)
            yield pa.RecordBatch.from_arrays([b.column("k"), *[b.column(c) for c in kept], pa.array(name, pa.string()), pa.array(score, pa.float64())], ["k", *kept, "lang_pred", "score"])

    return frame.mapInArrow(run, schema).select(F.col("k").alias(key), *[F.col(f"c{j}").alias(c) for j, c in enumerate(carry)], "lang_pred", "score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = read_table(spark, sf_dir, "documents")
    out = identify(docs, *learn(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
