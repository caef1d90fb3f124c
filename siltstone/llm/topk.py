"""Operator 2, exact top-k by inner product: an impact-ordered index, score at a time.

A block of vectors is indexed by dimension and quantised value: each (dimension, level) is a posting
segment.  A query gives a segment the impact weight x level; segments are processed by descending
impact, each adding its impact to its vectors' accumulators.  What is not yet processed bounds how far
any score can still move, so at set points the index knows a floor under the k-th best score and a
ceiling over each vector.  It stops when the vectors whose ceiling reaches the floor are few, or when
all segments are done; these vectors, however many, are then scored exactly.  Every other vector is
proven out, so the result is exact, ties included.

Queries meet all vectors in blocks: both sides are copied to the (vector block, query block) pairs, and
the k best of each block are merged by query.

A vector's components go to Python as they are and are floored there: y = floor(scale * x) / scale, which a
double holds exactly as scale is a power of two.  Bounds are computed in doubles, scaled to at most 1 and
widened by more than their rounding; scores are exact integers, in 64 bits where these suffice and in
Python's integers else.  An index is built for each pair of blocks: sorting a block by level costs about as
much as a few of its 1,024 queries.

Defined cases: vectors that are null or hold a null or a non-finite component take no part; finite
components of any size do, and a score beyond 64 bits is ranked as it is and returned as the nearest long;
a row with a null id is a candidate (after all ids in a tie) and a query if the query column holds;
vectors of unequal length are compared over the shorter one's components; an empty vector scores 0;
rows that repeat an id are rows of their own, and a query leaves out only its own row; only the named
columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read_table

SCALE = 1024
VECTORS = 8192  # in a block
QUERIES = 1024
#: Shares of the postings after which the index tries to stop.
TRIES = (0.6, 0.85, 1.0)


class ImpactIndex:
    """Posting segments of a block of integer vectors, by (dimension, level)."""

    LEVELS = 128

    def __init__(self, vectors: np.ndarray):
        n, dims = vectors.shape
        top = np.abs(vectors).max(initial=0)
        vectors = vectors / top if top else vectors  # at most 1, so that no product overflows
        self.n, self.most = n, np.abs(vectors).max(0, initial=0)
        low = float(vectors.min(initial=0))
        self.step = max((float(vectors.max(initial=0)) - low) / self.LEVELS, 2.0**-40)
        level = np.floor((vectors - low) / self.step).astype(np.int64)
        order = np.argsort(level, axis=0, kind="stable")
        self.posts = np.ascontiguousarray(order.T).reshape(-1).astype(np.int32)
        sorted_levels = np.take_along_axis(level, order, 0).T.reshape(-1)
        dim = np.repeat(np.arange(dims), n)
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(sorted_levels) != 0) | (np.diff(dim) != 0)])) if len(dim) else np.zeros(0, np.int64)
        self.start, self.stop = cut, np.append(cut[1:], len(dim))
        self.dim, self.low = dim[cut], low + sorted_levels[cut] * self.step
        self.size = self.stop - self.start

    def top(self, query: np.ndarray, k: int, leave_out: np.ndarray) -> np.ndarray:
        """Rows that hold the k best scores and all ties, as far as scores decide; `leave_out` rows don't count."""
        n, top = self.n, np.abs(query).max(initial=0)
        query = query / top if top else query
        weight = query[self.dim]
        a, b = weight * self.low, weight * (self.low + self.step)
        low, high = np.minimum(a, b), np.maximum(a, b)  # what a posting of the segment adds to a score
        order = np.argsort(-np.abs(a + b), kind="stable")
        done = np.cumsum(self.size[order])
        rounding = 1e-9 * (float(np.abs(query) @ self.most) + float(np.abs(query).sum()) * self.step + 1e-30)
        slack = float(np.abs(query).sum()) * self.step + rounding
        acc, at = np.zeros(n), 0
        for share in TRIES:
            to = len(order) if share == 1 else int(np.searchsorted(done, share * done[-1])) if len(order) else 0
            part = order[at:to]
            if len(part):
                size = self.size[part]
                pick = np.repeat(self.start[part] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                acc += np.bincount(self.posts[pick], np.repeat(low[part].astype(np.float64), size), n)
            at = max(at, to)
            rest = order[at:]
            up, down = np.zeros(len(query)), np.zeros(len(query))
            np.maximum.at(up, self.dim[rest], high[rest])
            np.minimum.at(down, self.dim[rest], low[rest])
            floor = acc + (down.sum() - rounding)
            floor[leave_out] = -np.inf
            best = np.partition(floor, n - k)[n - k] if n > k else -np.inf
            possible = np.flatnonzero(acc + slack + up.sum() >= best)
            if share == 1 or len(possible) <= 4 * k:
                return possible[~np.isin(possible, leave_out)]
        return np.arange(0)


def _matrix(column: pa.ChunkedArray, dims: int, scale: int) -> np.ndarray:
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    n = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(n), dims))
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    flat = np.where(np.abs(flat) < 2.0**52 / scale, np.floor(flat * scale) / scale, flat)  # beyond, scale * x is whole
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _scores(x: np.ndarray, q: np.ndarray, scale: int) -> np.ndarray:
    """Exact integer inner products of scale * x (rows) and scale * q."""
    most = [float(np.abs(v).max(initial=0)) * scale for v in (x, q)]
    if max(most) < 2.0**62 and most[0] * most[1] * max(1, len(q)) < 2.0**62:
        return (x * scale).astype(np.int64) @ (q * scale).astype(np.int64)
    whole = lambda v: int(v * scale) if abs(v) < 2.0**52 else int(v) * scale
    own = [whole(v) for v in q.tolist()]
    return np.array([sum(whole(v) * w for v, w in zip(row, own, strict=True)) for row in x.tolist()], object)


def _sortable(score: int) -> bytes:
    """Bytes that sort as integers of any size do."""
    size = (score.bit_length() + 8) // 8
    return (0x8000 + (size if score >= 0 else -size)).to_bytes(2, "big") + (score if score >= 0 else score + (1 << 8 * size)).to_bytes(size, "big")


def top_k(df: DataFrame, is_query, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, vectors: int = VECTORS, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which the column `is_query` holds, the k best other rows; `scale` is a power of two."""
    if scale < 1 or scale & scale - 1:
        raise ValueError("scale must be a power of two")
    ok = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = materialise(
        df.where(F.coalesce(ok, F.lit(False))).select(
            F.col(key).cast("long").alias("id"), F.col(vector).alias("v"),
            F.coalesce(is_query, F.lit(False)).alias("q"), F.monotonically_increasing_id().alias("row")),
        "vectors")
    size = rows.agg(F.count("*"), F.sum(F.col("q").cast("long")), F.max(F.size("v"))).first()
    n_blocks, q_blocks, dims = -(-size[0] // vectors) or 1, -(-(size[1] or 0) // queries) or 1, size[2] or 0
    block = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("id", "row", "v", block(n_blocks, 1).alias("nb"), every(q_blocks).alias("qb"))
    right = rows.where("q").select("id", "row", "v", every(n_blocks).alias("nb"), block(q_blocks, 2).alias("qb"))

    def search(base: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"query": [], "query_id": [], "row": [], "vec_id": [], "score": [], "by": []}
        if base.num_rows and asked.num_rows:
            x, q = _matrix(base.column("v"), dims, scale), _matrix(asked.column("v"), dims, scale)
            none, ids, own = pc.is_null(base.column("id")).to_numpy(), pc.fill_null(base.column("id"), 0).to_numpy(), base.column("row").to_numpy()
            index = ImpactIndex(x)
            for i, (row, who) in enumerate(zip(asked.column("row").to_pylist(), asked.column("id").to_pylist(), strict=True)):
                possible = index.top(q[i], k, np.flatnonzero(own == row))
                score = _scores(x[possible], q[i], scale)
                best = np.lexsort((own[possible], ids[possible], none[possible], -score))[:k]
                own_best, score = possible[best].tolist(), score[best].tolist()
                out["query"] += [row] * len(best)
                out["query_id"] += [who] * len(best)
                out["row"] += own[own_best].tolist()
                out["vec_id"] += [None if none[j] else int(ids[j]) for j in own_best]
                out["score"] += [max(-(1 << 63), min((1 << 63) - 1, v)) for v in score]
                out["by"] += [_sortable(v) for v in score]
        return pa.table({n: pa.array(v, pa.binary() if n == "by" else pa.int64()) for n, v in out.items()})

    found = left.groupBy("nb", "qb").cogroup(right.groupBy("nb", "qb")).applyInArrow(search, "query long, query_id long, row long, vec_id long, score long, by binary")
    best = Window.partitionBy("query").orderBy(F.desc("by"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best other vectors for every vector whose id is divisible by 100."""
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP2_SQL = """
with v as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 1024) as bigint)) as e
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.r as qr, q.vec_id as query_id, c.r, c.vec_id, cast(list_sum(list_transform(range(1, least(len(q.e), len(c.e)) + 1), lambda i: q.e[i] * c.e[i])) as bigint) as score
  from v q join v c on q.r <> c.r where q.vec_id % 100 = 0),
t as (select *, row_number() over (partition by qr order by score desc, vec_id, r) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from t where rank <= 10
"""
