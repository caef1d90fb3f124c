"""Resemblance features and grouping of similar unique chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import FeatureParams, super_features
from ..plans.storage import materialise, small_batches


def with_super_features(chunks: DataFrame, params: FeatureParams | None = None) -> DataFrame:
    """Chunks with data: data is replaced by the array of super-features."""
    params = params or FeatureParams()
    small_batches(chunks.sparkSession)
    names = [c for c in chunks.columns if c != "data"]
    schema = ", ".join(f"{n} {chunks.schema[n].dataType.simpleString()}" for n in names) + ", super_features array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = super_features([x or b"" for x in b.column("data").to_pylist()], params)
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(list(got), pa.list_(pa.int64()))], [*names, "super_features"])

    return chunks.select(*names, "data").mapInArrow(run, schema)


def leaders(features: DataFrame, order: str = "arrival") -> DataFrame:
    """(order column, leader): greedy leader grouping, exactly as if chunks came one by one.

    In order, a chunk joins the group of an earlier leader that has one of its super-features at the same
    place (the first such place decides), else it leads a group; only leaders' features are indexed.  The
    leaders are the first maximal independent set of the collision graph, found in rounds: a chunk that
    is the first undecided one for all its features leads; an undecided chunk that shares a feature
    with an earlier leader is a member.  Each round is written to the shared folder; the first undecided
    chunk always decides, so the rounds end.  `order` must be unique."""
    cand = materialise(features.select(F.col(order).alias("a"), F.posexplode("super_features").alias("i", "sf")), "features")
    undecided, found = cand, None
    while True:
        first = undecided.groupBy("i", "sf").agg(F.min("a").alias("least"))
        lead = undecided.join(first, ["i", "sf"]).groupBy("a").agg(F.min((F.col("a") == F.col("least")).cast("int")).alias("all")).where("all = 1").select("a")
        lead = materialise(lead, "leaders")
        found = lead if found is None else found.unionByName(lead)
        index = cand.join(lead, "a", "left_semi").select("i", "sf", F.col("a").alias("leader"))
        member = undecided.join(index, ["i", "sf"]).where("leader < a").select("a")
        undecided = materialise(undecided.join(lead.union(member).distinct(), "a", "left_anti"), "undecided")
        if undecided.isEmpty():
            break
    found = materialise(found, "leaders")
    index = cand.join(found, "a", "left_semi").select("i", "sf", F.col("a").alias("leader"))
    joined = cand.join(found, "a", "left_anti").join(index, ["i", "sf"]).where("leader < a").groupBy("a").agg(F.min_by("leader", "i").alias("leader"))
    return joined.unionByName(found.select("a", F.col("a").alias("leader"))).withColumnRenamed("a", order)


def skip_groups(successors: DataFrame) -> DataFrame:
    """(chunk_hash, leader): unique chunks that follow the same chunk share the group of the first of them; `successors` has file_ord, seq, prev_hash."""
    arrival = F.struct("file_ord", "seq")
    first = successors.where(F.col("prev_hash").isNotNull()).groupBy("prev_hash").agg(F.min_by("chunk_hash", arrival).alias("leader"))
    return successors.join(first, "prev_hash", "left").select("chunk_hash", F.coalesce("leader", "chunk_hash").alias("leader"))


def duplicate_adjacency(chunks: DataFrame, run: int = 5) -> DataFrame:
    """(chunk_hash, anchor_file, anchor_seq, side, file_ord, seq): an order of unique chunks in which a run of up to `run`
    unique chunks right after a duplicate follows that duplicate's first occurrence, else one right before
    a duplicate precedes it, else arrival decides.  Sort by the last five columns.

    The runs are found inside a file, by windows over one file's chunks."""
    from pyspark.sql import Window

    from .dedup import with_first

    marked = with_first(chunks)
    w = Window.partitionBy("file_ord").orderBy("seq")
    dup = F.when(~F.col("is_unique"), F.struct("seq", "first_file", "first_seq"))
    near = marked.withColumns({
        "prev": F.last(dup, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "next": F.first(dup, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)),
    }).where("is_unique")
    after = F.col("seq") - F.col("prev.seq") <= run
    ahead = F.col("next.seq") - F.col("seq") <= run
    pick = lambda a, b, c: F.when(after, a).when(ahead, b).otherwise(c)
    return near.select(
        "chunk_hash", pick(F.col("prev.first_file"), F.col("next.first_file"), F.col("file_ord")).alias("anchor_file"), pick(F.col("prev.first_seq"), F.col("next.first_seq"), F.col("seq")).alias("anchor_seq"),
        pick(F.lit(1), F.lit(-1), F.lit(0)).alias("side"), "file_ord", "seq")
