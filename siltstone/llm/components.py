"""Connected components of links between long ids, by alternating large and small stars.

Every round is written to the shared folder; the driver learns only whether it was the last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), v < u.  Large: every node's larger neighbours go to its least neighbour or itself; small: every node and its smaller neighbours go to the least of them."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every id in `links` (a, b); label is the least id of its component."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    before = None
    while True:
        edges = materialise(_star(_star(edges, True), False), "stars")
        if before is not None:
            discard(before)
        before = edges
        # all are stars, each apart from the others: a node has one centre, and a centre only itself
        labels = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), "v"))
        if labels.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo <> hi").isEmpty():
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("label"))).distinct()
