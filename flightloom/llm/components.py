"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flightloom.llm.shared import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u > v). Large: every larger neighbour of u is tied to the least of u and its neighbours; small: every
    smaller neighbour of u, and u, to the least of them."""
    pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = pairs.join(least, "u")
    if large:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id that each id of edges (u, v) is connected with, itself too.

    Rounds end when every id is tied to one other, the least; their number grows with the logarithm of the longest
    path. Each round's edges, no more than the first, are written. Runs its jobs at once.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        after = stored(_star(_star(now, True), False), "edges")
        signature = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        done = signature(after) == signature(now)
        now = after
        if done:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
