"""Chains of pointers: which rows are reached from given ones by following a pointer again and again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightloom.session import cut_lineage


def reached(start: DataFrame, pointers: DataFrame) -> DataFrame:
    """(id): the ids of start and all that pointers (id, to) lead to from there; an id has one pointer at most.

    Doubling: round k adds what lies 2**k steps behind all that is known and then joins the pointers with themselves,
    so a chain of n rows ends after about log2(n) rounds. Runs its jobs at once.
    """
    known, steps = cut_lineage(start.select("id")), pointers.filter(F.col("to").isNotNull()).select("id", "to")
    while True:
        more = cut_lineage(known.join(steps, "id").select(F.col("to").alias("id")))
        if more.isEmpty():
            return known
        known = cut_lineage(known.unionByName(more))
        ahead = steps.select(F.col("id").alias("to"), F.col("to").alias("further"))
        steps = cut_lineage(steps.join(ahead, "to").select("id", F.col("further").alias("to")))
