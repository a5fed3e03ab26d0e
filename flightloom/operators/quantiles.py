"""Exact order statistics by counting, so no group has to fit in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightloom.session import cut_lineage


def _counted(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Distinct values with the rank of their first and last occurrence (0-based) and the group size.

    Equal values are merged before the shuffle. The distinct values are then dealt by ranges of (group, value) and written
    with the number of their range; ranks run inside a range and go on from the counts of the group's ranges before it, of
    which there are at most as many as partitions. A group of any size and any spread of values is so split evenly.
    """
    counts = df.groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranged = cut_lineage(counts.repartitionByRange(*by, "_v").withColumn("_range", F.spark_partition_id()))
    group = F.struct(*by, F.lit(0)) if by else F.lit(0)
    keyed = ranged.withColumn("_group", group)
    along = Window.partitionBy("_group").orderBy("_range")
    parts = keyed.groupBy("_group", "_range").agg(F.sum("_n").alias("_of_range")).select(
        F.col("_group").alias("_g"), F.col("_range").alias("_r"),
        F.coalesce(F.sum("_of_range").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_of_range").over(Window.partitionBy("_group")).alias("_size"),
    )
    inside = Window.partitionBy("_group", "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.join(parts, (F.col("_group") == F.col("_g")) & (F.col("_range") == F.col("_r")))
    upto = F.col("_before") + F.sum("_n").over(inside)
    return placed.withColumn("_upto", upto).select(
        *by, "_v", (F.col("_upto") - F.col("_n")).alias("_from"), (F.col("_upto") - 1).alias("_to"), "_size"
    )


def exact_quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles, one column per name in ``shares``, and ``n``, the size; null values must be
    filtered out. Groups with null keys are groups; without ``by`` all rows are one. One arithmetic for every size."""
    columns = []
    for name, share in shares.items():
        at = (F.col("_size") - 1) * share
        low, high = F.floor(at), F.ceil(at)
        columns += [
            F.max(F.when(low.between(F.col("_from"), F.col("_to")), F.col("_v"))).alias(f"_lo_{name}"),
            F.max(F.when(high.between(F.col("_from"), F.col("_to")), F.col("_v"))).alias(f"_hi_{name}"),
            F.max(at - low).alias(f"_w_{name}"),
        ]
    out = _counted(df, by, value).groupBy(*by).agg(F.max("_size").alias("n"), *columns)
    # no rows, no group: also where there is nothing to group by
    return out.filter(F.col("n").isNotNull()).select(
        *by, "n",
        *[
            F.when(F.col(f"_lo_{x}") == F.col(f"_hi_{x}"), F.col(f"_lo_{x}"))
            .otherwise(F.col(f"_lo_{x}") + (F.col(f"_hi_{x}") - F.col(f"_lo_{x}")) * F.col(f"_w_{x}")).alias(x)
            for x in shares
        ],
    )


def values_at(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Value at sorted index floor(n * share), at most the last one."""
    columns = []
    for name, share in shares.items():
        at = F.least(F.floor(F.col("_size") * share), F.col("_size") - 1)
        columns.append(F.max(F.when(at.between(F.col("_from"), F.col("_to")), F.col("_v"))).alias(name))
    out = _counted(df, by, value).groupBy(*by).agg(F.max("_size").alias("n"), *columns)
    return out.filter(F.col("n").isNotNull()).select(*by, "n", *shares)
