"""Orders and first rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightloom.functions.values import basename, trailing_number
from flightloom.operators.timeline import RowNumber, scan

_NO_NUMBER = 10**12


def image_order(images: DataFrame, width: float = 1e6) -> DataFrame:
    """Position of each image: dated ones by time, then undated, each by last number and lower-case name.

    Needs taken_at (seconds or null) and image_name.
    """
    c = F.col
    number = F.coalesce(trailing_number(c("image_name")), F.lit(_NO_NUMBER))
    keyed = images.select(
        "*", c("taken_at").isNull().cast("int").alias("_undated"), F.coalesce("taken_at", F.lit(0.0)).alias("_at"),
        number.alias("_num"), F.lower(basename(c("image_name"))).alias("_name"),
    )
    # undated images come after every dated one; within them the number leads
    place = F.when(c("_undated") == 0, c("_at")).otherwise(F.lit(1e15) + c("_num"))
    order = ["_place", "_undated", "_at", "_num", "_name"]
    out = scan(keyed.withColumn("_place", place), ["mission_id"], order, [RowNumber("position")], width)
    return out.select(*images.columns, "position")


def select_images(df: DataFrame, n: int, order: tuple[str, ...] = ("t", "seq")) -> DataFrame:
    """The first n images per mission; Spark keeps n per mission before the shuffle."""
    first = Window.partitionBy("mission_id").orderBy(*order)
    return df.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= n).drop("_r")


def ordered(df: DataFrame, order: tuple[str, ...] = ("mission_id", "t", "seq")) -> DataFrame:
    """Total order by range partitions."""
    return df.orderBy(*order)
