"""Time joins without pairs: both sides are merged into one timeline and values are carried along it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightloom.operators.prepare import image_rows
from flightloom.operators.timeline import FirstOf, LastWhere, NextWhere, scan


def _merged(left: DataFrame, right: DataFrame, by: list[str], at: str, time: str, tie: str, right_tie: str | None) -> DataFrame:
    """Rows of both sides with _t, _side (0 right, 1 left), _tie and their columns boxed."""
    r = right.select(
        *by, F.col(time).cast("double").alias("_t"), F.lit(0).alias("_side"),
        (F.col(right_tie) if right_tie else F.lit(0)).cast("bigint").alias("_tie"),
        F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"), F.struct(*right.columns).alias("_r"),
    )
    l = left.select(
        *by, F.col(at).cast("double").alias("_t"), F.lit(1).alias("_side"), F.col(tie).cast("bigint").alias("_tie"),
        F.struct(*left.columns).alias("_l"),
        F.lit(None).cast(right.select(F.struct(*right.columns)).schema[0].dataType).alias("_r"),
    )
    return r.unionByName(l)


def backward(
    left: DataFrame, right: DataFrame, by: list[str], at: str, time: str, take: list[str], width: float, tie: str,
    right_tie: str | None = None,
) -> DataFrame:
    """Every left row with the newest right row that is not later; nulls when there is none."""
    merged = _merged(left, right, by, at, time, tie, right_tie)
    found = scan(merged, by, ["_t", "_side", "_tie"], [LastWhere("_hit", F.col("_r"), F.col("_side") == 0)], width)
    return found.filter("_side = 1").select("_l.*", *[F.col(f"_hit.{name}").alias(name) for name in take])


def nearest(
    left: DataFrame, right: DataFrame, by: list[str], at: str, time: str, take: list[str], width: float, tie: str,
    right_tie: str,
) -> DataFrame:
    """Every left row with the right row nearest in time; the earliest such row on a tie."""
    merged = _merged(left, right, by, at, time, tie, right_tie)
    order = ["_t", "_side", "_tie"]
    # the first of several rows at one time wins, so each time keeps only that row
    firsts = right.groupBy(*by, F.col(time).cast("double").alias("_t")).agg(F.min(right_tie).alias("_first"))
    kept = merged.join(firsts, [*by, "_t"], "left").filter(
        (F.col("_side") == 1) | (F.col("_tie") == F.col("_first"))
    )
    steps = [
        LastWhere("_before", F.struct("_t", "_r"), F.col("_side") == 0),
        NextWhere("_after", F.struct("_t", "_r"), F.col("_side") == 0),
    ]
    found = scan(kept, by, order, steps, width).filter("_side = 1")
    back, ahead = F.col("_t") - F.col("_before._t"), F.col("_after._t") - F.col("_t")
    hit = F.when(ahead.isNull() | (back <= ahead), F.col("_before._r")).otherwise(F.col("_after._r"))
    return found.withColumn("_hit", hit).select("_l.*", *[F.col(f"_hit.{name}").alias(name) for name in take])


def image_targets(telemetry: DataFrame) -> DataFrame:
    """First row of every image and the time it was taken (its own stamp, else the row's)."""
    own = F.col("image_timestamp") if "image_timestamp" in telemetry.columns else F.col("t")
    first = image_rows(telemetry).groupBy("mission_id", "image_name").agg(
        F.min_by(F.struct(own.cast("double").alias("target_t"), F.col("seq").alias("first_seq")), "seq").alias("_f")
    )
    return first.select("mission_id", "image_name", "_f.*")


def sync_images(telemetry: DataFrame, take: list[str], width: float = 3600.0) -> tuple[DataFrame, DataFrame]:
    """Each image with the telemetry row nearest to its capture time, over all rows of the mission.

    Second result: images whose capture time is unknown.
    """
    targets = image_targets(telemetry)
    known = targets.filter(F.col("target_t").isNotNull())
    rows = telemetry.select("mission_id", *dict.fromkeys(["t", "seq", *take])).withColumnRenamed("seq", "row_seq")
    want = ["row_seq" if name == "seq" else name for name in dict.fromkeys(["t", "seq", *take])]
    synced = nearest(known, rows, ["mission_id"], "target_t", "t", want, width, "first_seq", "row_seq")
    return synced.withColumn("delta_s", F.abs(F.col("t") - F.col("target_t"))), targets.filter(F.col("target_t").isNull())


def sync_images_own(telemetry: DataFrame, take: list[str]) -> DataFrame:
    """As sync_images, but only rows that name the image compete; target 0 means its first row."""
    rows = image_rows(telemetry)
    own = F.col("image_timestamp") if "image_timestamp" in telemetry.columns else F.col("t")
    # the target is the first row's stamp; its distance to every row needs it beside them
    targets = image_targets(telemetry).select("mission_id", "image_name", F.coalesce("target_t", F.lit(0.0)).alias("target_t"))
    beside = rows.join(targets, ["mission_id", "image_name"])
    miss = F.when(F.col("target_t") == 0, F.lit(0.0)).otherwise(F.abs(F.col("t") - F.col("target_t")))
    picked = F.min_by(F.struct("t", "seq", "target_t", *[x for x in take if x not in ("t", "seq")]), F.struct(miss, F.col("seq")))
    return beside.groupBy("mission_id", "image_name").agg(picked.alias("_p")).select("mission_id", "image_name", "_p.*")


def sensor_ages(captures: DataFrame, samples: DataFrame, sensors: list[str], width: float = 3600.0) -> DataFrame:
    """Milliseconds since the last sample of each sensor at capture time, -1 when there was none.

    ``samples`` has mission_id, sensor, t.
    """
    merged = _merged(captures, samples, ["mission_id"], "t", "t", "seq", None)
    steps = [
        LastWhere(f"_{s}", F.col("_t"), (F.col("_side") == 0) & (F.col("_r.sensor") == s)) for s in sensors
    ]
    found = scan(merged, ["mission_id"], ["_t", "_side", "_tie"], steps, width).filter("_side = 1")
    ages = [F.coalesce(F.abs(F.col("_t") - F.col(f"_{s}")) * 1000.0, F.lit(-1.0)).alias(f"{s.lower()}_age_ms") for s in sensors]
    return found.select("_l.*", *ages)


def events_in_state(events: DataFrame, intervals: DataFrame, width: float = 3600.0) -> DataFrame:
    """Each event with the state interval it falls into; intervals of a mission do not overlap."""
    spans = intervals.select("mission_id", "to_state", "entered_at", "left_at")
    matched = backward(events, spans, ["mission_id"], "t", "entered_at", ["to_state", "entered_at", "left_at"], width, "seq")
    return matched.filter(F.col("entered_at").isNotNull() & (F.col("t") <= F.col("left_at")))


def nav_error(lat1: Column, lon1: Column, lat2: Column, lon2: Column, valid: Column) -> Column:
    """Metres between estimate and fix where both are valid, else -1."""
    from flightloom.functions import geo

    return F.when(valid, geo.flat_distance_m(lat1, lon1, lat2, lon2)).otherwise(F.lit(-1.0))
