"""Per-mission rollups and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightloom import params as P
from flightloom.functions import pressure
from flightloom.operators.prepare import geotagged, image_rows
from flightloom.operators.timeline import Previous, RowNumber, scan, with_preceding_rows

SEVERITY = ("SKIP", "PASS", "WARN", "FAIL")
SESSION_SIGNALS = (
    "baro_altitude", "gps_altitude", "vertical_velocity", "roll", "pitch", "yaw", "bus_voltage_v", "current_a",
)
CATEGORIES = (
    ("Sensors", "GPS"), ("Sensors", "IMU"), ("Sensors", "Barometer"),
    ("Payload", "Camera"), ("Payload", "Gimbal"), ("Payload", "ImageQuality"), ("Payload", "Storage"),
    ("Logging", "DataLogger"), ("Power", "Power"), ("Navigation", "Navigation"), ("Telemetry", "Telemetry"),
    ("System", "System"),
)


def geotag_summary(df: DataFrame) -> DataFrame:
    tagged = geotagged(df).groupBy("mission_id", "image_name").agg(F.count(F.lit(1)).alias("_n"))
    images = tagged.groupBy("mission_id").agg(F.sum("_n").alias("geotagged"), F.count(F.lit(1)).alias("unique_images"))
    total = df.groupBy("mission_id").agg(F.count(F.lit(1)).alias("total_records"))
    return total.join(images, "mission_id", "left").fillna(0)


def map_centre(df: DataFrame) -> DataFrame:
    return df.groupBy("mission_id").agg(F.avg("latitude").alias("centre_lat"), F.avg("longitude").alias("centre_lon"))


def endpoints(df: DataFrame) -> DataFrame:
    here, at = F.struct("latitude", "longitude"), F.struct("t", "seq")
    ends = df.groupBy("mission_id").agg(F.min_by(here, at).alias("a"), F.max_by(here, at).alias("b"))
    return ends.select(
        "mission_id", F.col("a.latitude").alias("start_lat"), F.col("a.longitude").alias("start_lon"),
        F.col("b.latitude").alias("end_lat"), F.col("b.longitude").alias("end_lon"),
    )


def session_minmax(samples: DataFrame, by: list[str]) -> DataFrame:
    have = [s for s in SESSION_SIGNALS if s in samples.columns]
    return samples.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sample_count"),
        *[f(s).alias(f"{n}_{s}") for s in have for n, f in (("min", F.min), ("max", F.max))],
    )


def session_report(samples: DataFrame, events: DataFrame, states: DataFrame, workers: DataFrame) -> DataFrame:
    """Sample count and extremes with the number of events, state changes and workers."""
    def counted(df, name):
        return df.groupBy("mission_id").agg(F.count(F.lit(1)).alias(name))

    out = session_minmax(samples, ["mission_id"])
    for part in (
        counted(events, "events"), counted(states, "state_changes"),
        counted(workers.select("mission_id", "worker").distinct(), "workers"),
    ):
        out = out.join(part, "mission_id", "left")
    return out.fillna(0, ["events", "state_changes", "workers"])


def power_summary(df: DataFrame) -> DataFrame:
    v = F.col("bus_voltage_v")
    return df.groupBy("mission_id").agg(
        F.min(F.when(v > 0, v)).alias("min_voltage_v"),
        F.greatest(F.lit(0.0), F.max("current_a")).alias("max_current_a"),
        F.count_if(v < P.UNDERVOLTAGE_V).alias("undervoltage_events"),
    )


def quality_counts(quality: DataFrame, by: list[str]) -> DataFrame:
    return quality.groupBy(*by).agg(
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("GOOD", "MARGINAL", "REJECTED")]
    )


def reconstruction_report(
    captures: DataFrame, quality: DataFrame, edges: DataFrame, geometry: DataFrame, issues: DataFrame,
    timings: DataFrame | None = None,
) -> DataFrame:
    """One row per mission: totals, quality, edges, verified edges and rate, warnings and stage times."""
    def counted(df, name, cond=None):
        c = F.count(F.lit(1)) if cond is None else F.count_if(cond)
        return df.groupBy("mission_id").agg(c.alias(name))

    out = counted(captures, "total_images")
    for part in (
        quality_counts(quality, ["mission_id"]), counted(edges, "candidate_edges"),
        counted(geometry, "tested_pairs"), counted(geometry, "verified_edges", F.col("accepted")),
        # at most one line per kind of finding
        issues.groupBy("mission_id").agg(F.array_join(F.array_sort(F.collect_set("issue")), "; ").alias("warnings")),
    ):
        out = out.join(part, "mission_id", "left")
    counts = ["good", "marginal", "rejected", "candidate_edges", "tested_pairs", "verified_edges"]
    out = out.fillna(0, counts).fillna("", ["warnings"])
    out = out.withColumn(
        "verified_rate", F.coalesce(F.col("verified_edges") / F.nullif(F.col("tested_pairs"), F.lit(0)), F.lit(0.0))
    )
    if timings is not None:  # one row per stage
        spent = timings.groupBy("mission_id").agg(F.map_from_entries(F.collect_list(F.struct("stage", "seconds"))).alias("timings"))
        out = out.join(spent, "mission_id", "left")
    return out


def worker_health(timeline: DataFrame) -> DataFrame:
    """Counters per worker from the worker timeline (see windows.worker_timeline, or windows.worker_states for all states)."""
    failed = F.coalesce(~F.col("ok"), F.lit(False))
    stated = "status" in timeline.columns
    at = F.struct("t", "seq", "silent") if stated else F.struct("t", "seq")
    status = F.col("status") if stated else F.when(F.col("ok"), "HEALTHY").otherwise("FAILED")
    return timeline.groupBy("mission_id", "worker").agg(
        F.count_if("ok").alias("iterations"), F.count_if(failed).alias("errors"),
        F.coalesce(F.max_by(F.when(failed, F.col("error")), F.when(failed, at)), F.lit("")).alias("last_error"),
        F.max_by("error_streak", at).alias("consecutive_errors"), F.count_if("recovered").alias("recoveries"),
        F.max_by(status, at).alias("last_status"),
        F.max(F.when(F.col("ok"), F.col("t"))).alias("last_update"),
    )


def _rank(status: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), status).cast("int")


def verification(
    health: DataFrame, enabled: DataFrame, extra: DataFrame | None = None, missions: DataFrame | None = None,
    categories=CATEGORIES,
) -> DataFrame:
    """Verdict per mission and category with its first six reasons.

    ``health``: mission_id, worker, status, reason. ``enabled``: worker, enabled (a handful of rows).
    ``extra``: mission_id, category, reason, optionally status; findings beside the workers' own.
    """
    listed = F.array(
        *[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("category"), F.lit(w).alias("worker")) for i, (c, w) in enumerate(categories)]
    )
    everyone = (missions if missions is not None else health).select("mission_id").distinct()
    expected = everyone.select("mission_id", F.explode(listed).alias("_c")).select("mission_id", "_c.*").join(enabled, "worker", "left")
    seen = expected.join(health.select("mission_id", "worker", "status", "reason"), ["mission_id", "worker"], "left")
    on, status = F.coalesce(F.col("enabled"), F.lit(True)), F.col("status")
    verdict = (
        F.when(~on, "SKIP").when(status.isNull(), "WARN").when(status == "DISABLED", "SKIP")
        .when(status.isin("ERROR", "STALE", "FAILED"), "FAIL").when(status.isin("DEGRADED", "INITIALIZING"), "WARN")
        .otherwise("PASS")
    )
    why = F.coalesce(F.nullif(F.col("reason"), F.lit("")), status)
    text = (
        F.when(~on, F.concat("worker", F.lit(" skipped by active test profile.")))
        .when(status.isNull(), F.concat("worker", F.lit(" has not reported yet.")))
        .when(status == "DISABLED", F.concat("worker", F.lit(" skipped: "), why))
        .otherwise(F.concat("worker", F.lit(": "), why))
    )
    rows = seen.select("mission_id", "category", "ord", verdict.alias("verdict"), text.alias("reason"))
    if extra is not None:
        level = F.col("status") if "status" in extra.columns else F.lit("WARN")
        rows = rows.unionByName(extra.select("mission_id", "category", F.lit(1000).alias("ord"), level.alias("verdict"), "reason"))
    worst = rows.groupBy("mission_id", "category").agg(F.max(_rank(F.col("verdict"))).alias("_w"))
    first = Window.partitionBy("mission_id", "category").orderBy("ord", "reason")
    spoken = rows.filter("verdict <> 'PASS'").withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= 6)
    reasons = spoken.groupBy("mission_id", "category").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "reason"))), lambda x: x["reason"]), " | ").alias("reasons")
    )
    named = F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), F.col("_w"))
    return worst.join(reasons, ["mission_id", "category"], "left").select(
        "mission_id", "category", named.alias("status"),
        F.when(named == "PASS", "Nominal.").otherwise(F.coalesce("reasons", F.lit(""))).alias("reasons"),
    )


def overall(verdicts: DataFrame) -> DataFrame:
    top = F.max(_rank(F.col("status")))
    return verdicts.groupBy("mission_id").agg(F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), top).alias("overall"))


def blocked_transitions(events: DataFrame) -> DataFrame:
    """Findings for the StateFlow category; both names of the event count."""
    blocked = events.filter(F.col("event_type").isin("STATE_CHANGE_BLOCKED", "STATE_TRANSITION_BLOCKED"))
    n = blocked.groupBy("mission_id").agg(F.count(F.lit(1)).alias("_n"))
    return n.select(
        "mission_id", F.lit("StateFlow").alias("category"),
        F.concat(F.col("_n").cast("string"), F.lit(" blocked state transition(s).")).alias("reason"),
    )


def reprojection_stats(points: DataFrame, by: list[str]) -> DataFrame:
    """Mean and median error. The mean is an exact sum divided once, so no order of rows changes its last digits; a group
    with an error that is no finite number has the plain average."""
    from flightloom.operators.quantiles import exact_quantiles

    exact = F.col("error_px").try_cast("decimal(38,15)")
    whole = F.count("error_px") == F.count(exact)
    mean = points.groupBy(*by).agg(F.when(whole, F.sum(exact).cast("double") / F.count(exact)).otherwise(F.avg("error_px")).alias("mean_px"))
    return mean.join(exact_quantiles(points, by, "error_px", {"median_px": 0.5}), by)


def feature_stats(df: DataFrame, by: list[str]) -> DataFrame:
    """Needs features and cached per image."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("images"), F.avg("features").alias("mean_features"),
        F.count_if("cached").alias("cache_hits"), F.count_if(~F.col("cached")).alias("cache_misses"),
    )


def calibrate(samples: DataFrame, ground_altitude_m: float = 0.0) -> DataFrame:
    """Gyro bias, level acceleration, magnetometer offset and sea-level pressure per device."""
    means = [F.avg(x).alias(f"mean_{x}") for x in ("gx", "gy", "gz", "ax", "ay", "az")]
    offsets = [((F.min(x) + F.max(x)) * 0.5).alias(f"offset_{x}") for x in ("mx", "my", "mz")]
    more = []
    if "pressure_hpa" in samples.columns:
        more = [F.avg("pressure_hpa").alias("pressure_mean_hpa"), F.avg("temperature_c").alias("temperature_mean_c")]
    if "calibration_status" in samples.columns:
        more.append(F.max_by("calibration_status", F.struct("ts_ns", "seq")).alias("last_status"))
    out = samples.groupBy("mission_id").agg(F.count(F.lit(1)).alias("samples"), *means, *offsets, *more)
    if "pressure_hpa" in samples.columns:
        out = out.withColumn(
            "sea_level_pressure_hpa",
            pressure.sea_level_pressure(F.col("pressure_mean_hpa"), F.lit(float(ground_altitude_m))),
        )
    return out


def apply_calibration(imu: DataFrame, calibration: DataFrame) -> DataFrame:
    """Subtract the device's gyro bias (array bias) and magnetometer offset (array offset).

    One calibration row per device; Spark broadcasts it when its measured size allows.
    """
    joined = imu.join(calibration.select("mission_id", "bias", "offset"), "mission_id", "left")
    zero = F.array(*[F.lit(0.0)] * 3)
    gyro = F.zip_with("gyro", F.coalesce("bias", zero), lambda a, b: a - b)
    mag = F.zip_with("mag", F.coalesce("offset", zero), lambda a, b: a - b)
    fixed = joined.withColumn("gyro", gyro).withColumn("mag", mag).drop("bias", "offset")
    return fixed.withColumn("gyro_dps", F.transform("gyro", lambda v: F.degrees(v)))


def nav_error_stats(df: DataFrame) -> DataFrame:
    known = F.col("error_m") >= 0
    return df.groupBy("mission_id").agg(
        F.coalesce(F.avg(F.when(known, F.col("error_m"))), F.lit(0.0)).alias("mean_error_m"),
        F.coalesce(F.max(F.when(known, F.col("error_m"))), F.lit(0.0)).alias("max_error_m"),
        F.count_if(known).alias("samples"),
    )


def latency_profile(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Mean, 95th and 99th percentile by sorted index, and maximum."""
    from flightloom.operators.quantiles import values_at

    fine = df.filter(F.col(column).isNotNull())
    plain = fine.groupBy(*by).agg(F.avg(column).alias("mean"), F.max(column).alias("max"))
    return plain.join(values_at(fine, by, column, {"p95": 0.95, "p99": 0.99}), by)


def emi_stats(samples: DataFrame, last_n: int, limit: float, width: float = 3600.0) -> DataFrame:
    """Field norm with motors on against the mean with motors off, over the last n rows of each sample.

    Needs norm and motor_on.
    """
    from flightloom.operators.timeline import Whole

    keyed = scan(
        samples, ["mission_id"], ["t", "seq"],
        [RowNumber("_n"), Whole("_s", F.when(~F.col("motor_on"), F.col("norm"))), Whole("_k", F.when(~F.col("motor_on"), 1))],
        width,
    ).withColumn("baseline", F.col("_s") / F.nullif(F.col("_k"), F.lit(0)))
    on = keyed.filter("motor_on")
    on = scan(on, ["mission_id"], ["t", "seq"], [RowNumber("_on")], width)
    spread, here, own = with_preceding_rows(on, ["mission_id"], "_on", last_n - 1)
    frame = here.rowsBetween(-(last_n - 1), 0)
    out = spread.select(
        "*", F.min("norm").over(frame).alias("low"), F.max("norm").over(frame).alias("high"),
        F.stddev_pop("norm").over(frame).alias("sigma"),
    ).filter(own)
    delta = F.abs(F.col("norm") - F.col("baseline"))
    return out.select("mission_id", "seq", "t", "norm", "baseline", "low", "high", "sigma", delta.alias("delta"), (delta > limit).alias("spike"))


def ability_verdicts(edges: DataFrame, geometry: DataFrame) -> DataFrame:
    """What a dataset proved: overlap found, matching beyond neighbours, verified pairs, weak pairs refused.

    Geometry needs number_gap and accepted.
    """
    e = edges.groupBy("mission_id").agg(F.count(F.lit(1)).alias("_edges"))
    g = geometry.groupBy("mission_id").agg(
        F.bool_or((F.col("number_gap") > 1) & F.col("accepted")).alias("_far"), F.bool_or("accepted").alias("_any"),
        F.bool_or(~F.col("accepted")).alias("_refused"),
    )
    both = e.join(g, "mission_id", "full_outer")

    def verdict(cond, otherwise):
        return F.when(F.coalesce(cond, F.lit(False)), "PASS").otherwise(otherwise)

    return both.select(
        "mission_id", verdict(F.col("_edges") > 0, "FAIL").alias("overlap_discovery"),
        verdict(F.col("_far"), "PARTIAL").alias("non_sequential_matching"),
        verdict(F.col("_any"), "FAIL").alias("scale_perspective_tolerance"),
        verdict(F.col("_refused"), "PARTIAL").alias("rejection_of_weak_pairs"),
    )


def stage_status(df: DataFrame, needed_share: float = 0.8) -> DataFrame:
    """Dense stage SUCCESS, FAILED or SKIPPED, the last when too few images were registered."""
    share = F.col("registered") / F.greatest(F.lit(1), F.col("usable"))
    return df.withColumn("registration_rate", share).withColumn(
        "dense_status",
        F.when(share < needed_share, "SKIPPED").when(F.col("dense_ok"), "SUCCESS").otherwise("FAILED"),
    )


def dataset_availability(attrs: DataFrame) -> DataFrame:
    return attrs.groupBy("mission_id").agg(
        F.bool_or(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).alias("gps_available"),
        F.bool_or(F.col("altitude").isNotNull()).alias("altitude_available"),
        F.bool_or(F.col("taken_at").isNotNull()).alias("time_available"),
    )


def event_rollup(events: DataFrame) -> DataFrame:
    """Counts and first and last time by source, type and severity, with subtotals (nulls in the keys)."""
    return events.rollup("mission_id", "source", "event_code", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"),
        F.grouping_id().cast("bigint").alias("level"),
    )


def verdict_tally(results: DataFrame, by: list[str]) -> DataFrame:
    return results.groupBy(*by).agg(
        *[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in ("PASS", "FAIL", "SKIP")]
    )


def mean_rate(samples: DataFrame, by: list[str]) -> DataFrame:
    return samples.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / F.greatest(F.lit(1e-6), F.max("t") - F.min("t"))).alias("rate_hz")
    )


def window_peaks(samples: DataFrame, seconds: float = 0.5) -> DataFrame:
    """Largest absolute rate and net steps per fixed window of mission time."""
    bucket = F.floor(F.col("t") / seconds).cast("bigint")
    return samples.groupBy("mission_id", bucket.alias("window_no")).agg(
        F.max(F.abs("rate")).alias("peak"), F.sum("steps").alias("net_steps")
    )


def capture_stats(captures: DataFrame) -> DataFrame:
    """Needs outcome: ok, failed or dropped. Dropped frames count in the sequence, failures beside it."""
    got = {k: F.count_if(F.col("outcome") == k) for k in ("ok", "failed", "dropped")}
    return captures.groupBy("mission_id").agg(
        got["ok"].alias("successful"), got["failed"].alias("failed"), got["dropped"].alias("dropped"),
        (got["ok"] + got["dropped"]).alias("sequence"), (got["ok"] + got["dropped"] + got["failed"]).alias("total"),
    )


def compare_reports(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Both values and their difference per mission."""
    b = before.select("mission_id", *[F.col(x).alias(f"{x}_before") for x in columns])
    a = after.select("mission_id", *[F.col(x).alias(f"{x}_after") for x in columns])
    return b.join(a, "mission_id", "full_outer").select(
        "*", *[(F.col(f"{x}_after") - F.col(f"{x}_before")).alias(f"{x}_change") for x in columns]
    )


def fix_summary(nmea: DataFrame) -> DataFrame:
    """Sentences, whether any had a fix, and the last fix. Needs seq and the columns of parse_nmea."""
    last = F.max_by(F.struct("lat", "lon", "satellites"), F.when(F.col("fixed"), F.col("seq")))
    return nmea.groupBy("mission_id").agg(
        F.count("type").alias("sentences"), F.coalesce(F.bool_or("fixed"), F.lit(False)).alias("any_fix"), last.alias("_l")
    ).select("mission_id", "sentences", "any_fix", F.col("_l.lat").alias("last_lat"), F.col("_l.lon").alias("last_lon"))


def reconcile_images(telemetry: DataFrame, files: DataFrame, examples: int = 5) -> DataFrame:
    """Referenced, present, missing and orphan images per mission, and the first names of the last two."""
    from flightloom.functions.values import basename

    named = image_rows(telemetry).select("mission_id", basename(F.trim("image_name")).alias("image_name")).distinct()
    refs = named.withColumn("_r", F.lit(True))
    have = files.select("mission_id", "image_name").distinct().withColumn("_f", F.lit(True))
    both = refs.join(have, ["mission_id", "image_name"], "full_outer")
    r, f = F.col("_r").isNotNull(), F.col("_f").isNotNull()
    counts = both.groupBy("mission_id").agg(
        F.count_if(r).alias("referenced"), F.count_if(r & f).alias("_both"), F.count_if(f).alias("_files"),
        F.count_if(r & ~f).alias("missing"), F.count_if(~r & f).alias("_extra"),
    )
    any_ref = F.col("referenced") > 0
    out = counts.select(
        "mission_id", "referenced", F.when(any_ref, F.col("_both")).otherwise(F.col("_files")).alias("present"),
        "missing", F.when(any_ref, F.col("_extra")).otherwise(0).alias("orphan"),
    )

    def firsts(cond, name):
        ranked = Window.partitionBy("mission_id").orderBy("image_name")
        few = both.filter(cond).withColumn("_k", F.row_number().over(ranked)).filter(F.col("_k") <= examples)
        return few.groupBy("mission_id").agg(F.array_join(F.array_sort(F.collect_list("image_name")), ",").alias(name))

    return (
        out.join(firsts(r & ~f, "missing_examples"), "mission_id", "left")
        .join(firsts(~r & f, "orphan_examples"), "mission_id", "left")
        .withColumn("orphan_examples", F.when(F.col("orphan") > 0, F.col("orphan_examples")))
        .fillna("", ["missing_examples", "orphan_examples"])
    )


def illegal_transitions(history: DataFrame) -> DataFrame:
    """Observed changes of state that the fixed table does not allow."""
    legal = history.sparkSession.createDataFrame(list(P.LEGAL_TRANSITIONS), "from_state string, to_state string")
    moved = history.filter(F.col("from_state").isNotNull() & (F.col("from_state") != F.col("to_state")))
    return moved.join(F.broadcast(legal), ["from_state", "to_state"], "left_anti")


def missing_images(telemetry: DataFrame, files: DataFrame) -> DataFrame:
    return image_rows(telemetry).select("mission_id", "image_name").subtract(files.select("mission_id", "image_name"))


def _referencing(telemetry: DataFrame) -> DataFrame:
    return image_rows(telemetry).select("mission_id").distinct()


def orphan_images(telemetry: DataFrame, files: DataFrame) -> DataFrame:
    extra = files.select("mission_id", "image_name").subtract(image_rows(telemetry).select("mission_id", "image_name"))
    return extra.join(_referencing(telemetry), "mission_id", "left_semi")


def present_images(telemetry: DataFrame, files: DataFrame) -> DataFrame:
    have = files.select("mission_id", "image_name").distinct()
    both = have.intersect(image_rows(telemetry).select("mission_id", "image_name"))
    return both.unionByName(have.join(_referencing(telemetry), "mission_id", "left_anti"))


def rate_windows(samples: DataFrame, seconds: float, expected_hz: float, by: list[str], slide: float | None = None) -> DataFrame:
    """Samples per window of event time against the expected rate. Needs a timestamp column ts."""
    width = f"{int(seconds * 1000)} milliseconds"
    span = F.window("ts", width, f"{int(slide * 1000)} milliseconds") if slide else F.window("ts", width)
    out = samples.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(*by, span.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(
        *by, F.col("w.start").alias("window_start"), "n", (F.col("n") / F.lit(seconds)).alias("actual_hz"),
        (F.col("n") < F.lit(expected_hz * seconds)).alias("below_expected"),
    )


def stage_summary(synced: DataFrame, files: DataFrame, quality: DataFrame, edges: DataFrame, issues: DataFrame) -> DataFrame:
    """Images, usable ones, edges and findings per mission; an image without a file counts in no verdict."""
    here = synced.join(files.select("mission_id", "image_name").distinct(), ["mission_id", "image_name"], "left_semi")
    judged = here.join(quality, ["mission_id", "image_name"])
    parts = {
        "usable": judged.filter(F.col("usable")), "edges": edges, "issues": issues,
    }
    out = synced.groupBy("mission_id").agg(F.count(F.lit(1)).alias("images"))
    for name, part in parts.items():
        out = out.join(part.groupBy("mission_id").agg(F.count(F.lit(1)).alias(name)), "mission_id", "left")
    return out.fillna(0)
