"""Row filters and derived columns that come before everything else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightloom import params as P
from flightloom.functions import attitude, geo
from flightloom.functions.values import num


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Refuse input without the named columns; the error lists the missing ones in order."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    return df


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("no rows to work on")
    return df


def image_rows(df: DataFrame) -> DataFrame:
    require_columns(df, ["image_name"])
    return df.filter(F.col("image_name").isNotNull() & (F.col("image_name") != ""))


def geotagged(df: DataFrame) -> DataFrame:
    require_columns(df, ["latitude", "longitude"])
    here = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return image_rows(df).filter(here & (F.col("latitude") != 0) & (F.col("longitude") != 0))


def altitude_pos(baro: Column, gps: Column) -> Column:
    """Barometer when above zero, else GPS."""
    return F.when(num(baro) > 0, num(baro)).otherwise(num(gps))


def altitude_floor(baro: Column, gps: Column, floor: float = P.MIN_FOOTPRINT_ALT_M) -> Column:
    """Barometer unless exactly zero, else GPS; never under the floor."""
    return F.greatest(F.when(num(baro) != 0, num(baro)).otherwise(num(gps)), F.lit(floor))


def best_attitude(df: DataFrame, on: str = "healthy") -> DataFrame:
    """Fused angles when the estimator is healthy (or valid), raw angles otherwise."""
    use = F.coalesce(F.col(f"ahrs_{on}"), F.lit(False))
    for name in ("roll", "pitch", "yaw"):
        df = df.withColumn(f"best_{name}", F.when(use, F.col(f"ahrs_{name}")).otherwise(F.col(name)))
    return df


def in_capture_state(df: DataFrame, column: str = "state") -> DataFrame:
    return df.filter(F.col(column).isin(*P.CAPTURE_PHASES))


def accel_ok(ax: Column, ay: Column, az: Column, low: float = 0.70, high: float = 1.30) -> Column:
    fine = geo.is_finite(ax) & geo.is_finite(ay) & geo.is_finite(az)
    return F.coalesce(fine & (attitude.vector_norm(ax, ay, az) / P.STANDARD_GRAVITY).between(low, high), F.lit(False))


def mag_ok(mx: Column, my: Column, mz: Column, low: float = 15.0, high: float = 85.0) -> Column:
    fine = geo.is_finite(mx) & geo.is_finite(my) & geo.is_finite(mz)
    return F.coalesce(fine & attitude.vector_norm(mx, my, mz).between(low, high), F.lit(False))


def _messages(*pairs: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, text) for cond, text in pairs]))


def mission_issues(captures: DataFrame, files: DataFrame | None = None, missions: DataFrame | None = None) -> DataFrame:
    """One row per mission and finding, with its count.

    ``missions`` lists every mission that ought to be there, so that one without images is found.
    """
    base = image_rows(captures)
    if files is not None:
        seen = files.select("mission_id", "image_name", F.lit(True).alias("_stored")).distinct()
        base = base.join(seen, ["mission_id", "image_name"], "left")
    else:
        base = base.withColumn("_stored", F.lit(True))
    no_gps = (num(F.col("latitude")) == 0) | (num(F.col("longitude")) == 0)
    flat = (num(F.col("roll")) == 0) & (num(F.col("pitch")) == 0) & (num(F.col("yaw")) == 0)
    counts = base.groupBy("mission_id").agg(
        F.count(F.lit(1)).alias("images"),
        F.count_if(F.col("_stored").isNull()).alias("lost"),
        F.count_if(no_gps).alias("no_gps"),
        F.count_if(flat).alias("flat"),
    )
    if missions is not None:
        counts = missions.select("mission_id").distinct().join(counts, "mission_id", "left").fillna(0)
    lines = _messages(
        (F.col("images") == 0, F.lit("No image metadata records found.")),
        (F.col("lost") > 0, F.concat(F.lit("Missing image files: "), F.col("lost").cast("string"))),
        (F.col("no_gps") > 0, F.concat(F.lit("Images without GPS fix: "), F.col("no_gps").cast("string"))),
        (F.col("flat") > 0, F.concat(F.lit("Images without nonzero attitude: "), F.col("flat").cast("string"))),
    )
    return counts.select("mission_id", F.explode(lines).alias("issue"))


def gps_prior_summary(captures: DataFrame) -> DataFrame:
    counts = captures.groupBy("mission_id").agg(
        F.count_if((F.col("latitude") != 0) & (F.col("longitude") != 0)).alias("gps_priors")
    )
    text = F.concat(
        F.col("gps_priors").cast("string"),
        F.lit(" GPS camera priors available. Full SfM-to-GPS alignment requires a successful sparse reconstruction."),
    )
    none = F.lit("No GPS priors available.")
    return counts.withColumn("message", F.when(F.col("gps_priors") == 0, none).otherwise(text))


def calibration_gate(df: DataFrame, max_gyro_dps: float = 3.0, low: float = 8.0, high: float = 11.5) -> DataFrame:
    """Adds whether the device lay still and level enough to be calibrated."""
    gyro = F.greatest(F.abs("gyro_x_dps"), F.abs("gyro_y_dps"), F.abs("gyro_z_dps"))
    norm = attitude.vector_norm(F.col("accel_x"), F.col("accel_y"), F.col("accel_z"))
    return df.withColumn("stationary", gyro <= max_gyro_dps).withColumn("accel_plausible", norm.between(low, high))


def detector_conditions(df: DataFrame) -> DataFrame:
    """The inputs and outcome of the launch, apogee, deployment and landing tests on every row.

    Needs baro_altitude, vertical_velocity, max_altitude and the three raw accelerations.
    """
    g = attitude.accel_g(F.col("raw_accel_x"), F.col("raw_accel_y"), F.col("raw_accel_z"))
    alt, speed, top = F.col("baro_altitude"), F.col("vertical_velocity"), F.col("max_altitude")
    return df.select(
        "*",
        g.alias("accel_g"),
        ((g > P.LAUNCH_ACCEL_G) | (alt > P.LAUNCH_ALTITUDE_M)).alias("launch_condition"),
        ((speed < P.APOGEE_VELOCITY_MPS) & (alt < top - P.APOGEE_DROP_M) & (alt > P.APOGEE_MIN_ALTITUDE_M)).alias(
            "apogee_condition"
        ),
        ((alt <= P.DEPLOY_ALTITUDE_M) & (speed < 0)).alias("deploy_condition"),
        ((alt < P.LANDING_ALTITUDE_M) & (F.abs(speed) < P.LANDING_VELOCITY_MPS) & g.between(0.8, 1.2)).alias(
            "landing_condition"
        ),
    )


_WARNINGS = (
    # event, source, columns it needs, test
    ("POWER_UNDERVOLTAGE", "Power", ("bus_voltage_v",), lambda c: c("bus_voltage_v") < P.UNDERVOLTAGE_V),
    ("POWER_OVERCURRENT", "Power", ("current_a",), lambda c: c("current_a") > P.OVERCURRENT_A),
    ("SYSTEM_TEMP_HIGH", "System", ("cpu_temp_c",), lambda c: c("cpu_temp_c") >= P.CPU_HOT_C),
    ("DISK_SPACE_LOW", "System", ("disk_free_bytes",), lambda c: c("disk_free_bytes") < P.DISK_LOW_BYTES),
    ("GPS_HDOP_DEGRADED", "GPS", ("hdop",), lambda c: c("hdop") > P.HDOP_WARN),
    ("GPS_FIX_LOST", "GPS", ("fix_type",), lambda c: c("fix_type") == "NO FIX"),
    ("IMAGE_SYNC_WARNING", "Camera", ("sync_delta_ms",), lambda c: c("sync_delta_ms") > P.SYNC_WARN_MS),
    ("GIMBAL_SATURATION", "Gimbal", ("gimbal_saturated",), lambda c: c("gimbal_saturated")),
)


def threshold_events(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per exceeded limit; limits whose columns are absent are left out."""
    cases = [
        F.when(test(F.col), F.struct(F.lit(event).alias("event_type"), F.lit(source).alias("source")))
        for event, source, needed, test in _WARNINGS
        if set(needed) <= set(df.columns)
    ]
    return df.select(*keep, F.explode(F.array_compact(F.array(*cases))).alias("_e")).select(*keep, "_e.*")


def degraded_subsystems(df: DataFrame, names: list[str]) -> DataFrame:
    """Names whose ``<name>_enabled`` is set and ``<name>_ok`` is not, and whether there are none."""
    bad = F.array_compact(
        F.array(*[F.when(F.col(f"{n}_enabled") & ~F.coalesce(F.col(f"{n}_ok"), F.lit(False)), F.lit(n)) for n in names])
    )
    return df.withColumn("degraded", F.concat_ws(", ", bad)).withColumn("healthy", F.size(bad) == 0)


def live_image_verdict(df: DataFrame) -> DataFrame:
    """Status of the latest image and why. Needs sharpness, brightness, dark_share and bright_share."""
    c = F.col
    reasons = _messages(
        (c("sharpness") < P.LIVE_BLUR_VARIANCE, F.format_string("sharpness %.1f below threshold", "sharpness")),
        (
            (c("brightness") < P.LIVE_BRIGHT_LOW) | (c("brightness") > P.LIVE_BRIGHT_HIGH),
            F.format_string("brightness %.1f outside threshold", "brightness"),
        ),
        (c("dark_share") > P.LIVE_CLIPPED_SHARE, F.format_string("underexposed %.1f%%", c("dark_share") * 100.0)),
        (c("bright_share") > P.LIVE_CLIPPED_SHARE, F.format_string("overexposed %.1f%%", c("bright_share") * 100.0)),
    )
    fine = F.size(reasons) == 0
    return df.withColumn("image_status", F.when(fine, "HEALTHY").otherwise("DEGRADED")).withColumn(
        "image_reason", F.when(fine, "Latest image quality acceptable.").otherwise(F.array_join(reasons, "; "))
    )


def guidance_features(df: DataFrame, glide_ratio: float = 2.5) -> DataFrame:
    """Sixteen descent-guidance inputs as an array column.

    Angles in radians, positions in a metric local frame (east, north); courses are converted
    from degrees before use.
    """
    c = F.col
    to_target = geo.bearing_and_distance(c("east"), c("north"), c("target_east"), c("target_north"))
    course = F.radians(c("course_deg"))
    vn, ve = c("ground_speed_mps") * F.cos(course), c("ground_speed_mps") * F.sin(course)
    half_turn = F.lit(3.141592653589793)

    def wrapped(angle):
        return F.pmod(angle + half_turn, half_turn * 2.0) - half_turn

    heading_error = wrapped(to_target["bearing"] - course)
    track_error = wrapped(to_target["bearing"] - F.atan2(ve, vn))
    drift = ve * F.cos(to_target["bearing"]) - vn * F.sin(to_target["bearing"])
    sink = F.greatest(F.hypot(vn - c("wind_north"), ve - c("wind_east")) / glide_ratio, F.lit(0.1))
    wind_angle = F.atan2(c("wind_east"), c("wind_north"))
    excess = c("altitude_m") - to_target["distance"] / glide_ratio
    features = F.array(
        F.sin(heading_error), F.cos(heading_error), to_target["distance"] / 1000.0, excess / 1000.0,
        F.hypot(c("wind_north"), c("wind_east")) / 10.0, F.sin(wind_angle), F.cos(wind_angle),
        c("pitch_rad") / 0.5, c("roll_rad") / 0.5, c("yaw_rate") / 0.5,
        c("previous_steer") / 30.0, c("previous_brake") / 30.0,
        F.sin(track_error), F.cos(track_error), drift / 8.0, F.least(c("altitude_m") / sink / 200.0, F.lit(2.0)),
    )
    return df.withColumn("features", features)


def altitude_budget(df: DataFrame, glide_ratio: float = 2.5, excess_limit: float = 15.0) -> DataFrame:
    above = F.col("altitude_m") - F.col("target_altitude_m")
    needed = F.col("distance_m") / glide_ratio
    return df.select(
        "*",
        needed.alias("altitude_needed_m"),
        (above - needed).alias("altitude_excess_m"),
        ((above > 0) & (F.lit(glide_ratio) > 0.1) & (above - needed > excess_limit)).alias("too_high"),
    )


def rescale_command(df: DataFrame) -> DataFrame:
    """Controller outputs in -1..1 to steering -30..30 and brake 0..30, with a range check."""
    steer, brake = F.col("raw_steer") * 30.0, (F.col("raw_brake") + 1.0) / 2.0 * 30.0
    finite = geo.is_finite(F.col("raw_steer")) & geo.is_finite(F.col("raw_brake"))
    return df.select(
        "*",
        F.when(finite, steer).alias("steer"),
        F.when(finite, brake).alias("brake"),
        F.coalesce(finite & steer.between(-30.0, 30.0) & brake.between(0.0, 30.0), F.lit(False)).alias("in_range"),
    )
