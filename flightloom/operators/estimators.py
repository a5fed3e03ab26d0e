"""Stateful operators on DataFrames: debouncing, fix checks, phases, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightloom import params as P
from flightloom.functions import attitude, geo
from flightloom.operators import compose, steps
from flightloom.operators.fold import ordered_fold
from flightloom.operators.ladder import NEXT_T, POSITION, Rung, assign, begin, climb, flag, since, streak
from flightloom.operators.pointers import reached
from flightloom.operators.timeline import (
    Following, LastWhere, NextWhere, Previous, RowNumber, RunningMax, Streak, join_on, scan, with_preceding_rows,
)
from flightloom.operators.windows import BY, ORDER, SLICE_S, vertical_rate
from flightloom.session import cut_lineage

NS = 1e9
PHASE_PARAMS = dict(
    launch_g=P.LAUNCH_ACCEL_G, launch_m=P.LAUNCH_ALTITUDE_M, burnout_g=P.BURNOUT_ACCEL_G, boost_s=P.BOOST_MAX_S,
    apogee_mps=P.APOGEE_VELOCITY_MPS, apogee_drop_m=P.APOGEE_DROP_M, apogee_min_m=P.APOGEE_MIN_ALTITUDE_M,
    apogee_backup_s=P.APOGEE_BACKUP_S, deploy_m=P.DEPLOY_ALTITUDE_M, settle_s=P.SETTLE_S,
    landing_m=P.LANDING_ALTITUDE_M, landing_mps=P.LANDING_VELOCITY_MPS, landing_s=P.LANDING_S,
    max_flight_s=P.MAX_FLIGHT_S,
)


def debounce(events: DataFrame, gap_s: float = P.DEBOUNCE_S, width: float = SLICE_S) -> DataFrame:
    """Drop repeats of a (source, code, message) until ``gap_s`` after the last one kept.

    An event at least ``gap_s`` after its predecessor is kept whatever came before it. Any other event is kept if it is
    reached from such a one along pointers, each to the first event at least ``gap_s`` later: one time join finds the
    pointers, doubling follows them. Rows without a time are kept; of several at one time the first. A gap that is not
    positive keeps all rows.
    """
    if gap_s <= 0:
        return events
    by = ["mission_id", "source", "event_code", "message"]
    c = F.col
    timed = events.filter(c("t").isNotNull())
    before = scan(timed, by, ORDER, [Previous("_before", c("t"))], width)
    # of equal times only the first can be kept
    first = before.filter(c("_before").isNull() | (c("_before") < c("t")))
    rows = cut_lineage(first.withColumn("_head", F.coalesce(c("t") - c("_before") >= gap_s, F.lit(True))).withColumn("id", F.monotonically_increasing_id()))
    heads = rows.filter("_head")
    # events of a stretch without a head's gap meet their pointers inside it; a head is kept anyway
    later = [c("id").alias("id"), c("t").alias("t"), c("_head").alias("head")]
    marks = rows.select(*by, c("id").alias("_from"), (c("t") + gap_s - F.abs(c("t") + gap_s) * 2.0**-50).alias("t"), c("t").alias("_own"), F.lit(0).alias("_side"))
    stops = rows.select(*by, "t", "id", "_head", F.lit(1).alias("_side"))
    both = marks.unionByName(stops, allowMissingColumns=True)
    # the first events from just before the mark on: rounding may put the wanted one a step behind the first
    chain = [NextWhere("_next0", F.struct(*later), c("_side") == 1)]
    ahead = scan(both, by, ["t", "_side", "id"], chain, width).filter(c("_side") == 0)
    fits = c("_next0.t") - c("_own") >= gap_s
    sure = ahead.filter(c("_next0").isNotNull() & fits & ~c("_next0.head")).select(c("_from").alias("id"), c("_next0.id").alias("to"))
    # rare: events within rounding of the gap; the next one is asked until one fits
    near = ahead.filter(c("_next0").isNotNull() & ~fits).select(c("_from").alias("id"), "_own", c("_next0.id").alias("at"))
    follow = scan(rows, by, ORDER, [Following("_after", F.struct(*later))], width).select(c("id").alias("at"), "_after")
    near, follow = cut_lineage(near), None if near.isEmpty() else cut_lineage(follow)
    while follow is not None and not near.isEmpty():
        tried = cut_lineage(near.join(follow, "at").filter(c("_after").isNotNull()))
        fits = c("_after.t") - c("_own") >= gap_s
        sure = sure.unionByName(tried.filter(fits & ~c("_after.head")).select("id", c("_after.id").alias("to")))
        near = cut_lineage(tried.filter(~fits).select("id", "_own", c("_after.id").alias("at")))
    kept = reached(heads, cut_lineage(sure))
    out = rows.join(kept, "id", "left_semi").select(*events.columns)
    return out.unionByName(events.filter(c("t").isNull()))


def gps_stateless(age_ms: Column) -> Column:
    """First of the rules that need no history which a fix breaks, else null."""
    c = F.col
    sats, hdop, speed, course = c("satellites"), c("hdop"), c("ground_speed_mps"), c("course_deg")

    def broken(value):
        return value.isNotNull() & ~geo.is_finite(value)

    no_stamp = c("ts_ns").isNull() | (c("ts_ns") == 0)
    return (
        F.when(no_stamp, "GPS_NO_TIMESTAMP")
        .when(age_ms < -1.0, "GPS_TIMESTAMP_IN_FUTURE")
        .when(age_ms > P.MAX_GPS_AGE_MS, "GPS_STALE")
        .when(F.coalesce(c("fix_type"), F.lit("NO FIX")) == "NO FIX", "GPS_NO_FIX")
        .when(~geo.valid_lat_lon(c("latitude"), c("longitude")), "GPS_INVALID_LAT_LON")
        .when(~geo.is_finite(c("altitude_m")), "GPS_INVALID_ALTITUDE")
        .when(sats.isNotNull() & (sats < P.MIN_SATELLITES), "GPS_LOW_SATELLITES")
        .when(broken(hdop) | (hdop <= 0.0), "GPS_INVALID_HDOP")
        .when(hdop > P.MAX_HDOP, "GPS_BAD_HDOP")
        .when(broken(speed) | (speed < 0.0), "GPS_INVALID_SPEED")
        .when(speed > P.MAX_SPEED_MPS, "GPS_REPORTED_SPEED_IMPLAUSIBLE")
        .when(broken(course), "GPS_INVALID_COURSE")
    )


def validate_gps(fixes: DataFrame, as_of: Column | None = None, width: float = SLICE_S) -> DataFrame:
    """Reason code per fix; later rules compare with the last accepted fix. GPS_VALID means accepted."""
    now = as_of if as_of is not None else F.col("ts_ns")
    age = (now - F.col("ts_ns")) / F.lit(1e6)
    judged = fixes.withColumn("_verdict", gps_stateless(age))
    check = steps.GpsCheck(P.MAX_JUMP_M, P.MAX_SPEED_MPS)
    out = ordered_fold(
        judged, BY, ["seq"], ["_verdict", "ts_ns", "latitude", "longitude"], check, fixes.columns, width * NS,
        slice_on=F.col("ts_ns"),
    )
    return out.withColumn("valid", F.col("reason") == "GPS_VALID").withColumn("rejected", F.col("reason") != "GPS_VALID")


def gps_velocity(fixes: DataFrame, width: float = SLICE_S) -> DataFrame:
    """North and east speed: as reported, else from the last two fixes; course as heading only when moving."""
    c = F.col
    before = F.struct("ts_ns", "latitude", "longitude")
    prev = scan(fixes, BY, ["ts_ns", "seq"], [Previous("_p", before)], width * NS)
    given = geo.velocity_from_course(c("ground_speed_mps"), c("course_deg"))
    fine = geo.is_finite(c("ground_speed_mps")) & geo.is_finite(c("course_deg")) & (c("ground_speed_mps") >= 0)
    moved = geo.to_local_mean(c("latitude"), c("longitude"), c("_p.latitude"), c("_p.longitude"))
    dt = F.nullif((c("ts_ns") - c("_p.ts_ns")) / F.lit(NS), F.lit(0.0))
    usable = (c("ground_speed_mps") >= 2.0) & c("course_deg").isNotNull()
    return prev.select(
        *fixes.columns,
        F.when(fine, given["vn"]).otherwise(moved["north"] / dt).alias("vn"),
        F.when(fine, given["ve"]).otherwise(moved["east"] / dt).alias("ve"),
        F.when(usable, geo.wrap_360(c("course_deg"))).alias("gps_heading"),
    )


def phase_flags(p: dict, alt, speed, g) -> dict:
    """What the phases of a flight look for, on columns or on numbers."""
    level, slow = alt < p["landing_m"], (speed < p["landing_mps"]) & (speed > -p["landing_mps"])
    return {
        "launch": (g > p["launch_g"]) | (alt > p["launch_m"]), "burnt": g < p["burnout_g"], "deploy": (alt <= p["deploy_m"]) & (speed < 0.0),
        "low": level & slow & (g >= 0.8) & (g <= 1.2),
    }


def falling_flag(p: dict, alt, speed, top):
    """Past the highest altitude since launch."""
    return (speed < p["apogee_mps"]) & (alt < top - p["apogee_drop_m"]) & (alt > p["apogee_min_m"])


def flight_rungs(p: dict) -> list[Rung]:
    return [
        Rung("ARMED_PAD", "BOOST", "launch", 3, reason="launch_detected"),
        Rung("BOOST", "COAST", "burnt", 5, launch_s=p["boost_s"], reason="boost_burnout", unflagged_reason="boost_timeout"),
        Rung("COAST", "APOGEE", "falling", 5, launch_s=p["apogee_backup_s"], reason="apogee_detected", late_reason="apogee_backup_timeout"),
        Rung("APOGEE", "DESCENT_DROGUE", entry_s=p["settle_s"], reason="apogee_settle_elapsed"),
        Rung("DESCENT_DROGUE", "GLIDER_DEPLOY", "deploy", 5, reason="glider_deploy_altitude_reached"),
        Rung("GLIDER_DEPLOY", "GUIDED_DESCENT", entry_s=p["settle_s"], reason="glider_deploy_settle_elapsed"),
        Rung("GUIDED_DESCENT", "LANDED", "low", held_s=p["landing_s"], reason="landing_detector_persistent"),
    ]


ABORTED = ("ABORT", "abort_requested")


def flight_phases(telemetry: DataFrame, params: dict | None = None, width: float = SLICE_S) -> DataFrame:
    """Phase after every sample. Needs t, seq, baro_altitude and raw_accel_x, _y, _z. A missing value meets no condition;
    a missing altitude counts as 0. Runs its jobs at once."""
    c, p = F.col, {**PHASE_PARAMS, **(params or {})}
    rungs = flight_rungs(p)
    level = telemetry.withColumn("_alt", F.greatest(c("baro_altitude"), F.lit(0.0))).withColumn(
        "accel_g", attitude.accel_g(c("raw_accel_x"), c("raw_accel_y"), c("raw_accel_z"))
    )
    flags = phase_flags(p, c("_alt"), c("vertical_rate"), c("accel_g"))
    rated = vertical_rate(level, "_alt", width=width).withColumns({flag(n): F.coalesce(x, F.lit(False)) for n, x in flags.items()})
    streaks = [Streak(streak(n), cond=c(flag(n))) for n in ("launch", "burnt", "deploy", "low")]
    rows = cut_lineage(scan(rated, BY, ORDER, [RowNumber(POSITION), Following(NEXT_T, c("t")), *streaks], width))
    entries = climb(rows, BY, begin(rows, BY), rungs[:2], abort_s=p["max_flight_s"])
    # the highest altitude counts from launch on, so it waits for the first rung
    flying = join_on(rows, entries.select(*BY, "_n1"), BY, "left")
    top = RunningMax("_top", F.when(c(POSITION) >= c("_n1"), c("_alt")))
    held = LastWhere(since("low"), c("t"), c(flag("low")) & (c(streak("low")) == 1))
    topped = scan(flying, BY, ORDER, [top, held], width).drop("_n1")
    fell = topped.withColumn(flag("falling"), F.coalesce(falling_flag(p, c("_alt"), c("vertical_rate"), c("_top")), F.lit(False)))
    rows = cut_lineage(scan(fell, BY, ORDER, [Streak(streak("falling"), cond=c(flag("falling")))], width))
    entries = climb(rows, BY, entries, rungs[2:], first=2)
    out = assign(rows, BY, entries, rungs, ABORTED)
    return out.select(*telemetry.columns, "vertical_rate", "phase", "entered", "phase_reason")


def descent_phases(df: DataFrame, altitude: str, velocity: str, ground_m: float = 0.0, width: float = SLICE_S, window: int = 10, trigger_m: float = 600.0, locked: bool = False) -> DataFrame:
    """The second machine: the mean of a short window of altitudes decides. ``fired`` holds from the deployment on,
    unless it is locked. Runs its jobs at once."""
    c = F.col
    numbered = scan(df, BY, ORDER, [RowNumber(POSITION), Following(NEXT_T, c("t"))], width)
    spread, here, own = with_preceding_rows(numbered, BY, POSITION, window - 1)
    frame = here.rowsBetween(-(window - 1), 0)
    value, sinking = c(altitude), c(velocity) < -2.0
    full = F.count(F.lit(1)).over(frame) >= window
    marked = spread.select("*", (full & (value < F.first(value).over(frame) - 5.0) & sinking).alias("_falls"), (full & (F.avg(value).over(frame) - ground_m <= trigger_m) & sinking).alias("_near"))
    flags = {"falls": c("_falls"), "near": c("_near"), "any": F.lit(True), "ground": value - ground_m <= 5.0}
    rows = cut_lineage(marked.filter(own).withColumns({flag(n): F.coalesce(x, F.lit(False)) for n, x in flags.items()}).drop("_own", "_block", "_falls", "_near"))
    rungs = [
        Rung("BOOST", "DROGUE_DESCENT", "falls", 1), Rung("DROGUE_DESCENT", "DEPLOYMENT_TRIGGER", "near", 1),
        Rung("DEPLOYMENT_TRIGGER", "DEPLOYMENT_VERIFICATION", "any", 1), Rung("DEPLOYMENT_VERIFICATION", "GUIDED_DESCENT", "any", 1),
        Rung("GUIDED_DESCENT", "LANDED", "ground", 1),
    ]
    out = assign(rows, BY, climb(rows, BY, begin(rows, BY), rungs), rungs)
    fired = F.coalesce(c(POSITION) >= c("_n3"), F.lit(False)) & F.lit(not locked)
    return out.select(*df.columns, "phase", fired.alias("fired"))


def filter_altitude(
    df: DataFrame, dt: float, accel: str, baro: str, gps: str | None = None, width: float = SLICE_S, seed: tuple | None = None,
    reseed: tuple[str, str] | None = None, baro_var: float = 2.0, gps_var: float = 5.0, first_alt: float = 0.0,
) -> DataFrame:
    """Altitude and vertical speed from acceleration, corrected by barometer (and GPS where given).

    ``seed``: altitude and speed saved before a restart, known with variances 25 and 4, instead of ``first_alt`` and 0
    with variances of 10. ``reseed``: columns with an altitude and speed that the filter restarts from before a row
    where the altitude is given (a missing speed is 0). A missing acceleration counts as none, a missing measurement
    corrects nothing.
    """
    c = F.col
    numbered = scan(df, BY, ORDER, [RowNumber("_n")], width)
    row = compose.moved(dt, F.coalesce(c(accel), F.lit(0.0)), (0.01, 0.1), c(baro).cast("double"), baro_var)
    steps = numbered.select("*", *[row[p].cast("double").alias(p) for p in compose.GAUSSIAN])
    if gps:
        steps = compose.followed(steps, compose.seen(F.coalesce(c(gps).cast("double"), F.lit(0.0)), gps_var), c(gps).isNotNull())
        steps = cut_lineage(steps)  # else the planner nests one composition in the next
    if reseed:
        known = compose.reset(F.coalesce(c(reseed[0]), F.lit(0.0)), F.coalesce(c(reseed[1]), F.lit(0.0)), 25.0, 4.0)
        steps = compose.followed(steps, known, c(reseed[0]).isNotNull(), before=True)
        steps = cut_lineage(steps)
    start = compose.reset(F.lit(float(seed[0])), F.lit(float(seed[1])), 25.0, 4.0) if seed else compose.reset(F.lit(first_alt), F.lit(0.0), 10.0, 10.0)
    steps = compose.followed(steps, start, c("_n") == 1, before=True)
    done = compose.running(cut_lineage(steps), BY, "_n", compose.GAUSSIAN, compose.gaussian)
    return done.select(*df.columns, c("_b0").alias("altitude_est"), c("_b1").alias("velocity_est"))


def complementary(imu: DataFrame, dt: float, alpha: float = 0.98, width: float = SLICE_S) -> DataFrame:
    """Roll and pitch (radians): integrated gyro pulled towards the accelerometer. A missing rate counts as none; without
    a whole accelerometer reading the angles follow the gyro alone."""
    c = F.col
    numbered = cut_lineage(scan(imu, BY, ["ts_ns", "seq"], [RowNumber("_n")], width * NS))
    out = numbered
    angles = {
        "roll_rad": (c("gx"), F.atan2("ay", "az")),
        "pitch_rad": (c("gy"), F.atan2(-c("ax"), F.sqrt(c("ay") * c("ay") + c("az") * c("az")))),
    }
    parts = []
    for name, (rate, angle) in angles.items():
        pull = F.when(c("ax").isNull() | c("ay").isNull() | c("az").isNull(), F.lit(1.0)).otherwise(F.lit(alpha))
        out = out.withColumns({f"_a_{name}": pull, f"_b_{name}": pull * F.coalesce(rate, F.lit(0.0)) * dt + (1.0 - pull) * F.coalesce(angle, F.lit(0.0))})
        parts += [f"_a_{name}", f"_b_{name}"]

    def both(earlier: dict, later: dict) -> list[dict]:
        made = {}
        for name in angles:
            one = compose.affine({"_a": earlier[f"_a_{name}"], "_b": earlier[f"_b_{name}"]}, {"_a": later[f"_a_{name}"], "_b": later[f"_b_{name}"]})[0]
            made |= {f"_a_{name}": one["_a"], f"_b_{name}": one["_b"]}
        return [made]

    done = compose.running(out, BY, "_n", parts, both)
    return done.select(*imu.columns, *[c(f"_b_{name}").alias(name) for name in angles])
