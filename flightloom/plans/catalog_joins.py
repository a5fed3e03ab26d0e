"""Queries: time joins, row preparation and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from flightloom.operators import asof, prepare, reports
from flightloom.operators import windows as w
from flightloom.plans.catalog_windows import STATES_SQL, states
from flightloom.plans.registry import query
from flightloom.plans.sqltext import r

c = F.col


def telemetry(d):
    """Captures as a log: every fifth row names no image, an image is named by three rows, taken 0.9 s earlier or later."""
    cap = d.fx_capture
    group = F.floor(c("seq") / 3).cast("bigint")
    name = F.when(c("seq") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("shot_"), group.cast("string")))
    stamp = F.when(c("event_id") % 13 == 0, 0.0).otherwise(c("t") + (c("event_id") % 7 - 3) * 1.25)
    return cap.withColumn("image_name", name).withColumn("image_timestamp", stamp)


TELE = """tele as (select * replace (case when seq % 5 = 0 then '' else 'shot_' || cast(seq // 3 as varchar) end as image_name),
  case when event_id % 13 = 0 then 0 else t + (event_id % 7 - 3) * 1.25 end as image_timestamp from fx_capture),
 tgt as (select mission_id, image_name, first(image_timestamp order by seq) as target_t from tele where image_name <> '' group by all)"""


@query(
    "sync_images",
    ["fx_capture"],
    f"""with {TELE}
    select mission_id, image_name, target_t, row_seq, {r('delta_s')} as delta_s from (
      select g.*, x.seq as row_seq, abs(x.t - g.target_t) as delta_s,
        row_number() over (partition by g.mission_id, g.image_name order by abs(x.t - g.target_t), x.seq) as k
      from tgt g join tele x using (mission_id)) where k = 1""",
)
def sync_images(d):
    synced, _ = asof.sync_images(telemetry(d), ["latitude"])
    return synced.select("mission_id", "image_name", "target_t", "row_seq", F.round("delta_s", 6).alias("delta_s"))


@query(
    "sync_images_own",
    ["fx_capture"],
    f"""with {TELE}
    select mission_id, image_name, seq, t from (
      select g.mission_id, g.image_name, x.seq, x.t, row_number() over (partition by g.mission_id, g.image_name
        order by case when target_t = 0 then 0 else abs(x.t - g.target_t) end, x.seq) as k
      from tgt g join tele x using (mission_id, image_name)) where k = 1""",
)
def sync_images_own(d):
    return asof.sync_images_own(telemetry(d), []).select("mission_id", "image_name", "seq", "t")


@query(
    "sensor_ages",
    ["fx_capture", "fx_worker"],
    f"""with w as (select mission_id, t * 2 - 0.5 as t, case when worker = 'click' then 'GPS' when worker = 'view' then 'IMU' else 'Barometer' end as sensor from fx_worker where ok)
    select c.mission_id, c.seq,
      {r("coalesce((select c.t - max(w.t) from w where w.mission_id = c.mission_id and w.sensor = 'GPS' and w.t <= c.t) * 1000, -1)", 3)} as gps_age_ms,
      {r("coalesce((select c.t - max(w.t) from w where w.mission_id = c.mission_id and w.sensor = 'IMU' and w.t <= c.t) * 1000, -1)", 3)} as imu_age_ms,
      {r("coalesce((select c.t - max(w.t) from w where w.mission_id = c.mission_id and w.sensor = 'Barometer' and w.t <= c.t) * 1000, -1)", 3)} as barometer_age_ms
    from fx_capture c""",
)
def sensor_ages(d):
    sensor = F.when(c("worker") == "click", "GPS").when(c("worker") == "view", "IMU").otherwise("Barometer")
    samples = d.fx_worker.filter("ok").select("mission_id", (c("t") * 2 - 0.5).alias("t"), sensor.alias("sensor"))
    out = asof.sensor_ages(d.fx_capture.select("mission_id", "seq", "t"), samples, ["GPS", "IMU", "Barometer"])
    return out.select("mission_id", "seq", *[F.round(x, 3).alias(x) for x in ("gps_age_ms", "imu_age_ms", "barometer_age_ms")])


@query(
    "events_in_state",
    ["fx_event", "fx_flight"],
    f"""with {STATES_SQL}
    select e.mission_id, e.seq, iv.to_state, iv.entered_at from fx_event e join iv on iv.mission_id = e.mission_id and e.t >= iv.entered_at and e.t <= iv.left_at
    qualify row_number() over (partition by e.mission_id, e.seq order by iv.entered_at desc) = 1""",
)
def events_in_state(d):
    out = asof.events_in_state(d.fx_event, w.state_intervals(states(d)))
    return out.select("mission_id", "seq", "to_state", "entered_at")


@query(
    "row_preparation",
    ["fx_capture"],
    f"""select mission_id, seq, case when baro_altitude > 0 then baro_altitude else gps_altitude end as altitude_pos,
      greatest(case when baro_altitude <> 0 then baro_altitude else gps_altitude end, 2.0) as altitude_floor,
      case when event_id % 2 = 0 then roll * 2 else roll end as best_roll, case when event_id % 2 = 0 then yaw * 2 else yaw end as best_yaw,
      sqrt(gyro_x * gyro_x + gyro_y * gyro_y + gyro_z * gyro_z) / 9.80665 between 0.7 and 1.3 as accel_ok,
      sqrt(gyro_x * gyro_x + gyro_y * gyro_y + gyro_z * gyro_z) between 15 and 85 as mag_ok
    from fx_capture where image_name is not null and image_name <> '' and latitude <> 0 and longitude <> 0""",
)
def row_preparation(d):
    df = prepare.geotagged(prepare.image_rows(d.fx_capture))
    for name in ("roll", "pitch", "yaw"):
        df = df.withColumn(f"ahrs_{name}", c(name) * 2)
    df = prepare.best_attitude(df.withColumn("ahrs_healthy", c("event_id") % 2 == 0))
    g = (c("gyro_x"), c("gyro_y"), c("gyro_z"))
    return df.select(
        "mission_id", "seq", prepare.altitude_pos(c("baro_altitude"), c("gps_altitude")).alias("altitude_pos"),
        prepare.altitude_floor(c("baro_altitude"), c("gps_altitude")).alias("altitude_floor"), "best_roll", "best_yaw",
        prepare.accel_ok(*g).alias("accel_ok"), prepare.mag_ok(*g).alias("mag_ok"),
    )


@query(
    "capture_state_rows",
    ["fx_flight"],
    f"with {STATES_SQL} select mission_id, seq, state from st where state in ('APOGEE', 'DESCENT', 'DESCENT_DROGUE', 'GLIDER_DEPLOY', 'GUIDED_DESCENT')",
)
def capture_state_rows(d):
    return prepare.in_capture_state(states(d)).select("mission_id", "seq", "state")


@query(
    "mission_issues",
    ["fx_capture", "fx_file"],
    """with m as (select distinct mission_id from fx_base),
    k as (select c.mission_id, count(*) as images, count(*) filter (where f.image_name is null) as lost,
      count(*) filter (where latitude = 0 or longitude = 0) as no_gps, count(*) filter (where roll = 0 and pitch = 0 and yaw = 0) as flat
      from fx_capture c left join (select distinct mission_id, image_name from fx_file) f using (mission_id, image_name) group by 1)
    select m.mission_id, 'No image metadata records found.' as issue from m left join k using (mission_id) where images is null
    union all select mission_id, 'Missing image files: ' || lost from k where lost > 0
    union all select mission_id, 'Images without GPS fix: ' || no_gps from k where no_gps > 0
    union all select mission_id, 'Images without nonzero attitude: ' || flat from k where flat > 0""",
)
def mission_issues(d):
    cap = d.fx_capture
    return prepare.mission_issues(cap, d.fx_file, cap)


@query(
    "gps_prior_summary",
    ["fx_capture"],
    """select mission_id, count(*) filter (where latitude <> 0 and longitude <> 0) as gps_priors,
      case when count(*) filter (where latitude <> 0 and longitude <> 0) = 0 then 'No GPS priors available.'
      else count(*) filter (where latitude <> 0 and longitude <> 0) || ' GPS camera priors available. Full SfM-to-GPS alignment requires a successful sparse reconstruction.' end as message
    from fx_capture group by 1""",
)
def gps_prior_summary(d):
    return prepare.gps_prior_summary(d.fx_capture)


@query(
    "calibration_gate",
    ["fx_imu"],
    """select mission_id, seq, greatest(abs(degrees(gx)), abs(degrees(gy)), abs(degrees(gz))) <= 3 as stationary,
      sqrt(ax*ax + ay*ay + az*az) between 8.0 and 11.5 as accel_plausible from fx_imu""",
)
def calibration_gate(d):
    df = d.fx_imu.select(
        "*", *[F.degrees(f"g{a}").alias(f"gyro_{a}_dps") for a in "xyz"], *[c(f"a{a}").alias(f"accel_{a}") for a in "xyz"]
    )
    return prepare.calibration_gate(df).select("mission_id", "seq", "stationary", "accel_plausible")


@query(
    "detector_conditions",
    ["fx_flight"],
    f"""with a as (select *, raw_accel_z / 9.80665 as g, max(baro_altitude) over (partition by mission_id order by t, seq) as top,
        coalesce(baro_altitude - lag(baro_altitude) over (partition by mission_id order by t, seq), 0) as v from fx_flight)
    select mission_id, seq, {r('g')} as accel_g, g > 1.5 or baro_altitude > 30 as launch_condition,
      v < -1 and baro_altitude < top - 2 and baro_altitude > 50 as apogee_condition, baro_altitude <= 600 and v < 0 as deploy_condition,
      baro_altitude < 20 and abs(v) < 1 and g between 0.8 and 1.2 as landing_condition from a""",
)
def detector_conditions(d):
    df = w.vertical_rate(w.running_max(d.fx_flight)).withColumnRenamed("vertical_rate", "vertical_velocity")
    df = df.withColumn("raw_accel_x", F.lit(0.0)).withColumn("raw_accel_y", F.lit(0.0))
    out = prepare.detector_conditions(df)
    return out.select(
        "mission_id", "seq", F.round("accel_g", 6).alias("accel_g"),
        *[f"{x}_condition" for x in ("launch", "apogee", "deploy", "landing")],
    )


@query(
    "threshold_events",
    ["fx_power", "fx_gps"],
    """with j as (select p.mission_id, p.seq, bus_voltage_v, current_a, hdop, fix_type, cast(event_id % 90 as double) as cpu, event_id * 100000 as disk, cast(event_id % 400 as double) as sync, event_id % 8 = 0 as sat
      from fx_power p join fx_gps g using (mission_id, seq) join fx_base b using (mission_id, seq))
    select mission_id, seq, 'POWER_UNDERVOLTAGE' as event_type, 'Power' as source from j where bus_voltage_v < 4.8
    union all select mission_id, seq, 'POWER_OVERCURRENT', 'Power' from j where current_a > 2
    union all select mission_id, seq, 'SYSTEM_TEMP_HIGH', 'System' from j where cpu >= 75
    union all select mission_id, seq, 'DISK_SPACE_LOW', 'System' from j where disk < 524288000
    union all select mission_id, seq, 'GPS_HDOP_DEGRADED', 'GPS' from j where hdop > 3
    union all select mission_id, seq, 'GPS_FIX_LOST', 'GPS' from j where fix_type = 'NO FIX'
    union all select mission_id, seq, 'IMAGE_SYNC_WARNING', 'Camera' from j where sync > 250
    union all select mission_id, seq, 'GIMBAL_SATURATION', 'Gimbal' from j where sat""",
)
def threshold_events(d):
    system = d.fx_base.select(
        "mission_id", "seq", (c("event_id") % 90).cast("double").alias("cpu_temp_c"),
        (c("event_id") * 100000).alias("disk_free_bytes"), (c("event_id") % 400).cast("double").alias("sync_delta_ms"),
        (c("event_id") % 8 == 0).alias("gimbal_saturated"),
    )
    df = d.fx_power.join(d.fx_gps.select("mission_id", "seq", "hdop", "fix_type"), ["mission_id", "seq"]).join(system, ["mission_id", "seq"])
    return prepare.threshold_events(df, ["mission_id", "seq"])


@query(
    "degraded_subsystems",
    ["fx_base"],
    """select mission_id, seq, concat_ws(', ', case when event_id % 2 = 0 then 'gps' end, case when event_id % 3 = 0 and event_id % 5 <> 0 then 'imu' end, case when event_id % 7 = 0 then 'camera' end) as degraded,
      not (event_id % 2 = 0 or (event_id % 3 = 0 and event_id % 5 <> 0) or event_id % 7 = 0) as healthy from fx_base""",
)
def degraded_subsystems(d):
    e = c("event_id")
    df = d.fx_base.select(
        "mission_id", "seq", F.lit(True).alias("gps_enabled"), (e % 2 != 0).alias("gps_ok"), (e % 5 != 0).alias("imu_enabled"),
        (e % 3 != 0).alias("imu_ok"), F.lit(True).alias("camera_enabled"), F.when(e % 7 != 0, True).alias("camera_ok"),
    )
    return prepare.degraded_subsystems(df, ["gps", "imu", "camera"]).select("mission_id", "seq", "degraded", "healthy")


@query(
    "guidance_features",
    ["fx_gps"],
    f"""with g as (select mission_id, seq, radians(longitude - 73.8567) * 6371000.0 * cos(radians(18.5204)) as e, radians(latitude - 18.5204) * 6371000.0 as n, ground_speed_mps as sp, radians(course_deg) as co, altitude_m as alt from fx_gps),
    b as (select *, atan2(500 - e, 400 - n) as be, sqrt(pow(500 - e, 2) + pow(400 - n, 2)) as di, sp * cos(co) as vn, sp * sin(co) as ve from g)
    select mission_id, seq, {r('sin(be - co)')} as f0, {r('cos(be - co)')} as f1, {r('di / 1000')} as f2, {r('(alt - di / 2.5) / 1000')} as f3, {r('sqrt(13) / 10')} as f4,
      {r('case when sp = 0 then sin(be) else sin(be - co) end')} as f12, {r('(ve * cos(be) - vn * sin(be)) / 8')} as f14,
      {r('least(alt / greatest(sqrt(pow(vn - 2, 2) + pow(ve - 3, 2)) / 2.5, 0.1) / 200, 2)')} as f15 from b""",
)
def guidance_features(d):
    from flightloom.functions import geo

    here = geo.to_local_ref(c("latitude"), c("longitude"), F.lit(18.5204), F.lit(73.8567))
    df = d.fx_gps.withColumn("_l", here).select(
        "*", c("_l.east").alias("east"), c("_l.north").alias("north"),
        *[F.lit(float(v)).alias(k) for k, v in dict(target_east=500, target_north=400, wind_north=2, wind_east=3, pitch_rad=0.1, roll_rad=0.2, yaw_rate=0.3, previous_steer=3, previous_brake=6).items()],
    )
    f = c("features")
    out = prepare.guidance_features(df)
    return out.select("mission_id", "seq", *[F.round(f[i], 6).alias(f"f{i}") for i in (0, 1, 2, 3, 4, 12, 14, 15)])


@query(
    "guidance_checks",
    ["fx_capture"],
    f"""select mission_id, seq, {r('seq * 2 / 2.5')} as altitude_needed_m, {r('gps_altitude - 5 - seq * 2 / 2.5')} as altitude_excess_m,
      gps_altitude - 5 > 0 and gps_altitude - 5 - seq * 2 / 2.5 > 15 as too_high,
      {r('case when event_id % 9 <> 0 then roll / 15 * 30 end')} as steer, {r('case when event_id % 9 <> 0 then (pitch / 15 + 1) / 2 * 30 end')} as brake,
      event_id % 9 <> 0 and abs(roll / 15 * 30) <= 30 and (pitch / 15 + 1) / 2 * 30 between 0 and 30 as in_range from fx_capture""",
)
def guidance_checks(d):
    steer = F.when(c("event_id") % 9 != 0, c("roll") / 15).otherwise(F.lit(float("nan")))
    df = d.fx_capture.select(
        "mission_id", "seq", c("gps_altitude").alias("altitude_m"), F.lit(5.0).alias("target_altitude_m"),
        (c("seq") * 2.0).alias("distance_m"), steer.alias("raw_steer"), (c("pitch") / 15).alias("raw_brake"),
    )
    out = prepare.rescale_command(prepare.altitude_budget(df))
    return out.select(
        "mission_id", "seq", *[F.round(x, 6).alias(x) for x in ("altitude_needed_m", "altitude_excess_m", "steer", "brake")],
        "too_high", "in_range",
    )


@query(
    "image_sets",
    ["fx_capture", "fx_file"],
    """with ref as (select distinct mission_id, image_name from fx_capture),
    has as (select distinct mission_id from ref), f as (select distinct mission_id, image_name from fx_file)
    select 'missing' as kind, mission_id, image_name from (select * from ref except select * from f)
    union all select 'orphan', mission_id, image_name from (select * from f except select * from ref) where mission_id in (select mission_id from has)
    union all select 'present', mission_id, image_name from (select * from f intersect select * from ref)
    union all select 'present', mission_id, image_name from f where mission_id not in (select mission_id from has)""",
)
def image_sets(d):
    t, f = d.fx_capture, d.fx_file
    parts = {"missing": reports.missing_images(t, f), "orphan": reports.orphan_images(t, f), "present": reports.present_images(t, f)}
    out = None
    for kind, df in parts.items():
        part = df.select(F.lit(kind).alias("kind"), "mission_id", "image_name")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "reconcile_images",
    ["fx_capture", "fx_file"],
    """with ref as (select distinct mission_id, image_name from fx_capture), f as (select distinct mission_id, image_name from fx_file),
    b as (select coalesce(ref.mission_id, f.mission_id) as mission_id, coalesce(ref.image_name, f.image_name) as image_name, ref.image_name is not null as r, f.image_name is not null as h
      from ref full join f on ref.mission_id = f.mission_id and ref.image_name = f.image_name),
    k as (select mission_id, count(*) filter (where r) as referenced, count(*) filter (where r and h) as bothn, count(*) filter (where h) as files,
      count(*) filter (where r and not h) as missing, count(*) filter (where h and not r) as extra,
      array_to_string(list(image_name order by image_name) filter (where r and not h)[1:5], ',') as me, array_to_string(list(image_name order by image_name) filter (where h and not r)[1:5], ',') as oe from b group by 1)
    select mission_id, referenced, case when referenced > 0 then bothn else files end as present, missing, case when referenced > 0 then extra else 0 end as orphan,
      coalesce(me, '') as missing_examples, case when referenced > 0 then coalesce(oe, '') else '' end as orphan_examples from k""",
)
def reconcile_images(d):
    return reports.reconcile_images(d.fx_capture, d.fx_file)


@query(
    "illegal_transitions",
    ["fx_flight"],
    f"""with {STATES_SQL} select mission_id, from_state, to_state, entered_at from iv where from_state is not null and (from_state, to_state) not in
      (('ARMED_PAD', 'BOOST'), ('BOOST', 'COAST'), ('DESCENT', 'LANDED'))""",
)
def illegal_transitions(d):
    return reports.illegal_transitions(w.state_intervals(states(d))).select("mission_id", "from_state", "to_state", "entered_at")


@query(
    "nav_error",
    ["fx_gps"],
    f"""with e as (select mission_id, seq, case when fix_type = '3D' and satellites >= 5 then
        sqrt(pow(radians(latitude - 18.5204) * 6371000.0, 2) + pow(radians(longitude - 73.8567) * 6371000.0 * cos(radians((latitude + 18.5204) / 2)), 2)) else -1 end as error_m from fx_gps)
    select mission_id, {r('coalesce(avg(error_m) filter (where error_m >= 0), 0)')} as mean_error_m, {r('coalesce(max(error_m) filter (where error_m >= 0), 0)')} as max_error_m,
      count(*) filter (where error_m >= 0) as samples from e group by 1""",
)
def nav_error(d):
    valid = (c("fix_type") == "3D") & (c("satellites") >= 5)
    error = asof.nav_error(F.lit(18.5204), F.lit(73.8567), c("latitude"), c("longitude"), valid)
    out = reports.nav_error_stats(d.fx_gps.withColumn("error_m", error))
    return out.select("mission_id", F.round("mean_error_m", 6).alias("mean_error_m"), F.round("max_error_m", 6).alias("max_error_m"), "samples")
