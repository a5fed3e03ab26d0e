"""Queries: rollups, verdicts and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from flightloom.operators import ordering, reports
from flightloom.operators import windows as w
from flightloom.plans import catalog_pairs as cp
from flightloom.plans.catalog_windows import REPORTED, reported_states
from flightloom.plans.registry import query
from flightloom.plans.sqltext import r

c = F.col


def rounded(df, keys, *names):
    return df.select(*keys, *[F.round(n, 6).alias(n) for n in names])


@query(
    "geotag_summary", ["fx_capture"],
    """select mission_id, count(*) as total_records, count(*) filter (where latitude <> 0 and longitude <> 0) as geotagged,
      count(distinct case when latitude <> 0 and longitude <> 0 then image_name end) as unique_images from fx_capture group by 1""",
)
def geotag_summary(d):
    return reports.geotag_summary(d.fx_capture)


@query(
    "map_endpoints", ["fx_capture"],
    f"""select mission_id, {r('avg(latitude)')} as centre_lat, {r('avg(longitude)')} as centre_lon, first(latitude order by t, seq) as start_lat, first(longitude order by t, seq) as start_lon,
      last(latitude order by t, seq) as end_lat, last(longitude order by t, seq) as end_lon from fx_capture group by 1""",
)
def map_endpoints(d):
    df = d.fx_capture
    centre = rounded(reports.map_centre(df), ["mission_id"], "centre_lat", "centre_lon")
    return centre.join(reports.endpoints(df), "mission_id")


@query(
    "session_minmax", ["fx_capture", "fx_power"],
    """select mission_id, count(*) as sample_count, """
    + ", ".join(f"{f}({s}) as {f}_{s}" for s in ("baro_altitude", "gps_altitude", "roll", "pitch", "yaw", "bus_voltage_v", "current_a") for f in ("min", "max"))
    + " from fx_capture join fx_power using (mission_id, seq) group by 1",
)
def session_minmax(d):
    return reports.session_minmax(d.fx_capture.join(d.fx_power, ["mission_id", "seq"]), ["mission_id"])


@query(
    "session_report", ["fx_capture", "fx_event", "fx_flight", "fx_worker"],
    """with st as (select mission_id, seq, t, case when baro_altitude > 600 then 'A' else 'B' end as state from fx_flight),
    ch as (select * from (select *, lag(state) over (partition by mission_id order by t, seq) as p from st) where p is null or p <> state)
    select mission_id, sample_count, lo as min_baro_altitude, hi as max_baro_altitude, events, state_changes, workers from
      (select mission_id, count(*) as sample_count, min(baro_altitude) as lo, max(baro_altitude) as hi from fx_capture group by 1)
      join (select mission_id, count(*) as events from fx_event group by 1) using (mission_id) join (select mission_id, count(*) as state_changes from ch group by 1) using (mission_id)
      join (select mission_id, count(distinct worker) as workers from fx_worker group by 1) using (mission_id)""",
)
def session_report(d):
    states = w.state_intervals(d.fx_flight.withColumn("state", F.when(c("baro_altitude") > 600, "A").otherwise("B")))
    out = reports.session_report(d.fx_capture.select("mission_id", "baro_altitude"), d.fx_event, states, d.fx_worker)
    return out


@query(
    "power_summary", ["fx_power"],
    "select mission_id, min(bus_voltage_v) as min_voltage_v, max(current_a) as max_current_a, count(*) filter (where bus_voltage_v < 4.8) as undervoltage_events from fx_power group by 1",
)
def power_summary(d):
    return reports.power_summary(d.fx_power)


@query(
    "reconstruction_report", ["fx_capture", "fx_pixel", "fx_geometry", "fx_match", "fx_file"],
    f"""with {cp.QUALITY}, {cp.GEOMETRY},
    iss as (select c.mission_id, count(*) filter (where f.image_name is null) as lost, count(*) filter (where latitude = 0 or longitude = 0) as no_gps, count(*) filter (where roll = 0 and pitch = 0 and yaw = 0) as flat
      from fx_capture c left join (select distinct mission_id, image_name from fx_file) f using (mission_id, image_name) group by 1),
    q as (select mission_id, count(*) as total_images, count(*) filter (where status = 'GOOD') as good, count(*) filter (where status = 'MARGINAL') as marginal, count(*) filter (where status = 'REJECTED') as rejected from quality group by 1),
    e as (select mission_id, count(*) as candidate_edges from fx_match group by 1), g as (select mission_id, count(*) as tested_pairs, count(*) filter (where accepted) as verified_edges from geo group by 1)
    select q.mission_id, total_images, good, marginal, rejected, coalesce(candidate_edges, 0) as candidate_edges, coalesce(tested_pairs, 0) as tested_pairs, coalesce(verified_edges, 0) as verified_edges,
      {r('coalesce(verified_edges / nullif(tested_pairs, 0), 0)')} as verified_rate,
      concat_ws('; ', case when no_gps > 0 then 'Images without GPS fix: ' || no_gps end, case when flat > 0 then 'Images without nonzero attitude: ' || flat end, case when lost > 0 then 'Missing image files: ' || lost end) as warnings
    from q left join e using (mission_id) left join g using (mission_id) left join iss using (mission_id)""",
)
def reconstruction_report(d):
    from flightloom.operators.prepare import mission_issues

    cap = d.fx_capture
    out = reports.reconstruction_report(cap, cp.quality(d), d.fx_match, cp.geometry(d), mission_issues(cap, d.fx_file))
    return out.withColumn("verified_rate", F.round("verified_rate", 6))


TIMELINE = """wt as (select *, lag(ok) over p as po, sum(case when ok then 0 else 1 end) over p as errs, sum(case when ok then 1 else 0 end) over p as g from fx_worker window p as (partition by mission_id, worker order by t, seq)),
    wh as (select mission_id, worker, count(*) filter (where ok) as iterations, count(*) filter (where not ok) as errors, coalesce(last(error order by t, seq) filter (where not ok), '') as last_error,
      count(*) filter (where not ok and t > coalesce(lt, -1)) as consecutive_errors, count(*) filter (where ok and not coalesce(po, true) and errs > 0) as recoveries,
      last(case when ok then 'HEALTHY' else 'FAILED' end order by t, seq) as last_status, max(case when ok then t end) as last_update
      from (select *, max(case when ok then t end) over (partition by mission_id, worker) as lt from wt) group by 1, 2)"""


@query("worker_health", ["fx_worker"], f"with {TIMELINE} select * from wh")
def worker_health(d):
    return reports.worker_health(w.worker_timeline(d.fx_worker))


_NAMES = {"click": "GPS", "view": "Camera", "signup": "Power", "purchase": "Navigation", "logout": "System"}


@query(
    "verification_summary", ["fx_worker", "fx_event"],
    f"""with {TIMELINE}, cats(ord, category, worker) as (values (0, 'Sensors', 'GPS'), (1, 'Sensors', 'IMU'), (2, 'Sensors', 'Barometer'), (3, 'Payload', 'Camera'), (4, 'Payload', 'Gimbal'), (5, 'Payload', 'ImageQuality'), (6, 'Payload', 'Storage'),
        (7, 'Logging', 'DataLogger'), (8, 'Power', 'Power'), (9, 'Navigation', 'Navigation'), (10, 'Telemetry', 'Telemetry'), (11, 'System', 'System')),
    en(worker, enabled) as (values ('IMU', false), ('Telemetry', false)),
    h as (select mission_id, case worker {' '.join(f"when '{k}' then '{v}'" for k, v in _NAMES.items())} else worker end as worker,
      case when last_status = 'HEALTHY' and 70 - last_update > 3 then 'STALE' when last_status = 'HEALTHY' and errors > 2 then 'DEGRADED' else last_status end as status, last_error as reason from wh),
    x as (select m.mission_id, cats.*, coalesce(enabled, true) as on_, status, coalesce(nullif(reason, ''), status) as why from (select distinct mission_id from wh) m cross join cats left join en using (worker) left join h on h.mission_id = m.mission_id and h.worker = cats.worker),
    v as (select mission_id, category, ord, case when not on_ then 0 when status is null then 2 when status in ('STALE', 'FAILED') then 3 when status = 'DEGRADED' then 2 else 1 end as lv,
      case when not on_ then worker || ' skipped by active test profile.' when status is null then worker || ' has not reported yet.' else worker || ': ' || why end as reason from x
      union all select mission_id, 'StateFlow', 1000, 2, count(*) || ' blocked state transition(s).' from fx_event where event_code = 'E1' and severity = 'ERROR' group by mission_id)
    select mission_id, category, ['SKIP', 'PASS', 'WARN', 'FAIL'][max(lv) + 1] as status,
      case when max(lv) = 1 then 'Nominal.' else array_to_string(list(reason order by ord, reason) filter (where lv <> 1)[1:6], ' | ') end as reasons from v group by 1, 2""",
)
def verification_summary(d):
    spark = d.spark
    health = reports.worker_health(w.worker_timeline(d.fx_worker))
    named = c("worker")
    for k, v in _NAMES.items():
        named = F.when(c("worker") == k, v).otherwise(named)
    stale = (c("last_status") == "HEALTHY") & (F.lit(70.0) - c("last_update") > 3)
    status = F.when(stale, "STALE").when((c("last_status") == "HEALTHY") & (c("errors") > 2), "DEGRADED").otherwise(c("last_status"))
    judged = health.select("mission_id", named.alias("worker"), status.alias("status"), c("last_error").alias("reason"))
    enabled = spark.createDataFrame([("IMU", False), ("Telemetry", False)], "worker string, enabled boolean")
    blocked = d.fx_event.withColumn(
        "event_type", F.when((c("event_code") == "E1") & (c("severity") == "ERROR"), "STATE_CHANGE_BLOCKED").otherwise("OTHER")
    )
    return reports.verification(judged, enabled, reports.blocked_transitions(blocked))


STATE_HEALTH = f"""{REPORTED}, wh as (select mission_id, worker, count(*) filter (where ok) as iterations, count(*) filter (where not ok) as errors,
      coalesce(last(error order by t, seq) filter (where not ok), '') as last_error, last(streak order by t, seq, silent) as consecutive_errors,
      count(*) filter (where recovered) as recoveries, last(st order by t, seq, silent) as last_status, max(case when ok then t end) as last_update
      from states group by 1, 2)"""


@query("worker_state_health", ["fx_worker"], f"with {STATE_HEALTH} select * from wh")
def worker_state_health(d):
    return reports.worker_health(reported_states(d))


@query(
    "overall_verdicts", ["fx_worker"],
    f"""with {STATE_HEALTH}, cats(ord, category, worker) as (values (0, 'Sensors', 'GPS'), (1, 'Sensors', 'IMU'), (2, 'Sensors', 'Barometer'), (3, 'Payload', 'Camera'), (4, 'Payload', 'Gimbal'), (5, 'Payload', 'ImageQuality'), (6, 'Payload', 'Storage'),
        (7, 'Logging', 'DataLogger'), (8, 'Power', 'Power'), (9, 'Navigation', 'Navigation'), (10, 'Telemetry', 'Telemetry'), (11, 'System', 'System')),
    h as (select mission_id, case worker {' '.join(f"when '{k}' then '{v}'" for k, v in _NAMES.items())} else worker end as worker, last_status as status, last_error as reason from wh),
    x as (select m.mission_id, cats.*, cats.worker not in ('IMU', 'Telemetry') as on_, status, coalesce(nullif(reason, ''), status) as why from (select distinct mission_id from wh) m cross join cats left join h on h.mission_id = m.mission_id and h.worker = cats.worker),
    v as (select mission_id, category, ord, case when not on_ or status = 'DISABLED' then 0 when status is null or status = 'DEGRADED' then 2 when status in ('STALE', 'FAILED') then 3 else 1 end as lv,
      case when not on_ then worker || ' skipped by active test profile.' when status is null then worker || ' has not reported yet.' when status = 'DISABLED' then worker || ' skipped: ' || why else worker || ': ' || why end as reason from x),
    o as (select mission_id, max(lv) as top from v group by 1)
    select mission_id, category, ['SKIP', 'PASS', 'WARN', 'FAIL'][max(lv) + 1] as status,
      case when max(lv) = 1 then 'Nominal.' else array_to_string(list(reason order by ord, reason) filter (where lv <> 1)[1:6], ' | ') end as reasons,
      ['SKIP', 'PASS', 'WARN', 'FAIL'][any_value(top) + 1] as overall from v join o using (mission_id) group by 1, 2""",
)
def overall_verdicts(d):
    named = c("worker")
    for k, v in _NAMES.items():
        named = F.when(c("worker") == k, v).otherwise(named)
    health = reports.worker_health(reported_states(d))
    judged = health.select("mission_id", named.alias("worker"), c("last_status").alias("status"), c("last_error").alias("reason"))
    enabled = d.spark.createDataFrame([("IMU", False), ("Telemetry", False)], "worker string, enabled boolean")
    verdicts = reports.verification(judged, enabled)
    return verdicts.join(reports.overall(verdicts), "mission_id")


@query(
    "calibration", ["fx_imu"],
    f"""with s as (select *, 1000 + seq % 7 as p, 20 + seq % 5 as tc from fx_imu)
    select mission_id, count(*) as samples, {', '.join(f"{r(f'avg({x})')} as mean_{x}" for x in ('gx', 'gy', 'gz', 'ax', 'ay', 'az'))},
      {', '.join(f"{r(f'(min({x}) + max({x})) / 2')} as offset_{x}" for x in ('mx', 'my', 'mz'))}, {r('avg(p)')} as pressure_mean_hpa, {r('avg(tc)')} as temperature_mean_c,
      {r('avg(p) / pow(1 - 50 / 44330.0, 5.255)')} as sea_level_pressure_hpa, cast(last(seq % 4 order by ts_ns) as bigint) as last_status from s group by 1""",
)
def calibration(d):
    samples = d.fx_imu.select(
        "*", (c("seq") % 7 + 1000.0).alias("pressure_hpa"), (c("seq") % 5 + 20.0).alias("temperature_c"), (c("seq") % 4).alias("calibration_status")
    )
    out = reports.calibrate(samples, 50.0)
    names = [x for x in out.columns if x not in ("mission_id", "samples", "last_status")]
    return rounded(out, ["mission_id", "samples", "last_status"], *names)


@query(
    "calibrated_samples", ["fx_imu"],
    f"""with k as (select mission_id, avg(gx) as bx, avg(gz) as bz, (min(mx) + max(mx)) / 2 as ox from fx_imu group by 1)
    select i.mission_id, i.seq, {r('gx - coalesce(bx, 0) + 1e-9')} as gx, {r('degrees(gz - coalesce(bz, 0))')} as gz_dps, {r('mx - coalesce(ox, 0)')} as mx from fx_imu i left join k using (mission_id)""",
)
def calibrated_samples(d):
    imu = d.fx_imu.select("mission_id", "seq", F.array("gx", "gy", "gz").alias("gyro"), F.array("mx", "my", "mz").alias("mag"))
    cal = reports.calibrate(d.fx_imu).select(
        "mission_id", F.array("mean_gx", "mean_gy", "mean_gz").alias("bias"), F.array("offset_mx", "offset_my", "offset_mz").alias("offset")
    )
    out = reports.apply_calibration(imu, cal)
    return out.select(
        "mission_id", "seq", F.round(c("gyro")[0] + 1e-9, 6).alias("gx"), F.round(c("gyro_dps")[2], 6).alias("gz_dps"), F.round(c("mag")[0], 6).alias("mx")
    )


@query(
    "latency_profile", ["fx_base"],
    f"""with s as (select mission_id, value, row_number() over (partition by mission_id order by value) - 1 as i, count(*) over (partition by mission_id) as n from fx_base)
    select mission_id, max(n) as n, {r('avg(value) + 1e-9')} as mean, {r('max(value)')} as max, max(case when i = least(cast(floor(n * 0.95) as bigint), n - 1) then value end) as p95, max(case when i = least(cast(floor(n * 0.99) as bigint), n - 1) then value end) as p99 from s group by 1""",
)
def latency_profile(d):
    # a hair off rounding ties, on both sides of the check
    out = reports.latency_profile(d.fx_base, ["mission_id"], "value").withColumn("mean", c("mean") + 1e-9)
    return rounded(out, ["mission_id", "n", "p95", "p99"], "mean", "max")


@query(
    "interference", ["fx_imu"],
    f"""with s as (select mission_id, seq, sqrt(mx*mx + my*my + mz*mz) as norm, seq % 3 <> 0 as motor from fx_imu),
    b as (select mission_id, avg(norm) as base from s where not motor group by 1),
    o as (select s.*, base, min(norm) over f as low, max(norm) over f as high, stddev_pop(norm) over f as sigma from s join b using (mission_id) where motor window f as (partition by mission_id order by seq rows between 19 preceding and current row))
    select mission_id, seq, {r('base')} as baseline, {r('low')} as low, {r('high')} as high, {r('sigma')} as sigma, {r('abs(norm - base)')} as delta, abs(norm - base) > 20 as spike from o""",
)
def interference(d):
    from flightloom.functions.attitude import vector_norm

    samples = d.fx_imu.select(
        "mission_id", "seq", c("seq").cast("double").alias("t"), vector_norm(c("mx"), c("my"), c("mz")).alias("norm"), (c("seq") % 3 != 0).alias("motor_on")
    )
    out = reports.emi_stats(samples, 20, 20.0)
    return rounded(out, ["mission_id", "seq", "spike"], "baseline", "low", "high", "sigma", "delta")


@query(
    "ability_verdicts", ["fx_geometry", "fx_match"],
    f"""with {cp.GEOMETRY}, g as (select mission_id, bool_or(seq % 3 + 1 > 1 and accepted) as far, bool_or(accepted) as anyv, bool_or(not accepted) as ref from geo group by 1), e as (select distinct mission_id from fx_match)
    select coalesce(g.mission_id, e.mission_id) as mission_id, case when e.mission_id is not null then 'PASS' else 'FAIL' end as overlap_discovery, case when far then 'PASS' else 'PARTIAL' end as non_sequential_matching,
      case when anyv then 'PASS' else 'FAIL' end as scale_perspective_tolerance, case when ref then 'PASS' else 'PARTIAL' end as rejection_of_weak_pairs from g full join e on e.mission_id = g.mission_id""",
)
def ability_verdicts(d):
    return reports.ability_verdicts(d.fx_match, cp.geometry(d).withColumn("number_gap", c("seq") % 3 + 1))


@query(
    "dense_stage_status", ["fx_capture"],
    f"""with s as (select mission_id, count(*) filter (where event_id % 5 <> 0) as registered, count(*) as usable, bool_or(event_id % 97 = 0) as dense_ok from fx_capture group by 1)
    select mission_id, {r('registered / usable')} as registration_rate, case when registered / usable < 0.8 then 'SKIPPED' when dense_ok then 'SUCCESS' else 'FAILED' end as dense_status from s""",
)
def dense_stage_status(d):
    s = d.fx_capture.groupBy("mission_id").agg(
        F.count_if(c("event_id") % 5 != 0).alias("registered"), F.count(F.lit(1)).alias("usable"), F.bool_or(c("event_id") % 97 == 0).alias("dense_ok")
    )
    return rounded(reports.stage_status(s), ["mission_id", "dense_status"], "registration_rate")


@query(
    "dataset_availability", ["fx_capture"],
    """select mission_id, bool_or(event_id % 29 <> 0) as gps_available, bool_or(event_id % 150 = 0) as altitude_available, bool_or(event_id % 200 = 0) as time_available from fx_capture group by 1""",
)
def dataset_availability(d):
    e = c("event_id")
    attrs = d.fx_capture.select(
        "mission_id", F.when(e % 29 != 0, c("latitude")).alias("latitude"), F.when(e % 29 != 0, c("longitude")).alias("longitude"),
        F.when(e % 150 == 0, 1.0).alias("altitude"), F.when(e % 200 == 0, 1.0).alias("taken_at"),
    )
    return reports.dataset_availability(attrs)


@query(
    "event_rollup", ["fx_event"],
    """select mission_id, source, event_code, severity, count(*) as n, min(t) as first_t, max(t) as last_t, cast(grouping(mission_id, source, event_code, severity) as bigint) as level
    from fx_event group by rollup(mission_id, source, event_code, severity)""",
)
def event_rollup(d):
    return reports.event_rollup(d.fx_event)


@query(
    "verdict_tally", ["fx_worker"],
    "select mission_id, count(*) filter (where v = 0) as pass, count(*) filter (where v = 1) as fail, count(*) filter (where v = 2) as skip from (select mission_id, seq % 3 as v from fx_worker) group by 1",
)
def verdict_tally(d):
    v = F.element_at(F.array(F.lit("PASS"), F.lit("FAIL"), F.lit("SKIP")), (c("seq") % 3 + 1).cast("int"))
    return reports.verdict_tally(d.fx_worker.withColumn("verdict", v), ["mission_id"])


@query(
    "mean_rate", ["fx_worker"],
    f"select mission_id, worker, count(*) as n, {r('count(*) / greatest(1e-6, max(t) - min(t))', 3)} as rate_hz from fx_worker group by 1, 2",
)
def mean_rate(d):
    return reports.mean_rate(d.fx_worker, ["mission_id", "worker"]).withColumn("rate_hz", F.round("rate_hz", 3))


@query(
    "window_peaks", ["fx_event", "fx_imu"],
    f"select e.mission_id, cast(floor(e.t / 0.5) as bigint) as window_no, max(abs(ax)) as peak, cast(sum(e.seq % 5 - 2) as bigint) as net_steps from fx_event e join fx_imu i using (mission_id, seq) group by 1, 2",
)
def window_peaks(d):
    df = d.fx_event.join(d.fx_imu.select("mission_id", "seq", c("ax").alias("rate")), ["mission_id", "seq"])
    return reports.window_peaks(df.withColumn("steps", c("seq") % 5 - 2))


@query(
    "capture_stats", ["fx_capture"],
    """with o as (select mission_id, case when event_id % 11 = 0 then 'f' when event_id % 7 = 0 then 'd' else 'k' end as o from fx_capture)
    select mission_id, count(*) filter (where o = 'k') as successful, count(*) filter (where o = 'f') as failed, count(*) filter (where o = 'd') as dropped, count(*) filter (where o <> 'f') as sequence, count(*) as total from o group by 1""",
)
def capture_stats(d):
    o = F.when(c("event_id") % 11 == 0, "failed").when(c("event_id") % 7 == 0, "dropped").otherwise("ok")
    return reports.capture_stats(d.fx_capture.withColumn("outcome", o))


@query(
    "report_comparison", ["fx_capture"],
    """with b as (select mission_id, count(*) as images, min(yaw) as yaw from fx_capture group by 1), a as (select mission_id, count(*) filter (where latitude <> 0) as images, max(yaw) as yaw from fx_capture group by 1)
    select mission_id, b.images as images_before, b.yaw as yaw_before, a.images as images_after, a.yaw as yaw_after, a.images - b.images as images_change, a.yaw - b.yaw as yaw_change from b full join a using (mission_id)""",
)
def report_comparison(d):
    # all images before, those with a position after
    before = d.fx_capture.groupBy("mission_id").agg(F.count(F.lit(1)).alias("images"), F.min("yaw").alias("yaw"))
    after = d.fx_capture.groupBy("mission_id").agg(F.count_if(c("latitude") != 0).alias("images"), F.max("yaw").alias("yaw"))
    return reports.compare_reports(before, after, ["images", "yaw"])


@query(
    "stage_summary", ["fx_capture", "fx_pixel", "fx_file", "fx_match"],
    f"""with {cp.QUALITY}, u as (select mission_id, count(*) as usable from quality where status <> 'REJECTED' and (mission_id, image_name) in (select mission_id, image_name from fx_file) group by 1),
    e as (select mission_id, count(*) as edges from fx_match group by 1),
    i as (select mission_id, count(*) filter (where latitude = 0) > 0 as a, count(*) filter (where roll = 0 and pitch = 0 and yaw = 0) > 0 as b, count(*) as images from fx_capture group by 1)
    select i.mission_id, images, coalesce(usable, 0) as usable, coalesce(edges, 0) as edges, cast(a as bigint) + cast(b as bigint) as issues from i left join u using (mission_id) left join e using (mission_id)""",
)
def stage_summary(d):
    from flightloom.operators.prepare import mission_issues

    cap = d.fx_capture
    return reports.stage_summary(cap, d.fx_file, cp.quality(d).select("mission_id", "image_name", "usable"), d.fx_match, mission_issues(cap))


@query(
    "feature_stats", ["fx_capture"],
    f"select mission_id, count(*) as images, {r('avg(event_id % 4000)')} as mean_features, count(*) filter (where event_id % 3 = 0) as cache_hits, count(*) filter (where event_id % 3 <> 0) as cache_misses from fx_capture group by 1",
)
def feature_stats(d):
    df = d.fx_capture.withColumn("features", c("event_id") % 4000).withColumn("cached", c("event_id") % 3 == 0)
    return rounded(reports.feature_stats(df, ["mission_id"]), ["mission_id", "images", "cache_hits", "cache_misses"], "mean_features")


@query(
    "reprojection_stats", ["fx_base"],
    f"select mission_id, count(*) as n, {r('avg(value / 100)')} as mean_px, {r('median(value / 100)')} as median_px from fx_base group by 1",
)
def reprojection_stats(d):
    out = reports.reprojection_stats(d.fx_base.withColumn("error_px", c("value") / 100), ["mission_id"])
    return rounded(out, ["mission_id", "n"], "mean_px", "median_px")


@query(
    "rate_windows", ["fx_base"],
    """with w as (select mission_id, epoch_us(time_bucket(interval '1 hour', ts)) as window_us, count(*) as n from fx_base group by 1, 2)
    select mission_id, window_us, n, n / 3600.0::double as actual_hz, n < 2 as below_expected from w""",
)
def rate_windows(d):
    out = reports.rate_windows(d.fx_base, 3600.0, 2 / 3600.0, ["mission_id"])
    return out.select("mission_id", F.unix_micros("window_start").alias("window_us"), "n", "actual_hz", "below_expected")


@query(
    "image_order", ["fx_file"],
    """with a as (select mission_id, image_name, length, case when length % 3 = 0 then cast(length as double) end as taken, coalesce(try_cast(regexp_extract(image_name, '(\\d+)\\.jpg', 1) as bigint), 1000000000000) as num from fx_file),
    b as (select *, bool_or(taken is not null) over (partition by mission_id) as dated from a)
    select mission_id, image_name, row_number() over (partition by mission_id order by case when dated then taken end nulls last, num, lower(image_name)) as position from b""",
)
def image_order(d):
    df = d.fx_file.withColumn("taken_at", F.when(c("length") % 3 == 0, c("length").cast("double")))
    return ordering.image_order(df).select("mission_id", "image_name", "position")


@query(
    "selected_images", ["fx_capture"],
    "select mission_id, image_name, seq from fx_capture qualify row_number() over (partition by mission_id order by t, seq) <= 25",
)
def selected_images(d):
    return ordering.select_images(d.fx_capture, 25).select("mission_id", "image_name", "seq")


@query("time_sorted_events", ["fx_event"], "select mission_id, seq, t, severity from fx_event order by mission_id, t, seq")
def time_sorted_events(d):
    return ordering.ordered(d.fx_event).select("mission_id", "seq", "t", "severity")
