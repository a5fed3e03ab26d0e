"""Queries: folds in time order. Their checks are recursive SQL, one step per sample."""

from __future__ import annotations

from pyspark.sql import functions as F

from flightloom.operators import estimators as est
from flightloom.plans.registry import query
from flightloom.plans.sqltext import r

c = F.col


def rounded(df, keys, *names):
    return df.select(*keys, *[F.round(n, 6).alias(n) for n in names])


@query(
    "debounced_events", ["fx_event"],
    """with recursive e as (select *, row_number() over (partition by mission_id, source, event_code, message order by t, seq) as k from fx_event),
    s as (select mission_id, source, event_code, message, k, seq, true as kept, t as last from e where k = 1
      union all select e.mission_id, e.source, e.event_code, e.message, e.k, e.seq, e.t - s.last >= 2.0, case when e.t - s.last >= 2.0 then e.t else s.last end
      from s join e on e.mission_id = s.mission_id and e.source = s.source and e.event_code = s.event_code and e.message = s.message and e.k = s.k + 1)
    select mission_id, seq, source, event_code from s where kept""",
)
def debounced_events(d):
    return est.debounce(d.fx_event).select("mission_id", "seq", "source", "event_code")


GPS_SQL = """j as (select *, case when fix_type = 'NO FIX' then 'GPS_NO_FIX' when satellites < 5 then 'GPS_LOW_SATELLITES' when hdop > 4.0 then 'GPS_BAD_HDOP' end as verdict from fx_gps),
    s as (select 0::bigint as seq, mission_id, 'x' as reason, null::double as dist, null::bigint as lts, null::double as la, null::double as lo from (select distinct mission_id from fx_gps)
      union all select z.seq, z.mission_id, z.reason, case when z.verdict is null and z.lts is not null and z.reason not like '%TIMESTAMP%' then z.dist end,
        case when z.reason = 'GPS_VALID' then z.ts_ns else z.lts end, case when z.reason = 'GPS_VALID' then z.latitude else z.la end, case when z.reason = 'GPS_VALID' then z.longitude else z.lo end
      from (select y.*, case when verdict is not null then verdict when lts is null then 'GPS_VALID' when ts_ns < lts then 'GPS_TIMESTAMP_REGRESSED' when ts_ns = lts then 'GPS_DUPLICATE_TIMESTAMP'
          when dist > 250 then 'GPS_ABSOLUTE_JUMP' when dist / ((ts_ns - lts) / 1e9) > 120 then 'GPS_IMPLIED_SPEED_IMPLAUSIBLE' else 'GPS_VALID' end as reason
        from (select j.*, s.lts, s.la, s.lo, sqrt(pow(radians(j.latitude - s.la) * 6371000.0, 2) + pow(radians(j.longitude - s.lo) * 6371000.0 * cos(radians((j.latitude + s.la) / 2)), 2)) as dist
          from s join j on j.mission_id = s.mission_id and j.seq = s.seq + 1) y) z)"""


@query(
    "gps_validation", ["fx_gps"],
    f"with recursive {GPS_SQL} select mission_id, seq, reason, reason = 'GPS_VALID' as valid, {r('dist', 4)} as distance_m from s where seq > 0",
)
def gps_validation(d):
    out = est.validate_gps(d.fx_gps)
    return out.select("mission_id", "seq", "reason", "valid", F.round("distance_m", 4).alias("distance_m"))


@query(
    "gps_velocity", ["fx_gps"],
    f"""with g as (select *, case when seq % 4 <> 0 then ground_speed_mps end as sp from fx_gps),
    p as (select *, (ts_ns - lag(ts_ns) over w) / 1e9 as dt, lag(latitude) over w as la, lag(longitude) over w as lo from g window w as (partition by mission_id order by ts_ns))
    select mission_id, seq, {r('coalesce(sp * cos(radians(course_deg)), radians(latitude - la) * 6371000.0 / dt)', 4)} as vn,
      {r('coalesce(sp * sin(radians(course_deg)), radians(longitude - lo) * 6371000.0 * cos(radians((latitude + la) / 2)) / dt)', 4)} as ve,
      case when sp >= 2 then course_deg end as gps_heading from p""",
)
def gps_velocity(d):
    fixes = d.fx_gps.withColumn("ground_speed_mps", F.when(c("seq") % 4 != 0, c("ground_speed_mps")))
    out = est.gps_velocity(fixes)
    return out.select("mission_id", "seq", F.round("vn", 4).alias("vn"), F.round("ve", 4).alias("ve"), "gps_heading")


@query(
    "flight_phases", ["fx_flight"],
    """with recursive j as (select mission_id, seq, t, baro_altitude as alt, raw_accel_z / 9.80665 as g, coalesce(baro_altitude - lag(baro_altitude) over (partition by mission_id order by t, seq), 0) as v from fx_flight),
    s as (select mission_id, 0::bigint as seq, 'ARMED_PAD' as phase, null::double as launch, null::double as mark, null::double as landing, 0.0::double as top, 0 as streak, false as entered, null::varchar as why from (select distinct mission_id from fx_flight)
      union all select mission_id, seq, coalesce(target, phase), case when target = 'BOOST' then t else launch end, case when target in ('APOGEE', 'GLIDER_DEPLOY') then t else mark end,
        case when phase = 'GUIDED_DESCENT' and (launch is null or t - launch <= 600) then case when low then coalesce(landing, t) end else landing end,
        case when target = 'BOOST' then alt else top2 end, case when target is not null then 0 else st2 end, target is not null, case when target is not null then why2 end
      from (select *, case when t - launch > 600 and phase not in ('ABORT', 'LANDED') then 'ABORT'
          when t - launch > 600 then null
          when phase = 'ARMED_PAD' and st2 >= 3 then 'BOOST' when phase = 'BOOST' and (st2 >= 5 or t - launch > 10) then 'COAST' when phase = 'COAST' and (st2 >= 5 or t - launch > 30) then 'APOGEE'
          when phase = 'APOGEE' and t - mark >= 1 then 'DESCENT_DROGUE' when phase = 'DESCENT_DROGUE' and st2 >= 5 then 'GLIDER_DEPLOY' when phase = 'GLIDER_DEPLOY' and t - mark >= 1 then 'GUIDED_DESCENT'
          when phase = 'GUIDED_DESCENT' and low and t - landing >= 5 then 'LANDED' end as target,
          case phase when 'ARMED_PAD' then 'launch_detected' when 'BOOST' then case when g < 1.5 then 'boost_burnout' else 'boost_timeout' end when 'COAST' then case when t - launch > 30 then 'apogee_backup_timeout' else 'apogee_detected' end
            when 'APOGEE' then 'apogee_settle_elapsed' when 'DESCENT_DROGUE' then 'glider_deploy_altitude_reached' when 'GLIDER_DEPLOY' then 'glider_deploy_settle_elapsed' else 'landing_detector_persistent' end as why2
        from (select *, case when cond then streak + 1 else 0 end as st2 from (select s.mission_id, j.seq, s.phase, s.launch, s.mark, s.landing, s.streak, j.t, j.alt, j.g, j.v, greatest(s.top, j.alt) as top2,
            j.alt < 20 and abs(j.v) < 1 and j.g between 0.8 and 1.2 as low,
            case s.phase when 'ARMED_PAD' then j.g > 1.5 or j.alt > 30 when 'BOOST' then j.g < 1.5 when 'COAST' then j.v < -1 and j.alt < greatest(s.top, j.alt) - 2 and j.alt > 50 when 'DESCENT_DROGUE' then j.alt <= 600 and j.v < 0 else false end as cond
          from s join j on j.mission_id = s.mission_id and j.seq = s.seq + 1) a) b) z)
    select mission_id, seq, phase, entered, why as phase_reason from s where seq > 0""",
)
def flight_phases(d):
    df = d.fx_flight.withColumn("raw_accel_x", F.lit(0.0)).withColumn("raw_accel_y", F.lit(0.0))
    return est.flight_phases(df).select("mission_id", "seq", "phase", "entered", "phase_reason")


@query(
    "descent_phases", ["fx_flight"],
    """with recursive j as (select mission_id, seq, baro_altitude as alt, coalesce(baro_altitude - lag(baro_altitude) over (partition by mission_id order by t, seq), 0) as v,
        count(*) over f >= 10 as full_, first(baro_altitude) over f as first_, avg(baro_altitude) over f as mean_ from fx_flight window f as (partition by mission_id order by t, seq rows between 9 preceding and current row)),
    s as (select mission_id, 0::bigint as seq, 'BOOST' as phase, false as fired from (select distinct mission_id from fx_flight)
      union all select j.mission_id, j.seq, case when phase = 'BOOST' and full_ and alt < first_ - 5 and v < -2 then 'DROGUE_DESCENT' when phase = 'DROGUE_DESCENT' and full_ and mean_ <= 600 and v < -2 then 'DEPLOYMENT_TRIGGER'
        when phase = 'DEPLOYMENT_TRIGGER' then 'DEPLOYMENT_VERIFICATION' when phase = 'DEPLOYMENT_VERIFICATION' then 'GUIDED_DESCENT' when phase = 'GUIDED_DESCENT' and alt <= 5 then 'LANDED' else phase end,
        fired or phase = 'DEPLOYMENT_TRIGGER' from s join j on j.mission_id = s.mission_id and j.seq = s.seq + 1)
    select mission_id, seq, phase, fired from s where seq > 0""",
)
def descent_phases(d):
    from flightloom.operators.windows import vertical_rate

    df = vertical_rate(d.fx_flight)
    return est.descent_phases(df, "baro_altitude", "vertical_rate").select("mission_id", "seq", "phase", "fired")


@query(
    "complementary_attitude", ["fx_imu"],
    f"""with recursive s as (select mission_id, 0::bigint as seq, 0.0::double as ro, 0.0::double as pi from (select distinct mission_id from fx_imu)
      union all select j.mission_id, j.seq, 0.98 * (ro + gx * 0.01) + 0.02 * atan2(ay, az), 0.98 * (pi + gy * 0.01) + 0.02 * atan2(-ax, sqrt(ay * ay + az * az)) from s join fx_imu j on j.mission_id = s.mission_id and j.seq = s.seq + 1)
    select mission_id, seq, {r('ro')} as roll_rad, {r('pi')} as pitch_rad from s where seq > 0""",
)
def complementary_attitude(d):
    return rounded(est.complementary(d.fx_imu, 0.01), ["mission_id", "seq"], "roll_rad", "pitch_rad")


@query(
    "altitude_filter", ["fx_flight"],
    f"""with recursive s as (select mission_id, 0::bigint as seq, 0.0::double as h, 0.0::double as v, 10.0::double as a, 0.0::double as b, 10.0::double as d from (select distinct mission_id from fx_flight)
      union all select mission_id, seq, h2 + (a2 / (a2 + 2)) * (z - h2), v2 + (b2 / (a2 + 2)) * (z - h2), (1 - a2 / (a2 + 2)) * a2, (1 - a2 / (a2 + 2)) * b2, d2 - (b2 / (a2 + 2)) * b2
      from (select j.mission_id, j.seq, j.baro_altitude as z, h + v * 0.05 + 0.00125 * u as h2, v + 0.05 * u as v2, a + 0.1 * b + 0.0025 * d + 0.01 as a2, b + 0.05 * d as b2, d + 0.1 as d2
        from (select *, raw_accel_z - 9.80665 as u from fx_flight) j join s on j.mission_id = s.mission_id and j.seq = s.seq + 1) y)
    select mission_id, seq, {r('h')} as altitude_est, {r('v')} as velocity_est from s where seq > 0""",
)
def altitude_filter(d):
    df = d.fx_flight.withColumn("accel_up", c("raw_accel_z") - 9.80665)
    out = est.filter_altitude(df, 0.05, "accel_up", "baro_altitude")
    return rounded(out, ["mission_id", "seq"], "altitude_est", "velocity_est")


