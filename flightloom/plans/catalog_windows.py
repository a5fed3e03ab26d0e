"""Queries: ordered per-mission operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from flightloom.functions import attitude as att
from flightloom.operators import windows as w
from flightloom.plans.registry import query
from flightloom.plans.sqltext import r

c = F.col
OVER = "over (partition by mission_id order by t, seq)"


def rounded(df, keys, *names):
    return df.select(*keys, *[F.round(n, 6).alias(n) for n in names])


@query(
    "running_max_and_rate",
    ["fx_flight"],
    f"""select mission_id, seq, max(greatest(baro_altitude, 0)) {OVER} as max_altitude,
      {r(f"coalesce((baro_altitude - lag(baro_altitude) {OVER}) / greatest(t - lag(t) {OVER}, 1e-3), 0)")} as vertical_rate
    from fx_flight""",
)
def running_max_and_rate(d):
    df = w.vertical_rate(w.running_max(d.fx_flight))
    return rounded(df, ["mission_id", "seq", "max_altitude"], "vertical_rate")


@query(
    "smoothed_rate",
    ["fx_flight"],
    f"""with recursive rated as (select mission_id, seq, coalesce((baro_altitude - lag(baro_altitude) {OVER}) / greatest(t - lag(t) {OVER}, 1e-3), 0) as v from fx_flight),
    s as (select mission_id, seq, 0.0::double as s from rated where seq = 1
      union all select x.mission_id, x.seq, 0.35 * x.v + 0.65 * s.s from s join rated x on x.mission_id = s.mission_id and x.seq = s.seq + 1)
    select mission_id, seq, {r('s + 1e-9')} as smoothed_rate from s""",
)
def smoothed_rate(d):
    # a hair off, so that sums taken in another order do not fall on the other side of a rounding tie
    out = w.smoothed_rate(d.fx_flight).withColumn("smoothed_rate", c("smoothed_rate") + 1e-9)
    return rounded(out, ["mission_id", "seq"], "smoothed_rate")


@query(
    "observed_hz",
    ["fx_worker"],
    f"""with recursive o as (select mission_id, worker, t, row_number() over (partition by mission_id, worker order by t, seq) as k,
        1 / greatest(t - lag(t) over (partition by mission_id, worker order by t, seq), 1e-6) as hz from fx_worker),
    s as (select mission_id, worker, k, t, hz as s from o where k = 2
      union all select o.mission_id, o.worker, o.k, o.t, 0.85 * s.s + 0.15 * o.hz from s join o on o.mission_id = s.mission_id and o.worker = s.worker and o.k = s.k + 1)
    select mission_id, worker, t, {r('s + 1e-9')} as observed_hz from s""",
)
def observed_hz(d):
    out = w.observed_hz(d.fx_worker, ["mission_id", "worker"])
    out = out.withColumn("observed_hz", c("observed_hz") + 1e-9)
    return rounded(out, ["mission_id", "worker", "t"], "observed_hz")


@query(
    "baro_window",
    ["fx_flight"],
    f"""select mission_id, seq, {r('avg(baro_altitude) over f')} as mean_altitude,
      count(*) over f >= 10 and baro_altitude < first(baro_altitude) over f - 5 as descending
    from fx_flight window f as (partition by mission_id order by t, seq rows between 9 preceding and current row)""",
)
def baro_window(d):
    return rounded(w.baro_window(d.fx_flight), ["mission_id", "seq", "descending"], "mean_altitude")


@query(
    "confirmation_streaks",
    ["fx_flight"],
    """with a as (select *, baro_altitude > 300 as ok, sum(case when baro_altitude > 300 then 0 else 1 end) over (partition by mission_id order by t, seq) as g from fx_flight),
    b as (select *, row_number() over (partition by mission_id, g order by t, seq) - case when g > 0 then 1 else 0 end as k from a)
    select mission_id, seq, cast(case when ok then k else 0 end as bigint) as streak, (case when ok then k else 0 end) >= 5 as confirmed from b""",
)
def confirmation_streaks(d):
    return w.confirmed(d.fx_flight, c("baro_altitude") > 300, 5).select("mission_id", "seq", "streak", "confirmed")


@query(
    "time_persistence",
    ["fx_flight"],
    """with a as (select *, baro_altitude > 300 as ok, sum(case when baro_altitude > 300 then 0 else 1 end) over (partition by mission_id order by t, seq) as g from fx_flight)
    select mission_id, seq, case when ok then t - min(case when ok then t end) over (partition by mission_id, g) end as held_s,
      coalesce(case when ok then t - min(case when ok then t end) over (partition by mission_id, g) end >= 5, false) as persisted from a""",
)
def time_persistence(d):
    return w.persisted(d.fx_flight, c("baro_altitude") > 300, 5.0).select("mission_id", "seq", "held_s", "persisted")


@query(
    "stale_workers",
    ["fx_worker"],
    """with l as (select mission_id, worker, max(case when ok then t end) as last_update, last(case when ok then 'HEALTHY' else 'FAILED' end order by t, seq) as last_status from fx_worker group by all)
    select mission_id, worker, last_update, 70 - last_update as age_s,
      case when last_status = 'HEALTHY' and 70 - last_update > 3 then 'STALE' else last_status end as status from l""",
)
def stale_workers(d):
    return w.stale_status(d.fx_worker, F.lit(70.0)).select("mission_id", "worker", "last_update", "age_s", "status")


@query(
    "worker_timeline",
    ["fx_worker"],
    """with a as (select *, lag(ok) over p as po, sum(case when ok then 0 else 1 end) over p as errs, sum(case when ok then 1 else 0 end) over p as g from fx_worker window p as (partition by mission_id, worker order by t, seq)),
    b as (select *, sum(case when ok then 0 else 1 end) over (partition by mission_id, worker, g order by t, seq) as streak from a)
    select mission_id, worker, seq, cast(errs as bigint) as errors_so_far, cast(streak as bigint) as error_streak,
      ok and not coalesce(po, true) and errs > 0 as recovered from b""",
)
def worker_timeline(d):
    return w.worker_timeline(d.fx_worker).select(
        "mission_id", "worker", "seq", "errors_so_far", "error_streak", "recovered"
    )


# Workers that report four states, a timeout for each worker, all watched until second 70.
REPORTED = """src as (select mission_id, worker, seq, t, error, case when seq % 11 = 0 then null else ok end as ok, case worker when 'click' then 2.0::double else 5.0::double end as lim,
      case when seq % 11 = 0 then 'DISABLED' when ok and seq % 4 = 0 then 'DEGRADED' when not ok and error = 'err2' then 'DEGRADED' when ok then 'HEALTHY' else 'FAILED' end as st from fx_worker),
    held as (select *, max(case when ok then t end) over (partition by mission_id, worker order by t, seq) as upd, lead(t) over (partition by mission_id, worker order by t, seq) as nxt from src),
    merged as (select mission_id, worker, seq, t, ok, error, st, false as silent from held
      union all select mission_id, worker, seq, greatest(upd + lim, t), null, null, 'STALE', true from held where st in ('HEALTHY', 'DEGRADED') and coalesce(nxt, 70) - upd > lim),
    walked as (select *, lag(st) over p as before, count(*) filter (where not ok) over p as errs, count(*) filter (where ok) over p as g from merged window p as (partition by mission_id, worker order by t, seq, silent)),
    states as (select *, count(*) filter (where not ok) over (partition by mission_id, worker, g order by t, seq, silent) as streak,
      coalesce(ok and before in ('FAILED', 'STALE', 'DEGRADED') and errs > 0, false) as recovered from walked)"""


def reported_states(d):
    off = c("seq") % 11 == 0
    status = F.when(off, "DISABLED").when(c("ok") & (c("seq") % 4 == 0), "DEGRADED").when(~c("ok") & (c("error") == "err2"), "DEGRADED")
    samples = d.fx_worker.select("mission_id", "worker", "seq", "t", F.when(~off, c("ok")).alias("ok"), "error", status.alias("status"))
    return w.worker_states(samples, F.when(c("worker") == "click", 2.0).otherwise(5.0), F.lit(70.0))


@query(
    "worker_states",
    ["fx_worker"],
    f"with {REPORTED} select mission_id, worker, seq, t, silent, st as status, before as previous_status, errs as errors_so_far, streak as error_streak, recovered from states",
)
def worker_states(d):
    return reported_states(d).select(
        "mission_id", "worker", "seq", "t", "silent", "status", "previous_status", "errors_so_far", "error_streak", "recovered"
    )


@query(
    "worker_state_spans",
    ["fx_worker"],
    f"""with {REPORTED}, cut as (select *, sum(case when st is distinct from before then 1 else 0 end) over (partition by mission_id, worker order by t, seq, silent) as k from states),
    spans as (select mission_id, worker, k, any_value(st) as status, min(t) as from_s, count(*) filter (where not silent) as rows from cut group by 1, 2, 3)
    select mission_id, worker, status, from_s, coalesce(lead(from_s) over (partition by mission_id, worker order by k), 70) as to_s, rows from spans""",
)
def worker_state_spans(d):
    return w.state_spans(reported_states(d), F.lit(70.0))


@query(
    "value_changes",
    ["fx_worker"],
    """select mission_id, seq, worker, previous_value from (select *, lag(worker) over (partition by mission_id order by t, seq) as previous_value, row_number() over (partition by mission_id order by t, seq) as k from fx_worker)
    where k > 1 and worker is distinct from previous_value""",
)
def value_changes(d):
    return w.changes(d.fx_worker, "worker").select("mission_id", "seq", "worker", "previous_value")


STATES_SQL = """st as (select mission_id, seq, t, case when raw_accel_z > 20 then 'BOOST' when baro_altitude > 600 then 'COAST' when baro_altitude > 0 then 'DESCENT' else 'ARMED_PAD' end as state from fx_flight),
    en as (select * from (select *, lag(state) over (partition by mission_id order by t, seq) as from_state from st) where from_state is null or from_state <> state),
    iv as (select mission_id, seq, from_state, state as to_state, t as entered_at,
      coalesce(lead(t) over (partition by mission_id order by t, seq), (select max(t) from st z where z.mission_id = en.mission_id)) as left_at from en)"""


def states(d):
    alt = c("baro_altitude")
    state = F.when(c("raw_accel_z") > 20, "BOOST").when(alt > 600, "COAST").when(alt > 0, "DESCENT").otherwise("ARMED_PAD")
    return d.fx_flight.withColumn("state", state)


@query(
    "state_intervals",
    ["fx_flight"],
    f"with {STATES_SQL} select mission_id, from_state, to_state, entered_at, left_at, left_at - entered_at as time_in_state from iv",
)
def state_intervals(d):
    return w.state_intervals(states(d)).select(
        "mission_id", "from_state", "to_state", "entered_at", "left_at", "time_in_state"
    )


@query(
    "keep_last_events",
    ["fx_event"],
    "select mission_id, seq, severity from fx_event qualify row_number() over (partition by mission_id order by t desc, seq desc) <= 20",
)
def keep_last_events(d):
    return w.keep_last(d.fx_event, 20).select("mission_id", "seq", "severity")


@query(
    "sequence_numbers",
    ["fx_worker"],
    f"select mission_id, seq, row_number() {OVER} as sequence, cast(sum(case when ok then 1 else 0 end) {OVER} as bigint) as successes from fx_worker",
)
def sequence_numbers(d):
    return w.numbered(d.fx_worker, c("ok")).select("mission_id", "seq", "sequence", "successes")


@query(
    "latest_snapshot",
    ["fx_base"],
    """with s as (select mission_id, seq, case when seq % 2 = 0 then 'A' else 'B' end as slot, case when event_id % 7 = 0 then 1 else 3735884340 end as magic,
        case when event_id % 11 = 0 then 1 else 2 end as sv, cast(floor((seq + 1) / 2) as bigint) as version, cast(seq as double) * 10 as saved_at from fx_base),
    p as (select * from s where magic = 3735884340 and sv = 2 qualify row_number() over (partition by mission_id order by version desc, (slot = 'A') desc) = 1)
    select mission_id, slot, version, 800 - saved_at as age_s from p where 800 - saved_at <= 300""",
)
def latest_snapshot(d):
    slots = d.fx_base.select(
        "mission_id", F.when(c("seq") % 2 == 0, "A").otherwise("B").alias("slot"),
        F.when(c("event_id") % 7 == 0, 1).otherwise(0xDEAD1234).alias("magic"),
        F.when(c("event_id") % 11 == 0, 1).otherwise(2).alias("schema_version"),
        F.floor((c("seq") + 1) / 2).alias("version"), (c("seq") * 10.0).alias("saved_at"),
    )
    return w.latest_snapshot(slots, F.lit(800.0)).select("mission_id", "slot", "version", "age_s")


@query(
    "guarded_steps",
    ["fx_capture"],
    f"""with g as (select mission_id, seq, t * 0.05 * (1 + event_id % 3) as t from fx_capture),
    p as (select mission_id, seq, t, t - lag(t) {OVER} as dt from g)
    select mission_id, seq, {r('case when dt between 0.001 and 0.25 then dt end')} as attitude_dt,
      {r('case when dt >= 0.001 then least(dt, 0.25) end')} as navigation_dt from p""",
)
def guarded_steps(d):
    # ordered by t, so the uneven clock has to be put in order first
    df = d.fx_capture.select("mission_id", "seq", (c("t") * 0.05 * (1 + c("event_id") % 3)).alias("t"))
    a = w.guarded_dt(df, "attitude").withColumnRenamed("dt", "attitude_dt")
    both = w.guarded_dt(a, "navigation").withColumnRenamed("dt", "navigation_dt")
    return rounded(both, ["mission_id", "seq"], "attitude_dt", "navigation_dt")


@query(
    "loop_overruns",
    ["fx_base"],
    "select mission_id, seq, epoch_us(ts) / 1000000.0::double - lag(epoch_us(ts) / 1000000.0::double) over (partition by mission_id order by seq) > 40000 as late from fx_base qualify late",
)
def loop_overruns(d):
    from flightloom.functions.values import epoch_seconds

    df = d.fx_base.withColumn("t", epoch_seconds(c("ts")))
    out = w.overruns(df, 40000.0, width=86400.0)
    return out.select("mission_id", "seq", (c("loop_s") > 40000.0).alias("late"))


@query(
    "attitude_jumps",
    ["fx_capture"],
    f"""with q as (select mission_id, seq, t, radians(yaw * 0.97 / 2) as h from fx_capture),
    p as (select *, lag(h) {OVER} as ph from q)
    select mission_id, seq, {r('degrees(2 * acos(least(1, abs(cos(h) * cos(ph) + sin(h) * sin(ph)))))', 3)} as jump_deg from p
    where degrees(2 * acos(least(1, abs(cos(h) * cos(ph) + sin(h) * sin(ph))))) > 120""",
)
def attitude_jumps(d):
    zero = F.lit(0.0)
    df = d.fx_capture.withColumn("q", att.q_from_euler(zero, zero, c("yaw") * 0.97))
    return w.attitude_jumps(df).select("mission_id", "seq", F.round("jump_deg", 3).alias("jump_deg"))


@query(
    "session_samples",
    ["fx_capture"],
    """with s as (select mission_id, seq as session_id, t + 1 as start_t, t + 13 as stop_t from fx_capture where seq % 10 = 0)
    select c.mission_id, c.seq, s.session_id, c.t - s.start_t as session_time from fx_capture c join s on s.mission_id = c.mission_id and c.t >= s.start_t and c.t <= s.stop_t""",
)
def session_samples(d):
    cap = d.fx_capture
    sessions = cap.filter(c("seq") % 10 == 0).select(
        "mission_id", c("seq").alias("session_id"), (c("t") + 1).alias("start_t"), (c("t") + 13).alias("stop_t")
    )
    out = w.session_samples(cap.select("mission_id", "seq", "t"), sessions)
    return out.select("mission_id", "seq", "session_id", "session_time")


@query(
    "resampled_values",
    ["fx_event"],
    """with b as (select mission_id, cast(floor(t / 0.5) as bigint) as tick, last(severity order by t, seq) as value from fx_event group by all),
    n as (select *, lead(tick) over (partition by mission_id order by tick) as nx from b),
    f as (select mission_id, tick as at0, value, unnest(range(tick, coalesce(nx, tick + 1))) as tick from n)
    select mission_id, tick, value, at0 = tick as fresh from f""",
)
def resampled_values(d):
    return w.resample_last(d.fx_event, "severity", 0.5)
