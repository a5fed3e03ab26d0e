"""Ordered per-mission operators. All of them run on timeline slices, none needs a whole mission in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightloom import params as P
from flightloom.functions import attitude
from flightloom.operators.timeline import (
    join_on,
    FirstOf, Following, LastWhere, Previous, RowNumber, RunningMax, RunningSum, Streak, scan, with_preceding_rows,
)

BY = ["mission_id"]
ORDER = ["t", "seq"]
SLICE_S = 3600.0


def running_max(df: DataFrame, value: str = "baro_altitude", width: float = SLICE_S) -> DataFrame:
    """Highest altitude so far, never under zero."""
    return scan(df, BY, ORDER, [RunningMax("max_altitude", F.greatest(F.col(value), F.lit(0.0)))], width)


def _rate(value: str, first: Column) -> Column:
    dt = F.greatest(F.col("t") - F.col("_before.t"), F.lit(1e-3))
    return F.when(F.col("_before.t").isNull(), first).otherwise((F.col(value) - F.col("_before.v")) / dt)


def vertical_rate(
    df: DataFrame, value: str = "baro_altitude", logged: str | None = None, width: float = SLICE_S
) -> DataFrame:
    """Change of altitude per second; the first row keeps the logged value (0 without one)."""
    before = Previous("_before", F.struct(F.col("t").alias("t"), F.col(value).alias("v")))
    first = F.col(logged) if logged else F.lit(0.0)
    return scan(df, BY, ORDER, [before], width).withColumn("vertical_rate", _rate(value, first)).drop("_before")


def smoothed(
    df: DataFrame, by: list[str], order: list[str], value: Column, first: Column, alpha: float, out: str, width: float,
    block: int = 128,
) -> DataFrame:
    """Exponential smoothing s = (1 - alpha) s + alpha x, as a scan.

    A block of rows turns the incoming s into decay^n * s plus a sum of its own, so blocks are
    summed apart, the incoming values are chained over one row per block, and the rows are filled
    in from there. ``first`` is the value on a key's first row.
    """
    numbered = scan(df, by, order, [RowNumber("_n")], width).withColumn("_pos", F.col("_n") - 1)
    placed = numbered.withColumn("_x", F.when(F.col("_n") == 1, first).otherwise(value * alpha))
    return _faded_sum(placed, by, 1.0 - alpha, block, out).select(*df.columns, out)


def _faded_sum(df: DataFrame, by: list[str], decay: float, block: int, out: str) -> DataFrame:
    """Adds the sum over all rows j up to this one of _x[j] * decay^(_pos - j).

    A block of rows is summed apart, and what enters it is decay times this same sum over the ends of the blocks
    before it, with decay^block in place of decay: one level for every factor of ``block`` rows, until what
    enters a block has faded to exactly zero one block later. Weights inside a block stay within double range.
    """
    if decay == 0.0:
        return df.withColumn(out, F.col("_x"))
    size = max(1, min(block, int(-230.0 / math.log(decay))))
    k = F.col("_pos") % size
    placed = df.withColumn("_block", F.floor(F.col("_pos") / size).cast("bigint"))
    scaled = F.col("_x") / F.pow(F.lit(decay), k)
    here = Window.partitionBy(*by, "_block").orderBy("_pos")
    own = F.sum(scaled).over(here.rowsBetween(Window.unboundedPreceding, 0)) * F.pow(F.lit(decay), k)
    ends = placed.groupBy(*by, "_block").agg((F.sum(scaled) * F.lit(decay ** (size - 1))).alias("_x")).withColumnRenamed("_block", "_pos")
    after = decay**size
    faded = _faded_sum(ends, by, after, block, "_end") if size > 1 else ends.withColumn("_end", F.col("_x"))
    entering = faded.select(*by, (F.col("_pos") + 1).alias("_block"), F.col("_end").alias("_in"))
    joined = join_on(placed, entering, [*by, "_block"], "left")
    result = own + F.pow(F.lit(decay), k + 1) * F.coalesce("_in", F.lit(0.0))
    return joined.withColumn(out, result).drop("_block", "_in")


def smoothed_rate(df: DataFrame, alpha: float = P.RATE_ALPHA, width: float = SLICE_S) -> DataFrame:
    """Vertical rate smoothed from a start of zero."""
    rated = vertical_rate(df, width=width)
    return smoothed(rated, BY, ORDER, F.col("vertical_rate"), F.lit(0.0), alpha, "smoothed_rate", width)


def observed_hz(samples: DataFrame, by: list[str], width: float = SLICE_S) -> DataFrame:
    """Smoothed update frequency, 0.85 old + 0.15 new; the first interval counts in full."""
    before = scan(samples, by, ORDER, [Previous("_pt", F.col("t"))], width)
    intervals = before.filter(F.col("_pt").isNotNull()).withColumn(
        "instant_hz", 1.0 / F.greatest(F.col("t") - F.col("_pt"), F.lit(1e-6))
    )
    smooth = smoothed(intervals, by, ORDER, F.col("instant_hz"), F.col("instant_hz"), 0.15, "observed_hz", width)
    return smooth.drop("_pt")


def baro_window(df: DataFrame, rows: int = 10, drop_m: float = 5.0, width: float = SLICE_S) -> DataFrame:
    """Mean over the last ``rows`` samples and whether a full window ends lower than it began."""
    numbered = scan(df, BY, ORDER, [RowNumber("_n")], width)
    spread, here, own = with_preceding_rows(numbered, BY, "_n", rows - 1)
    frame = here.rowsBetween(-(rows - 1), 0)
    value = F.col("baro_altitude")
    falling = (F.count(value).over(frame) >= rows) & (value < F.first(value).over(frame) - drop_m)
    windowed = spread.select("*", F.avg(value).over(frame).alias("mean_altitude"), falling.alias("descending"))
    return windowed.filter(own).select(*df.columns, "mean_altitude", "descending")


def confirmed(df: DataFrame, cond: Column, n: int, width: float = SLICE_S) -> DataFrame:
    """How many rows in a row met the condition, and whether that reaches n."""
    return scan(df, BY, ORDER, [Streak("streak", cond=cond)], width).withColumn("confirmed", F.col("streak") >= n)


def persisted(df: DataFrame, cond: Column, seconds: float, width: float = SLICE_S) -> DataFrame:
    """Seconds the condition has held without a gap, and whether that reaches the limit."""
    flagged = scan(df.withColumn("_cond", F.coalesce(cond, F.lit(False))), BY, ORDER, [Previous("_pc", F.col("_cond"))], width)
    begun = F.col("_cond") & ~F.coalesce(F.col("_pc"), F.lit(False))
    steps = [LastWhere("_start", F.col("t"), begun)]
    held = scan(flagged, BY, ORDER, steps, width)
    out = F.when(F.col("_cond"), F.col("t") - F.col("_start"))
    return held.select(*df.columns, out.alias("held_s"), F.coalesce(out >= seconds, F.lit(False)).alias("persisted"))


def stale_status(samples: DataFrame, as_of: Column, timeout: Column | None = None) -> DataFrame:
    """Latest status per worker; a healthy or degraded one with no update for too long is STALE."""
    limit = timeout if timeout is not None else F.lit(P.STALE_S)
    latest = samples.groupBy("mission_id", "worker").agg(
        F.max(F.when(F.col("ok"), F.col("t"))).alias("last_update"),
        F.max_by(F.when(F.col("ok"), "HEALTHY").otherwise("FAILED"), F.struct("t", "seq")).alias("last_status"),
        F.max("t").alias("last_seen"),
    )
    age = as_of - F.col("last_update")
    stale = F.col("last_status").isin("HEALTHY", "DEGRADED") & (age > limit)
    return latest.withColumn("age_s", age).withColumn("status", F.when(stale, "STALE").otherwise(F.col("last_status")))


def worker_timeline(samples: DataFrame, width: float = SLICE_S) -> DataFrame:
    """Per sample: errors so far, errors in a row, and whether it is a recovery."""
    by = ["mission_id", "worker"]
    failed = ~F.col("ok")
    steps = [
        Previous("_prev_ok", F.col("ok")),
        RunningSum("errors_so_far", F.when(failed, 1).otherwise(0)),
        Streak("error_streak", cond=failed),
    ]
    out = scan(samples, by, ORDER, steps, width)
    recovered = F.col("ok") & ~F.coalesce(F.col("_prev_ok"), F.lit(True)) & (F.col("errors_so_far") > 0)
    return out.withColumn("errors_so_far", F.col("errors_so_far").cast("bigint")).withColumn("recovered", recovered).drop("_prev_ok")


def worker_states(
    samples: DataFrame, timeout: Column | float | None = None, until: Column | None = None, width: float = SLICE_S
) -> DataFrame:
    """What worker_timeline gives, for workers of more than two states, with a row wherever one falls silent.

    ``samples``: mission_id, worker, t, seq, ok (null: neither a success nor an error, as when a worker is disabled), error
    and, if there, ``status``, what the worker reported (null: HEALTHY on a success, FAILED on an error, no change otherwise).
    A HEALTHY or DEGRADED worker whose last success is more than ``timeout`` seconds ago gets a row of status STALE at the
    moment this happens, ``silent`` true and ``ok`` null; ``until`` is the time up to which the last row is held. Without a
    timeout only reported states count. A success is a recovery if the state before was FAILED, STALE or DEGRADED and any
    error came earlier. Rows without a clock come first and are never silent. Other columns are kept, null on silent rows
    but for mission_id, worker and seq (that of the row before the silence).
    """
    by = ["mission_id", "worker"]
    failed = F.coalesce(~F.col("ok"), F.lit(False))
    reported = F.col("status") if "status" in samples.columns else F.lit(None).cast("string")
    known = F.coalesce(reported, F.when(F.col("ok"), "HEALTHY").when(failed, "FAILED"))
    rows = samples.withColumn("status", known).withColumn("silent", F.lit(False))
    if timeout is not None:
        limit = timeout if isinstance(timeout, Column) else F.lit(float(timeout))
        rows = scan(
            rows.withColumn("_limit", limit), by, ORDER,
            [
                LastWhere("_state", F.col("status"), F.col("status").isNotNull()), LastWhere("_update", F.col("t"), F.col("ok")),
                Following("_next", F.col("t")),
            ],
            width,
        )
        over = F.coalesce(F.col("_next"), until) if until is not None else F.col("_next")
        due = F.greatest(F.col("_update") + F.col("_limit"), F.col("t"))
        # a row that reports nothing in a silence is behind the row where the silence began
        begins = F.col("status").isNotNull() | (F.col("t") - F.col("_update") <= F.col("_limit"))
        falls = F.col("_state").isin("HEALTHY", "DEGRADED") & (over - F.col("_update") > F.col("_limit")) & begins
        given = {"mission_id", "worker", "seq", "t", "status", "silent"}
        kinds = dict(rows.select(*samples.columns).dtypes)
        blank = [F.lit(None).cast(kinds[n]).alias(n) for n in samples.columns if n not in given]
        own = F.struct("t", F.col("status"), F.col("silent"), *[n for n in samples.columns if n not in given])
        event = F.struct(due.alias("t"), F.lit("STALE").alias("status"), F.lit(True).alias("silent"), *blank)
        both = F.filter(F.array(own, F.when(falls, event)), lambda x: x.isNotNull())
        rows = rows.select("mission_id", "worker", "seq", F.explode(both).alias("_e")).select("mission_id", "worker", "seq", "_e.*")
    steps = [
        LastWhere("_before", F.col("status"), F.col("status").isNotNull(), inclusive=False),
        LastWhere("_state", F.col("status"), F.col("status").isNotNull()),
        RunningSum("errors_so_far", F.when(failed, 1).otherwise(0)),
    ]
    seen = scan(rows, by, [*ORDER, "silent"], steps, width)
    seen = scan(seen, by, [*ORDER, "silent"], [LastWhere("_cleared", F.col("errors_so_far"), F.col("ok"))], width)
    errors = F.col("errors_so_far").cast("bigint")
    back = F.col("_before").isin("FAILED", "STALE", "DEGRADED") & (errors > 0)
    return seen.select(
        *[n for n in samples.columns if n != "status"], F.col("_state").alias("status"), "silent",
        F.col("_before").alias("previous_status"), errors.alias("errors_so_far"),
        (errors - F.coalesce(F.col("_cleared").cast("bigint"), F.lit(0))).alias("error_streak"),
        F.coalesce(F.col("ok") & back, F.lit(False)).alias("recovered"),
    )


def state_spans(states: DataFrame, until: Column | None = None, width: float = SLICE_S) -> DataFrame:
    """One row per unbroken state of a worker, from worker_states: status, from_s, to_s, rows.

    ``to_s`` is the start of the next state; the last one ends at ``until`` (null if not given).
    """
    by, order = ["mission_id", "worker"], [*ORDER, "silent"]
    begun = scan(states, by, order, [Previous("_was", F.col("status")), RowNumber("_k")], width)
    starts = (F.col("_k") == 1) | ~F.col("status").eqNullSafe(F.col("_was"))
    spans = scan(begun.withColumn("_start", starts), by, order, [RunningSum("_span", F.col("_start").cast("int"))], width)
    # a span may run over many slices: rows are counted, no row is held
    out = spans.groupBy(*by, "_span").agg(
        F.max_by("status", F.col("_start")).alias("status"), F.min("t").alias("from_s"),
        F.count_if(~F.col("silent")).alias("rows"),
    )
    along = scan(out, by, ["from_s", "_span"], [Following("_to", F.col("from_s"))], width)
    end = F.coalesce(F.col("_to"), until) if until is not None else F.col("_to")
    return along.select(*by, "status", "from_s", end.alias("to_s"), "rows")


def recoveries(samples: DataFrame, width: float = SLICE_S) -> DataFrame:
    return worker_timeline(samples, width).filter("recovered")


def error_streak(samples: DataFrame, width: float = SLICE_S) -> DataFrame:
    return worker_timeline(samples, width)


def changes(df: DataFrame, column: str, width: float = SLICE_S) -> DataFrame:
    """Rows where a value differs from the row before (a first row is no change)."""
    out = scan(df, BY, ORDER, [Previous("previous_value", F.col(column)), RowNumber("_n")], width)
    return out.filter((F.col("_n") > 1) & ~F.col(column).eqNullSafe(F.col("previous_value"))).drop("_n")


def state_intervals(df: DataFrame, state: str = "state", width: float = SLICE_S) -> DataFrame:
    """One row per stay in a state: from, to, entry time, leave time and duration."""
    marked = scan(
        df.select("mission_id", "seq", "t", F.col(state).alias("state")), BY, ORDER,
        [Previous("from_state", F.col("state")), FirstOf("_x", F.col("t"))], width,
    )
    entries = marked.filter(F.col("from_state").isNull() | (F.col("from_state") != F.col("state"))).drop("_x")
    last = df.groupBy("mission_id").agg(F.max("t").alias("_end"))
    closed = scan(entries, BY, ORDER, [Following("left_at", F.col("t"))], width).join(last, "mission_id")
    leave = F.coalesce(F.col("left_at"), F.col("_end"))
    return closed.select(
        "mission_id", "seq", "from_state", F.col("state").alias("to_state"), F.col("t").alias("entered_at"),
        leave.alias("left_at"), (leave - F.col("t")).alias("time_in_state"),
    )


def keep_last(df: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    """The newest n rows per key; Spark prunes to n rows per key before the shuffle."""
    newest = Window.partitionBy(*(by or BY)).orderBy(*[F.col(x).desc() for x in ORDER])
    return df.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= n).drop("_r")


def numbered(df: DataFrame, success: Column, width: float = SLICE_S) -> DataFrame:
    """Sequence number and running count of successes."""
    steps = [RowNumber("sequence"), RunningSum("successes", F.when(success, 1).otherwise(0))]
    return scan(df, BY, ORDER, steps, width).withColumn("successes", F.col("successes").cast("bigint"))


def latest_snapshot(
    slots: DataFrame, as_of: Column, magic: int = P.SNAPSHOT_MAGIC, schema: int = P.SNAPSHOT_SCHEMA,
    max_age_s: float = 300.0,
) -> DataFrame:
    """The newest valid, fresh version per mission; slot A wins a tie.

    Needs slot, magic, schema_version, version and saved_at.
    """
    age = as_of - F.col("saved_at")
    valid = (F.col("magic") == magic) & (F.col("schema_version") == schema)
    best = F.max_by(F.struct(*slots.columns), F.struct(F.col("version"), F.when(F.col("slot") == "A", 1).otherwise(0)))
    picked = slots.filter(valid).groupBy("mission_id").agg(best.alias("_b")).select("_b.*")
    return picked.withColumn("age_s", age).filter(F.col("age_s") <= max_age_s)


def guarded_dt(df: DataFrame, mode: str, low: float = P.MIN_DT_S, high: float = P.MAX_DT_S, width: float = SLICE_S) -> DataFrame:
    """Time step to the previous row: out-of-range steps are dropped (attitude) or clamped (navigation)."""
    dt = F.col("t") - F.col("_pt")
    if mode == "attitude":
        guarded = F.when(dt.between(low, high), dt)
    else:
        guarded = F.when(dt >= low, F.least(dt, F.lit(high)))
    return scan(df, BY, ORDER, [Previous("_pt", F.col("t"))], width).withColumn("dt", guarded).drop("_pt")


def overruns(df: DataFrame, budget_s: float, width: float = SLICE_S) -> DataFrame:
    """Loop iterations that took longer than the budget."""
    out = scan(df, BY, ORDER, [Previous("_pt", F.col("t"))], width).withColumn("loop_s", F.col("t") - F.col("_pt"))
    return out.filter(F.col("loop_s") > budget_s).drop("_pt")


def attitude_jumps(df: DataFrame, limit_deg: float = 120.0, width: float = SLICE_S) -> DataFrame:
    """Rows whose quaternion turned by more than the limit since the row before. Needs column q."""
    out = scan(df, BY, ORDER, [Previous("_pq", F.col("q"))], width)
    jump = F.degrees(attitude.q_angle_between(F.col("_pq"), F.col("q")))
    return out.filter(F.col("_pq").isNotNull()).withColumn("jump_deg", jump).drop("_pq").filter(F.col("jump_deg") > limit_deg)


def session_samples(df: DataFrame, sessions: DataFrame, width: float = SLICE_S) -> DataFrame:
    """Samples inside a session (start to stop, both included) with time since its start.

    Sessions of one mission do not overlap, so the newest start not after the sample decides.
    """
    from flightloom.operators.asof import backward

    matched = backward(
        df, sessions.select("mission_id", "session_id", "start_t", "stop_t"), BY, "t", "start_t",
        ["session_id", "start_t", "stop_t"], width, tie="seq",
    )
    return matched.filter(F.col("start_t").isNotNull() & (F.col("t") <= F.col("stop_t"))).withColumn(
        "session_time", F.col("t") - F.col("start_t")
    )


def resample_last(samples: DataFrame, value: str, step_s: float, width: float = SLICE_S) -> DataFrame:
    """Latest value at the end of every step of a fixed clock, carried over empty steps."""
    bucket = F.floor(F.col("t") / step_s).cast("bigint")
    held = samples.withColumn("tick", bucket).groupBy("mission_id", "tick").agg(
        F.max_by(value, F.struct(*ORDER)).alias("value")
    )
    ahead = scan(held, BY, ["tick"], [Following("_next", F.col("tick"))], max(1.0, width / step_s))
    last = F.coalesce(F.col("_next") - 1, F.col("tick"))
    filled = ahead.withColumn("at", F.explode(F.sequence("tick", last)))
    return filled.select("mission_id", F.col("at").alias("tick"), "value", (F.col("at") == F.col("tick")).alias("fresh"))
