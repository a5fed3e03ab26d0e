"""Folds: slicing must not change a result, and known sequences give known answers."""

import math
import random

import pytest

from pyspark.sql import functions as F

from flightloom.operators import estimators as est
from flightloom.operators import steps
from flightloom.operators.fold import ordered_fold
from flightloom.operators.pointers import reached
from flightloom.streaming import streams


def test_slices_give_the_result_of_one_pass(spark, tables):
    fixes = tables.fx_gps
    whole = {(r.mission_id, r.seq): r.reason for r in est.validate_gps(fixes).collect()}
    cut = {(r.mission_id, r.seq): r.reason for r in est.validate_gps(fixes, width=4.0).collect()}
    assert whole == cut and len(whole) == 1000


def test_sliced_phases_equal_whole_phases(spark, tables):
    df = tables.fx_flight.withColumn("raw_accel_x", F.lit(0.0)).withColumn("raw_accel_y", F.lit(0.0)).filter("mission_id < 4")
    whole = {(r.mission_id, r.seq): r.phase for r in est.flight_phases(df).collect()}
    cut = {(r.mission_id, r.seq): r.phase for r in est.flight_phases(df, width=20.0).collect()}
    assert whole == cut and "LANDED" in whole.values()


def test_fold_runs_steps_in_order(spark):
    data = [(1, i, float(i // 2)) for i in range(60)]
    df = spark.createDataFrame(data, "mission_id long, seq long, t double")
    for width in (3.0, 1e9):
        got = ordered_fold(df, ["mission_id"], ["t", "seq"], ["t"], steps.Debounce(2.0), ["seq", "t"], width).filter("kept").collect()
        assert sorted(r.seq for r in got) == list(range(0, 60, 4))


def run(fold, rows):
    state, out = fold.start(), []
    for row in rows:
        state, result = fold.step(state, row)
        out.append(result)
    return out


def test_gps_reasons():
    check = steps.GpsCheck(250.0, 120.0)
    s = 1_000_000_000
    # a degree of latitude is about 111 km; the last fix is accepted again 1.5 s after the first one
    rows = [
        (None, 40 * s, -33.1, 150.2), ("GPS_BAD_HDOP", 41 * s, -33.1, 150.2), (None, 41 * s, -33.1, 150.2 + 0.004), (None, 41 * s, -33.1 + 0.0015, 150.2),
        (None, 40 * s, -33.1, 150.2), (None, 39 * s, -33.1, 150.2), (None, 41 * s + s // 2, -33.1 + 0.0005, 150.2),
    ]
    assert [r[0] for r in run(check, rows)] == [
        "GPS_VALID", "GPS_BAD_HDOP", "GPS_ABSOLUTE_JUMP", "GPS_IMPLIED_SPEED_IMPLAUSIBLE", "GPS_DUPLICATE_TIMESTAMP", "GPS_TIMESTAMP_REGRESSED", "GPS_VALID",
    ]


def heights(seed):
    """A made-up flight: hard push, free rise that fades out, slow fall, rest; some samples are noise."""
    rng = random.Random(seed)
    up = [18.0 * k for k in range(5)] + [90.0 + 40.0 * k for k in range(30)] + [1400.0 - 0.2 * (k - 12) ** 2 for k in range(25)]
    down = [max(1360.0 - 11.0 * k, 0.0) for k in range(124)] + [0.0] * rng.randint(0, 80)
    wait = [rng.choice([0.0, 0.0, 0.0, 31.0]) for _ in range(rng.randint(0, 40))]
    return [h + rng.choice([0.0, 0.0, 0.0, 2.5]) for h in wait + up + down]


@pytest.mark.parametrize("params", [{"max_flight_s": 60.0}, {"boost_s": 1.0, "apogee_backup_s": 9.0, "landing_s": 1.0, "settle_s": 0.0}])
def test_phases_of_the_table_equal_the_phases_row_by_row(spark, params):
    p = {**est.PHASE_PARAMS, **params}
    data, want = [], {}
    for mission in range(6):
        machine, state = streams._PhaseStep(p), None
        state = machine.start()
        for k, h in enumerate(heights(mission)):
            g = 3.1 if k < 50 and h > 60 else 0.9
            data.append((mission, k, k * 0.25, h, 0.0, 0.0, g * 9.80665))
            state, out = machine.step(state, (k * 0.25, h, g))
            want[mission, k] = out
    df = spark.createDataFrame(data, "mission_id long, seq long, t double, baro_altitude double, raw_accel_x double, raw_accel_y double, raw_accel_z double")
    got = {(r.mission_id, r.seq): (r.phase, r.entered, r.phase_reason) for r in est.flight_phases(df, params, width=7.0).collect()}
    assert got == want and {"BOOST", "COAST"} <= {v[0] for v in want.values()}


def test_debounce_keeps_what_one_pass_keeps(spark):
    rng = random.Random(4)
    data = []
    for key in (None, 1, 2):
        t = 0.0
        for i in range(400):
            t += rng.choice([0.0, 0.1, 0.1, 0.2, 0.3, 1.0, 2.0, 3.5] if key != 2 else [0.1])
            data.append((key, "s", "E", None if i % 2 else "m", i, round(t, 1)))
    data.append((1, "s", "E", "m", 999, None))
    want, last = [], {}
    for r in sorted((r for r in data if r[5] is not None), key=lambda r: (r[5], r[4])):
        key = (r[0], r[3])
        if key not in last or r[5] - last[key] >= 2.0:
            last[key] = r[5]
            want.append((str(r[0]), r[4]))
    df = spark.createDataFrame(data, "mission_id long, source string, event_code string, message string, seq long, t double")
    for width in (1e9, 5.0):
        got = [(str(r.mission_id), r.seq) for r in est.debounce(df, 2.0, width).collect()]
        assert sorted(got) == sorted([*want, ("1", 999)])


def filtered(rows, dt, seed=None):
    """Altitude and speed one row after the other, from (accel, baro, gps, altitude to restart from, its speed)."""
    x, p = ([0.0, 0.0], [10.0, 0.0, 10.0]) if seed is None else (list(seed), [25.0, 0.0, 4.0])
    out = []
    for accel, baro, gps, again, speed in rows:
        if again is not None:
            x, p = [again, speed or 0.0], [25.0, 0.0, 4.0]
        u = accel or 0.0
        x = [x[0] + dt * x[1] + 0.5 * dt * dt * u, x[1] + dt * u]
        p = [p[0] + 2 * dt * p[1] + dt * dt * p[2] + 0.01, p[1] + dt * p[2], p[2] + 0.1]
        for seen, var in ((baro, 2.0), (gps, 5.0)):
            if seen is not None:
                total, miss = p[0] + var, seen - x[0]
                x = [x[0] + p[0] / total * miss, x[1] + p[1] / total * miss]
                p = [p[0] * var / total, p[1] * var / total, p[2] - p[1] * p[1] / total]
        out.append(tuple(x))
    return out


def test_filters_equal_their_recursions(spark):
    rng = random.Random(8)
    missions = {}
    for mission, n in ((None, 1), (1, 300), (2, 40)):
        missions[mission] = [
            (rng.gauss(0, 3) if rng.random() > 0.1 else None, 100 + rng.gauss(0, 1) if rng.random() > 0.6 else None, 101 + rng.gauss(0, 2) if rng.random() > 0.9 else None,
             50.0 if mission == 1 and k in (100, 250) else None, -2.0 if k == 100 else None)
            for k in range(n)
        ]
    data = [(m, k, k * 0.05, *r) for m, rows in missions.items() for k, r in enumerate(rows)]
    df = spark.createDataFrame(data, "mission_id long, seq long, t double, a double, b double, g double, r double, s double")
    for seed in ((80.0, 1.0),):
        found = est.filter_altitude(df, 0.05, "a", "b", "g", width=4.0, seed=seed, reseed=("r", "s")).collect()
        got = {(r.mission_id, r.seq): (r.altitude_est, r.velocity_est) for r in found}
        want = {(m, k): v for m, rows in missions.items() for k, v in enumerate(filtered(rows, 0.05, seed))}
        assert got.keys() == want.keys()
        assert max(abs(a - b) for key in want for a, b in zip(got[key], want[key])) < 1e-9

    imu = [(1, k, k * 10_000_000, *(rng.gauss(0, 1) if rng.random() > 0.05 else None for _ in range(6))) for k in range(500)]
    df = spark.createDataFrame(imu, "mission_id long, seq long, ts_ns long, ax double, ay double, az double, gx double, gy double, gz double")
    roll, pitch, want = 0.0, 0.0, {}
    for _, k, _, ax, ay, az, gx, gy, _ in imu:
        alpha = [1.0 if None in (ax, ay, az) else 0.98] * 2
        roll = alpha[0] * (roll + (gx or 0.0) * 0.01) + (0.0 if alpha[0] == 1.0 else 0.02 * math.atan2(ay, az))
        pitch = alpha[1] * (pitch + (gy or 0.0) * 0.01) + (0.0 if alpha[1] == 1.0 else 0.02 * math.atan2(-ax, math.hypot(ay, az)))
        want[k] = (roll, pitch)
    for r in est.complementary(df, 0.01, width=0.5).collect():
        assert abs(r.roll_rad - want[r.seq][0]) < 1e-9 and abs(r.pitch_rad - want[r.seq][1]) < 1e-9


def test_pointers_reach_the_end_of_long_chains(spark):
    n = 500
    steps_ = spark.range(n).selectExpr("id", "id + 2 as to")
    got = {r.id for r in reached(spark.createDataFrame([(0,), (301,)], "id long"), steps_).collect()}
    assert got == set(range(0, n + 2, 2)) | set(range(301, n + 2, 2))


def test_no_row_of_a_null_key_is_lost(spark):
    data = [(None if k % 2 else 1, None if k % 3 == 0 else "m", k, float(k)) for k in range(40)]
    df = spark.createDataFrame(data, "mission_id long, message string, seq long, t double")
    want = None
    for width in (1e9, 4.0):
        rows = ordered_fold(df, ["mission_id", "message"], ["t", "seq"], ["t"], steps.Debounce(5.0), ["mission_id", "message", "seq"], width).collect()
        got = sorted((r.seq, r.kept) for r in rows)
        assert len(got) == 40 and (want is None or got == want)
        want = got
