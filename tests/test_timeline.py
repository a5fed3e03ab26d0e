"""Slices must not show: any width gives what one pass over the whole key gives."""

import math
import random

import pytest
from pyspark.sql import functions as F

from flightloom.operators import asof, windows
from flightloom.operators.quantiles import exact_quantiles, values_at
from flightloom.operators.timeline import (
    FirstOf, Following, LastWhere, NextWhere, Previous, RowNumber, RunningMax, RunningSum, Streak, Whole, scan,
    with_preceding_rows,
)


def rows(seed=1, n=160):
    rng = random.Random(seed)
    out = []
    for mission in (1, 2, 3):
        t = 0.0
        for seq in range(n if mission == 1 else 25):
            t += rng.choice([0.0, 0.5, 1.0, 7.0])
            out.append((mission, seq, t, rng.randint(-5, 5), rng.random() < 0.7))
    return out


def brute(data):
    out = {}
    for mission in {r[0] for r in data}:
        mine = sorted((r for r in data if r[0] == mission), key=lambda r: (r[2], r[1]))
        top, total, last, streak = None, 0, None, 0
        for i, (m, seq, t, v, ok) in enumerate(mine):
            top = v if top is None else max(top, v)
            total += v
            last = v if ok else last
            streak = streak + 1 if ok else 0
            ahead = next((x[3] for x in mine[i:] if x[4]), None)
            out[(m, seq)] = (
                mine[i - 1][3] if i else None, mine[i + 1][3] if i + 1 < len(mine) else None, top, total, i + 1, last,
                ahead, streak, sum(x[3] for x in mine), mine[0][3], len(mine),
            )
    return out


def test_every_step_agrees_with_brute_force_at_any_width(spark):
    data = rows()
    df = spark.createDataFrame(data, "mission_id long, seq long, t double, v long, ok boolean").repartition(5)
    steps = [
        Previous("a", F.col("v")), Following("b", F.col("v")), RunningMax("c", F.col("v")), RunningSum("d", F.col("v")),
        RowNumber("e"), LastWhere("f", F.col("v"), F.col("ok")), NextWhere("g", F.col("v"), F.col("ok")),
        Streak("h", cond=F.col("ok")), Whole("i", F.col("v")), FirstOf("j", F.col("v")), Whole("k", F.lit(1), "count"),
    ]
    want = brute(data)
    for width in (0.7, 3.0, 40.0, 1e9):
        got = scan(df, ["mission_id"], ["t", "seq"], steps, width).collect()
        assert len(got) == len(data)
        assert {(r.mission_id, r.seq): tuple(r[x] for x in "abcdefghijk") for r in got} == want, width


def test_preceding_rows_across_blocks(spark):
    df = spark.range(1, 101).select(F.lit(1).alias("m"), F.col("id").alias("n"))
    spread, window, own = with_preceding_rows(df, ["m"], "n", 9, block=7 * 2)
    got = spread.withColumn("s", F.sum("n").over(window.rowsBetween(-9, 0))).filter(own).select("n", "s")
    assert {r.n: r.s for r in got.collect()} == {n: sum(range(max(1, n - 9), n + 1)) for n in range(1, 101)}


def test_smoothing_over_many_blocks(spark):
    data = [(1, i, float(i), float((i * 37) % 11)) for i in range(700)]
    df = spark.createDataFrame(data, "mission_id long, seq long, t double, v double")
    out = windows.smoothed(df, ["mission_id"], ["t", "seq"], F.col("v"), F.col("v"), 0.15, "s", 50.0, block=16)
    s = None
    for row in sorted(out.collect(), key=lambda r: r.seq):
        s = row.v if s is None else 0.85 * s + 0.15 * row.v
        assert abs(row.s - s) < 1e-9


def test_nearest_takes_the_earlier_row_on_a_tie(spark):
    left = spark.createDataFrame([(1, 10.0, 1), (1, 100.0, 2)], "mission_id long, at double, seq long")
    right = spark.createDataFrame(
        [(1, 8.0, 5), (1, 12.0, 6), (1, 8.0, 7)], "mission_id long, t double, row_seq long"
    )
    for width in (1.0, 1e6):
        got = asof.nearest(left, right, ["mission_id"], "at", "t", ["row_seq"], width, "seq", "row_seq").collect()
        assert {r.seq: r.row_seq for r in got} == {1: 5, 2: 6}


def test_quantiles_are_exact_with_any_slicing(spark):
    import numpy as np

    values = [float((i * 7919) % 1013) / 7 for i in range(900)] + [3.0] * 300
    df = spark.createDataFrame([(v,) for v in values], "z double")
    want = np.percentile(values, [1, 50, 99])
    # one group over many ranges of values, beside groups of one row and one without a key
    keyed = df.withColumn("k", F.lit("a")).union(spark.createDataFrame([(5.0, "b"), (float("inf"), "c"), (1.0, None), (2.0, None)], "z double, k string"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        for adaptive, parts in (("true", 4), ("false", 7), ("false", 1)):
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            for rows in (exact_quantiles(keyed, ["k"], "z", {"a": 0.01, "b": 0.5, "c": 0.99}).collect(), exact_quantiles(df, [], "z", {"a": 0.01, "b": 0.5, "c": 0.99}).withColumn("k", F.lit("a")).collect()):
                got = {r.k: r for r in rows}
                assert got["a"].n == len(values) and all(abs(x - y) < 1e-9 for x, y in zip((got["a"].a, got["a"].b, got["a"].c), want))
            got = {r.k: (r.n, r.b) for r in exact_quantiles(keyed, ["k"], "z", {"b": 0.5}).collect()}
            assert got["b"] == (1, 5.0) and got[None] == (2, 1.5) and got["c"][0] == 1
            assert values_at(df, [], "z", {"p": 0.95}).first().p == sorted(values)[int(len(values) * 0.95)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert exact_quantiles(df.limit(0), [], "z", {"b": 0.5}).count() == 0


def test_null_keys_and_odd_clocks_keep_their_rows(spark):
    from flightloom.operators.timeline import RowNumber, scan

    data = [(None if k % 3 == 0 else k % 3, (None if k == 5 else float("nan") if k == 7 else float(k)), k) for k in range(30)]
    df = spark.createDataFrame(data, "m long, t double, seq long")
    for width in (1e9, 3.0):
        rows = scan(df, ["m"], ["t", "seq"], [RowNumber("n")], width).collect()
        assert len(rows) == 30
        for m in (None, 1, 2):
            mine = sorted((r for r in rows if r.m == m), key=lambda r: r.n)
            clock = [(r.t is not None, float("inf") if r.t is not None and r.t != r.t else r.t or 0.0, r.seq) for r in mine]
            assert [r.n for r in mine] == list(range(1, 11)) and clock == sorted(clock)


def test_frames_wider_than_a_block(spark):
    from flightloom.operators.timeline import with_preceding_rows

    df = spark.createDataFrame([(1, n) for n in range(1, 40)], "m long, n long")
    spread, window, own = with_preceding_rows(df, ["m"], "n", 9, block=4)
    got = {r.n: r.s for r in spread.withColumn("s", F.sum("n").over(window.rowsBetween(-9, 0))).filter(own).select("n", "s").collect()}
    assert got == {n: sum(range(max(1, n - 9), n + 1)) for n in range(1, 40)}


def test_smoothing_for_every_weight(spark):
    data = [(None if k % 2 else 7, float(k), k, math.sin(k) + 2) for k in range(600)]
    df = spark.createDataFrame(data, "mission_id long, t double, seq long, v double")
    for alpha in (1e-4, 0.35, 0.999, 1.0):
        out = windows.smoothed(df, ["mission_id"], ["t", "seq"], F.col("v"), F.col("v"), alpha, "s", 50.0, block=2)
        got = {r.seq: r.s for r in out.collect()}
        assert len(got) == 600
        for odd in (0, 1):
            s = None
            for k in range(odd, 600, 2):
                s = data[k][3] if s is None else (1 - alpha) * s + alpha * data[k][3]
                assert abs(got[k] - s) < 1e-9


def _walk_states(rows, timeout, until):
    """Worker states by one pass over the rows of one worker."""
    out, state, update, errors, streak = [], None, None, 0, 0
    for i, (t, seq, ok, status) in enumerate(rows):
        before = state
        state = status or ({True: "HEALTHY", False: "FAILED"}.get(ok, state))
        errors, streak = errors + (ok is False), 0 if ok else streak + (ok is False)
        update = t if ok else update
        out.append((t, seq, False, state, before, errors, streak, bool(ok and before in ("FAILED", "STALE", "DEGRADED") and errors)))
        end = rows[i + 1][0] if i + 1 < len(rows) else until
        if state in ("HEALTHY", "DEGRADED") and update is not None and end - update > timeout:
            out.append((max(update + timeout, t), seq, True, "STALE", state, errors, streak, False))
            state = "STALE"
    return out


@pytest.mark.parametrize("width", [0.7, 4.0, 1e6])
def test_worker_states_equal_one_pass(spark, width):
    rng = random.Random(11)
    kinds = [(True, None), (True, "DEGRADED"), (False, None), (False, "DEGRADED"), (None, "DISABLED"), (None, None), (True, "INITIALIZING")]
    given, want, spans = [], [], []
    for worker in ("GPS", "IMU", None):
        t, rows = 0.0, []
        for seq in range(80):
            t += rng.choice([0.0, 0.25, 0.5, 1.0, 2.0, 3.5])
            rows.append((t, seq, *rng.choice(kinds)))
        given += [(1, worker, *row) for row in rows]
        states = _walk_states(rows, 1.5, t + 2)
        want += [(worker, *row) for row in states]
        cut = [i for i, row in enumerate(states) if i == 0 or row[3] != states[i - 1][3]]
        for a, b in zip(cut, [*cut[1:], None]):
            spans.append((worker, states[a][3], states[a][0], states[b][0] if b else 500.0, sum(not row[2] for row in states[a:b])))
    df = spark.createDataFrame(given, "mission_id long, worker string, t double, seq long, ok boolean, status string").withColumn("error", F.lit("e"))
    last = df.groupBy("worker").agg(F.max("t").alias("over"))
    df = df.join(last, df.worker.eqNullSafe(last.worker)).select(df["*"], (F.col("over") + 2).alias("over"))
    got = windows.worker_states(df, 1.5, F.col("over"), width)
    assert sorted(map(str, want)) == sorted(
        str(tuple(r)) for r in got.select("worker", "t", "seq", "silent", "status", "previous_status", "errors_so_far", "error_streak", "recovered").collect()
    )
    runs = windows.state_spans(got, F.lit(500.0), width).select("worker", "status", "from_s", "to_s", "rows").collect()
    assert sorted(map(str, spans)) == sorted(str(tuple(r)) for r in runs)


def test_worker_states_without_timeout(spark):
    rows = [(1, "GPS", 0.0, 1, False, "boom"), (1, "GPS", 99.0, 2, True, ""), (1, "GPS", 500.0, 3, True, "")]
    df = spark.createDataFrame(rows, "mission_id long, worker string, t double, seq long, ok boolean, error string")
    got = windows.worker_states(df).orderBy("seq").collect()
    assert [(r.status, r.recovered, r.error_streak) for r in got] == [("FAILED", False, 1), ("HEALTHY", True, 0), ("HEALTHY", False, 0)]
    assert windows.worker_states(df.limit(0), 3.0).count() == 0
