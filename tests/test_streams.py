"""Streams whose rows arrive out of order or late, and state that is forgotten."""

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from flightloom.operators import estimators as est
from flightloom.streaming import streams

KEYS = "mission_id long, source string, event_code string, message string, seq long, t double"


def in_parts(spark, rows, schema, folder, order, parts=3, closing=1e6):
    """Rows as micro-batches in the order given, then a last row far ahead."""
    size = -(-len(rows) // parts)
    for a in range(0, len(rows), size):
        spark.createDataFrame(rows[a : a + size], schema).coalesce(1).write.mode("append").parquet(folder)
    names = [part.split()[0] for part in schema.split(", ")]
    spark.createDataFrame([tuple(closing if n == order else None for n in names)], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def shuffled_within(rows, at, reach, seed=3):
    """Rows moved by less than ``reach`` in their order."""
    rng = random.Random(seed)
    return sorted(rows, key=lambda r: r[at] + rng.uniform(0, reach))


def test_debounced_events_that_arrive_out_of_order(spark, tmp_path):
    rows = [(None if i % 5 == 0 else i % 2, "gps", "E", None if i % 3 else "m", i, 0.7 * i) for i in range(120)]
    batch = est.debounce(spark.createDataFrame(rows, KEYS)).select("seq").collect()
    stream = in_parts(spark, shuffled_within(rows, 5, 20.0), KEYS, str(tmp_path / "in"), "t")
    out = streams.drain(streams.debounce_stream(stream, delay="30 seconds")).select("seq").collect()
    assert sorted(r.seq for r in out) == sorted(r.seq for r in batch) and len(out) > 20


def test_phases_of_samples_that_arrive_out_of_order(spark, tables, tmp_path):
    df = tables.fx_flight.filter("mission_id < 3").withColumn("raw_accel_x", F.lit(0.0)).withColumn("raw_accel_y", F.lit(0.0))
    want = {(r.mission_id, r.seq): (r.phase, r.phase_reason) for r in est.flight_phases(df).collect()}
    names = ["mission_id", "seq", "t", "baro_altitude", "raw_accel_x", "raw_accel_y", "raw_accel_z"]
    rows = shuffled_within([tuple(r[n] for n in names) for r in df.collect()], 2, 9.0)
    schema = "mission_id long, seq long, t double, baro_altitude double, raw_accel_x double, raw_accel_y double, raw_accel_z double"
    out = streams.drain(streams.flight_phase_stream(in_parts(spark, rows, schema, str(tmp_path / "in"), "t"), delay="20 seconds"))
    assert {(r.mission_id, r.seq): (r.phase, r.phase_reason) for r in out.collect()} == want


def test_fixes_and_captures_that_arrive_out_of_order(spark, tables, tmp_path):
    fixes = tables.fx_gps.filter("mission_id < 4")
    want = {(r.mission_id, r.seq): r.reason for r in est.validate_gps(fixes).collect()}
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fixes.schema)
    rows = shuffled_within([tuple(r) for r in fixes.collect()], 1, 7.0)
    stream = in_parts(spark, rows, schema, str(tmp_path / "fixes"), "seq", closing=10**6)
    out = streams.drain(streams.validate_gps_stream(stream, F.timestamp_seconds("seq"), delay="20 seconds"))
    assert {(r.mission_id, r.seq): r.reason for r in out.collect()} == want

    merged = [(1, float(i), i, 0, "IMU") for i in range(0, 40, 7)] + [(1, float(i), 100 + i, 1, None) for i in range(40)]
    stream = in_parts(spark, shuffled_within(merged, 1, 8.0), "mission_id long, t double, seq long, side int, sensor string", str(tmp_path / "sync"), "t")
    got = {r.seq - 100: r.imu_age_ms for r in streams.drain(streams.sync_warnings(stream, ["IMU"], 3000.0, delay="20 seconds")).collect()}
    assert got == {i: (i - max(j for j in range(0, 40, 7) if j <= i)) * 1000.0 for i in range(40) if i % 7 > 3 or i > 39}


def test_late_rows_are_dropped_and_silent_keys_start_anew(spark, tmp_path):
    rows = [(1, "a", "E", "m", 0, 0.0), (2, "a", "E", "m", 1, 500.0), (3, "a", "E", "m", 2, 900.0), (1, "a", "E", "m", 3, 1.0), (1, "a", "E", "m", 4, 905.0)]
    stream = in_parts(spark, rows, KEYS, str(tmp_path / "in"), "t", parts=5)
    out = streams.drain(streams.debounce_stream(stream, gap_s=2000.0, delay="10 seconds")).select("seq").collect()
    # seq 3 comes 899 s late; the state of mission 1 is kept for the gap, so seq 4 is a repeat
    assert sorted(r.seq for r in out) == [0, 1, 2]
    stream = in_parts(spark, rows, KEYS, str(tmp_path / "again"), "t", parts=5)
    kept = streams.in_order(stream, ["mission_id"], streams._seconds("t"), ["t"], ["t"], streams.steps.Debounce(2000.0), ["seq"], "10 seconds", silent_s=100.0)
    # a silence of 100 s ends the state, so the event at 905 s is the first again
    assert sorted(r.seq for r in streams.drain(kept).filter("kept").collect()) == [0, 1, 2, 4]


def test_missions_one_after_the_other_each_from_its_start(spark, tables):
    from flightloom.plans.catalog_sources import packets

    sent = packets(tables).filter("mission_id < 3").select("mission_id", "seq", "value")
    twice = sent.unionByName(sent)
    for start in (F.lit(0.0), F.lit(1.7e9) - F.col("mission_id") * 1e6):
        source = streams.replay(twice, "mission_id", [1, 2]).select("mission_id", "value")
        out = streams.drain(streams.packet_stream(source, start)).groupBy("mission_id", "seq").count().collect()
        assert len(out) == sent.count() and all(r["count"] == 1 for r in out)


@pytest.mark.parametrize("value", [float("nan"), None])
def test_nan_and_null_stay_apart(spark, tmp_path, value):
    rows = [(1, "a", "E", "m", 0, 0.0), (1, "a", "E", "m", 1, 5.0)]
    schema = KEYS + ", x double"
    stream = in_parts(spark, [(*r, value) for r in rows], schema, str(tmp_path / "in"), "t")
    got = [r.x for r in streams.drain(streams.debounce_stream(stream, delay="1 second")).collect()]
    assert len(got) == 2 and all((x is None) == (value is None) for x in got)


def test_a_cut_is_one_batch_of_several_files(spark, tmp_path):
    df = spark.range(130_000).select("id", (F.col("id") % 1300).cast("double").alias("t"))
    stream = streams.replay(df, "t", [1200.0, 1299.0], closing=1e6)
    seen = []

    def look(batch, number):
        parts = batch.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
        seen.append((tuple(batch.agg(F.min("t"), F.max("t"), F.count("*")).first()), parts))

    query = stream.writeStream.foreachBatch(look).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [row for row, _ in seen] == [(0.0, 1199.0, 120_000), (1200.0, 1298.0, 9_900), (1299.0, 1299.0, 100), (1e6, 1e6, 1)]
    assert max(parts for _, parts in seen) <= 50_000


def test_a_cut_with_fewer_rows_than_files_is_filled_up(spark):
    rows = [(i, float(i)) for i in range(7)] + [(9, 90.0)]
    df = spark.createDataFrame(rows, "id long, t double")
    out = streams.drain(streams.replay(df, "t", [50.0, 80.0], rows_a_file=2)).collect()
    assert sorted(tuple(r) for r in out) == rows


def test_workers_of_a_shard_have_one_state(spark, tmp_path):
    # ids that a float would run together, one missing; silences within a batch, across batches and at the end
    missions, workers = [2**53, 2**53 + 1, None, *range(40)], ["gps", None, "imu"]
    heard = {(m, w): [1.0 + i % 3, 2.5 + i % 3, *([9.0] if i % 2 else []), 12.0 + i % 5, *([26.0] if i % 7 else [])] for i, (m, w) in enumerate((m, w) for m in missions for w in workers)}
    rows = [(*who, t) for who, times in heard.items() for t in times]
    want = [(*who, "STALE", a + 3.0) for who, times in heard.items() for a, b in zip(times, [*times[1:], 26.0]) if b - a > 3.0]
    want += [(*who, "HEALTHY", b) for who, times in heard.items() for a, b in zip(times, times[1:]) if b - a > 3.0]
    schema = "mission_id long, worker string, t double"
    for cut in ([r for r in rows if r[2] < 10.0], [r for r in rows if 10.0 <= r[2] < 20.0], [r for r in rows if r[2] >= 20.0]):
        spark.createDataFrame(cut, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = streams.stale_stream(source.withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("bigint"))), shards=8)
    query = (
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8 < len(heard)


def test_keys_of_a_shard_wait_together(spark, tmp_path):
    schema = KEYS + ", x double, f float, at timestamp, day date, d decimal(30,10), b binary, a array<double>, s struct<u:string>, k double"
    odd = [float("nan"), None, -0.0, 1e300, float("-inf")]
    rows = []
    for i in range(900):
        key = (None if i % 13 == 0 else 2**53 + i % 50, ["gps", None, "g\"\n", ""][i % 4], "E", None if i % 3 else "m")
        when = datetime.datetime(2024, 1, 1, 2, 3, 4, i) if i % 7 else None
        rest = (odd[i % 5], 0.1, when, when and when.date(), Decimal("12345678901234567890.0000000001") if i % 2 else None, b"\x00\xff", [odd[(i + 1) % 5], None], (None,), [0.0, -0.0, float("nan"), None][i % 4])
        rows.append((*key, i, 0.01 * i, *rest))
    table = spark.createDataFrame(rows, schema)
    by = ["mission_id", "source", "event_code", "message"]
    parts = [r for i in range(3) for r in rows if (r[4] * 7919) % 3 == i]  # each micro-batch holds a third of every key
    stream = in_parts(spark, parts, schema, str(tmp_path / "in"), "t")
    ordered = streams.in_order(stream, by, streams._seconds("t"), ["t", "seq"], ["t"], streams.steps.Debounce(2.0), table.columns, shards=8)
    query = (
        ordered.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    out = spark.read.schema(ordered.schema).parquet(str(tmp_path / "out")).cache()
    got = {r.seq: r for r in out.collect()}
    assert len(got) == out.count() == len(rows)
    for r in table.collect():
        assert repr(tuple(got[r.seq])[:-1]) == repr(tuple(r))
    assert {s for s, r in got.items() if r.kept} == {r.seq for r in est.debounce(table.select(*by, "seq", "t")).collect()}
    # rows held, due times and states of 8 shards, besides those of the last row
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3 * 9
    # numbers as keys: 0.0 and -0.0 are one, NaN is one, null is one
    stream = in_parts(spark, parts, schema, str(tmp_path / "again"), "t")
    first = streams.in_order(stream, ["k"], streams._seconds("t"), ["t", "seq"], ["t"], streams.steps.Debounce(1e5), ["seq"], shards=8)
    assert sorted(r.seq for r in streams.drain(first).filter("kept").collect()) == [0, 2, 3]
