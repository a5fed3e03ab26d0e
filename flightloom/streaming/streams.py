"""Structured Streaming forms of the stateful operators. Each gives the rows of its batch form."""

from __future__ import annotations

import json
import pickle
import sys
import uuid
import zlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import pandas as pd
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flightloom import params as P
from flightloom.operators import estimators as est
from flightloom.operators import ladder, steps
from flightloom.session import cut_lineage, shared_folder
from flightloom.sources.messages import parse_packets


#: Keys of a stream are dealt by hash to this many shards. A shard has one state, so a state costs per shard, not per key.
SHARDS = 2048


def _shard(by: list[str | Column], shards: int) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(shards)).cast("int")


def _pack(value) -> bytes:
    return zlib.compress(pickle.dumps(value, 5), 1)


def _unpack(value: bytes):
    return pickle.loads(zlib.decompress(value))


class _InOrder(StatefulProcessor):
    """Rows of the keys of a shard in the order of their event times, given to a step function one by one.

    Rows wait until the watermark has passed them, those that come together as one packed entry of a list; a timer is set
    for the first of them. Rows behind the watermark are late and dropped by the engine. A key that is silent for
    ``silent_ms`` loses its state. ``order`` and ``inputs`` are places in the values of a row, ``readers`` makes them of JSON.
    """

    def __init__(self, fold, names: list[str], readers: list, order: list[int], inputs: list[int], outputs: list[str], silent_ms: int):
        self.fold, self.names, self.readers, self.order, self.inputs = fold, names, readers, order, inputs
        self.outputs, self.silent_ms = outputs, silent_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "held binary")
        self.now = handle.getValueState("now", "states binary")  # of each key: its state, and when it is forgotten
        self.due = handle.getValueState("due", "ms bigint")

    def _remind(self, ms: int) -> None:
        set_ = self.due.get()
        if set_ is not None and set_[0] is not None:
            if set_[0] <= ms:
                return
            self.handle.deleteTimer(set_[0])
        self.handle.registerTimer(ms)
        self.due.update((ms,))

    def _values(self, texts: list[str]) -> list[tuple]:
        found = json.loads(f"[{','.join(texts)}]")
        columns = [[row.get(n) for row in found] for n in self.names]
        columns = [values if read is None else [None if v is None else read(v) for v in values] for values, read in zip(columns, self.readers)]
        return [*zip(*columns)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            times = [int(ms) for ms in pdf["ms"]]
            self.rows.appendValue((_pack([*zip(times, pdf["key"], pdf["values_"], pdf["row"])]),))
            first = min(times) if first is None else min(first, min(times))
        if first is not None:
            self._remind(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        watermark = timerValues.getCurrentWatermarkInMs()
        held = [r for (packed,) in self.rows.get() for r in _unpack(packed)] if self.rows.exists() else []
        states = _unpack(self.now.get()[0]) if self.now.exists() else {}
        # nothing has come since the last row was let go
        silent = {who for who, (_, until) in states.items() if until <= watermark}
        for who in silent.difference(r[1] for r in held) if silent else ():
            del states[who]
        ready = [r for r in held if r[0] <= watermark]
        rest = [r for r in held if r[0] > watermark]
        del held
        values = self._values([r[2] for r in ready])
        # missing values of the order come first
        places = sorted(range(len(ready)), key=lambda k: [(values[k][i] is not None, values[k][i]) for i in self.order])
        out = []
        for k in places:
            _, who, _, row = ready[k]
            state = states[who][0] if who in states else self.fold.start()
            state, made = self.fold.step(state, tuple(values[k][i] for i in self.inputs))
            states[who] = (state, watermark + self.silent_ms)
            out.append((row, *(None if v is None else str(v) for v in made)))
        if out:
            yield pd.DataFrame(out, columns=["row", *self.outputs], dtype=object)
            self.now.update((_pack(states),))
            if rest:
                self.rows.put([(_pack(rest),)])
            else:
                self.rows.clear()
        elif silent:
            self.now.update((_pack(states),))
        dues = [*(r[0] for r in rest), *(until for _, until in states.values())]
        if dues:
            self._remind(min(dues))

    def close(self) -> None:
        pass


def _ordered_state(spark) -> None:
    """Streams with timers and lists in their state need a store that has column families."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: How rows are written to JSON and read again: nothing of a value is lost.
_JSON = {
    "timeZone": "UTC", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "maxStringLen": str(2**31 - 1),
}


def _exact(name: str, kind: T.DataType) -> tuple[Column, Callable | None]:
    """A column as JSON has it in full, and what makes its value of that. Times are microseconds, dates are days."""
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return c.cast("double"), float  # NaN and infinities are text in JSON
    if isinstance(kind, T.DecimalType):
        return c.cast("string"), Decimal
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c), None
    return (F.unix_date(c) if isinstance(kind, T.DateType) else c), None


def in_order(
    df: DataFrame, by: list[str], event_time: Column, order: list[str], inputs: list[str], fold, keep: list[str], delay: str = "10 minutes",
    silent_s: float = 86_400.0, shards: int = SHARDS,
) -> DataFrame:
    """``keep`` columns and the outputs of a step function for every row of a stream, in order of event time, however the
    rows of a key arrive within ``delay``; rows of one millisecond follow by ``order``. Rows come out once the watermark
    has passed them; later ones are dropped. After ``silent_s`` of event time without a row a key starts anew.

    The keys of a shard share a state. A row goes through it as one text, which only the engine writes and reads."""
    for module in (sys.modules[__name__], steps, ladder, est):
        cloudpickle.register_pickle_by_value(module)
    _ordered_state(df.sparkSession)
    timed = df.withColumn("_at", event_time).withWatermark("_at", delay).withColumn("_ms", F.unix_millis("_at"))
    fields = {f.name: f for f in timed.schema}
    names = [*dict.fromkeys([*order, *inputs])]
    columns, readers = zip(*[_exact(n, fields[n].dataType) for n in names])
    # to a key 0.0 and -0.0 are one value
    floats = [isinstance(fields[n].dataType, (T.FloatType, T.DoubleType)) for n in by]
    keys = [_exact(n, fields[n].dataType)[0] + F.lit(0.0) if float_ else _exact(n, fields[n].dataType)[0] for n, float_ in zip(by, floats)]

    def text(*parts: Column) -> Column:
        return F.to_json(F.struct(*parts), _JSON)

    extra = T.StructType.fromDDL(fold.outputs)
    made = [f"made{i}" for i in range(len(extra))]
    machine = _InOrder(fold, names, [*readers], [names.index(n) for n in order], [names.index(n) for n in inputs], made, int(silent_s * 1000))
    # frames are made of named tuples, whose names begin with a letter
    sharded = timed.select(
        _shard(keys, shards).alias("shard"), F.col("_at").alias("at"), F.col("_ms").alias("ms"),
        text(*[c.alias(n) for c, n in zip(keys, by)]).alias("key"),
        text(*[c.alias(n) for c, n in zip(columns, names)]).alias("values_"),
        text(*[F.col(f"`{n}`") for n in keep]).alias("row"),
    )
    texts = T.StructType([T.StructField(n, T.StringType()) for n in ["row", *made]])
    out = sharded.groupBy("shard").transformWithStateInPandas(machine, texts, "Append", "EventTime")
    row = F.from_json("row", T.StructType([T.StructField(n, fields[n].dataType) for n in keep]), _JSON)
    typed = [F.col(name).cast(f.dataType).alias(f.name) for name, f in zip(made, extra)]
    return out.select(row.alias("_row"), *typed).select("_row.*", *extra.names)


class _FirstOfEach(StatefulProcessor):
    """The first of a mission's packets of one sequence number, by the mission's own clock: numbers are remembered until
    it is ``delay_s`` past them, and packets that come later than that are dropped."""

    def __init__(self, delay_s: float):
        self.delay_s = delay_s

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "clock double, seqs array<bigint>, times array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        clock, seqs, times = self.seen.get() if self.seen.exists() else (None, [], [])
        known, latest = dict(zip(seqs, times)), clock
        for row in rows:
            t, seq = row["_clock"], row["_seq"]
            if t is None or seq is None:  # nothing to tell a repeat by
                yield row
                continue
            if seq in known or (clock is not None and t < clock - self.delay_s):
                continue
            known[seq] = t
            latest = t if latest is None else max(latest, t)
            yield row
        if latest is not None:
            kept = {s: t for s, t in known.items() if t >= latest - self.delay_s}
            self.seen.update((latest, list(kept), list(kept.values())))

    def close(self) -> None:
        pass


def packet_stream(lines: DataFrame, start: Column, delay_s: float = 600.0) -> DataFrame:
    """Parsed packets with event time from the packet; repeats of a (mission, seq) are dropped.

    ``lines``: mission_id, value. ``start``: epoch seconds at which the row's mission began. Each mission has a clock of
    its own, so missions that arrive one after the other, each from its own start, make no other one late. What is
    remembered of a mission is the numbers of its last ``delay_s``.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    _ordered_state(lines.sparkSession)
    parsed = parse_packets(lines.withColumn("_zero", start)).filter(F.col("packet").isNotNull())
    at = (F.col("_zero") + F.col("packet.t")).cast("double")
    # the text goes through the state, not its forty columns, and is read again behind it
    timed = parsed.select("mission_id", "value", at.alias("_clock"), F.col("packet.seq").alias("_seq"), F.col("mission_id").alias("_key"))
    once = timed.groupBy("_key").transformWithState(_FirstOfEach(delay_s), timed.schema, "Append", "None")
    event_time = F.timestamp_micros((F.col("_clock") * 1e6).cast("bigint"))
    return parse_packets(once).select("mission_id", "packet.*", event_time.alias("event_time"))


def _seconds(t: str) -> Column:
    """A mission's clock as event time, a day later: a stream begins with its watermark at the epoch, and rows at or
    before it would be late."""
    return F.timestamp_micros(((F.col(t) + 86_400.0) * 1e6).cast("bigint"))


def debounce_stream(events: DataFrame, gap_s: float = P.DEBOUNCE_S, event_time: Column | None = None, delay: str = "10 minutes") -> DataFrame:
    """Event time is ``t`` (seconds) unless given. A key's state is needed for ``gap_s`` only."""
    by, at = ["mission_id", "source", "event_code", "message"], event_time if event_time is not None else _seconds("t")
    out = in_order(events, by, at, ["t", "seq"], ["t"], steps.Debounce(gap_s), events.columns, delay, silent_s=max(gap_s, 0.0) + 1.0)
    return out.filter("kept").drop("kept")


def validate_gps_stream(fixes: DataFrame, received: Column, as_of: Column | None = None, delay: str = "10 minutes", silent_s: float = 86_400.0) -> DataFrame:
    """``received``: when a fix arrived, which grows with seq; the fix's own stamp may go back, that is what is checked."""
    now = as_of if as_of is not None else F.col("ts_ns")
    judged = fixes.withColumn("_verdict", est.gps_stateless((now - F.col("ts_ns")) / F.lit(1e6)))
    check = steps.GpsCheck(P.MAX_JUMP_M, P.MAX_SPEED_MPS)
    return in_order(judged, ["mission_id"], received, ["seq"], ["_verdict", "ts_ns", "latitude", "longitude"], check, fixes.columns, delay, silent_s)


class _PhaseStep:
    """The ladder of phases; vertical rate and the highest altitude since launch are worked out from the rows before."""

    outputs = "phase string, entered boolean, phase_reason string"
    state = "phase string, launch double, entry double, run bigint, held double, t double, alt double, top double"

    def __init__(self, params: dict):
        self.p = params
        self.steps = ladder.Steps(est.flight_rungs(params), params["max_flight_s"], est.ABORTED)

    def start(self) -> list:
        return [*self.steps.start(), None, None, 0.0]

    def step(self, state: list, row: tuple) -> tuple[list, tuple]:
        *inner, t0, alt0, top = state
        t, alt, g = row
        alt, g = max(0.0, alt or 0.0), float("nan") if g is None else g
        speed = 0.0 if t0 is None else (alt - alt0) / max(t - t0, 1e-3)
        launched = inner[1] is not None
        top = max(top, alt) if launched else alt
        flags = {**est.phase_flags(self.p, alt, speed, g), "falling": est.falling_flag(self.p, alt, speed, top)}
        inner, out = self.steps.step(inner, t, flags)
        return [*inner, t, alt, top], out


def flight_phase_stream(telemetry: DataFrame, event_time: Column | None = None, delay: str = "10 minutes", silent_s: float = 86_400.0) -> DataFrame:
    """Event time is ``t`` (seconds) unless given."""
    from flightloom.functions.attitude import accel_g

    ready = telemetry.withColumn("accel_g", accel_g(F.col("raw_accel_x"), F.col("raw_accel_y"), F.col("raw_accel_z")))
    at = event_time if event_time is not None else _seconds("t")
    return in_order(ready, ["mission_id"], at, ["t", "seq"], ["t", "baro_altitude", "accel_g"], _PhaseStep(est.PHASE_PARAMS), telemetry.columns, delay, silent_s)


class _SensorAges:
    """Age of the last sample of each sensor at a capture; rows are (t, sensor or None for a capture)."""

    def __init__(self, sensors: list[str]):
        self.sensors = sensors
        self.outputs = ", ".join(f"{s.lower()}_age_ms double" for s in sensors)
        self.state = ", ".join(f"s{i} double" for i in range(len(sensors)))

    def start(self) -> list:
        return [None] * len(self.sensors)

    def step(self, state: list, row: tuple) -> tuple[list, tuple]:
        t, sensor = row
        if sensor is not None:
            return [t if s == sensor else last for s, last in zip(self.sensors, state)], (None,) * len(state)
        return state, tuple(-1.0 if last is None else (t - last) * 1000.0 for last in state)


def sync_warnings(merged: DataFrame, sensors: list[str], limit_ms: float = P.SYNC_WARN_MS, event_time: Column | None = None, delay: str = "10 minutes", silent_s: float = 86_400.0) -> DataFrame:
    """Captures taken while a sensor was behind by more than the limit.

    ``merged``: mission_id, t, seq, sensor (null for a capture). Samples at the time of a capture
    count, so ``side`` (0 sample, 1 capture) orders rows of one instant.
    """
    at = event_time if event_time is not None else _seconds("t")
    out = in_order(merged, ["mission_id"], at, ["t", "side", "seq"], ["t", "sensor"], _SensorAges(sensors), ["mission_id", "t", "seq", "sensor"], delay, silent_s)
    ages = [F.col(f"{s.lower()}_age_ms") for s in sensors]
    oldest = F.greatest(*ages) if len(ages) > 1 else ages[0]
    return out.filter(F.col("sensor").isNull() & (oldest > limit_ms)).drop("sensor")


def rate_stream(samples: DataFrame, seconds: float, by: list[str], delay: str = "10 minutes", slide: float | None = None) -> DataFrame:
    """Samples per window of event time ``ts``."""
    width = f"{int(seconds * 1000)} milliseconds"
    span = F.window("ts", width, f"{int(slide * 1000)} milliseconds") if slide else F.window("ts", width)
    timed = samples.withWatermark("ts", delay)
    return timed.groupBy(*by, span.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(
        *by, F.col("w.start").alias("window_start"), "n", (F.col("n") / F.lit(seconds)).alias("actual_hz")
    )


def stale_stream(samples: DataFrame, timeout_s: float = P.STALE_S, delay: str = "0 seconds", shards: int = SHARDS) -> DataFrame:
    """One row whenever a worker has been silent for ``timeout_s`` of event time ``ts``, and when it speaks again.

    The workers of a shard have one state: when each was last heard, and whether its silence has been told."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    names = ["mission_id", "worker", "status", "at_s"]

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = pickle.loads(state.get[0]) if state.exists else {}
        heard, rows = {}, []
        if not state.hasTimedOut:
            for pdf in frames:
                for mission, worker, us in zip(pdf["mission_id"], pdf["worker"], pdf["us"]):
                    heard.setdefault((mission, worker), []).append(int(us))
        for who, times in heard.items():
            last, silent = known.get(who, (None, False))
            for us in sorted(times):
                if last is not None and us - last > timeout_s * 1e6:
                    if not silent:
                        rows.append((*who, "STALE", last / 1e6 + timeout_s))
                    rows.append((*who, "HEALTHY", us / 1e6))
                last, silent = (us if last is None else max(last, us)), False
            known[who] = (last, silent)
        watermark, soonest = state.getCurrentWatermarkMs(), None
        for who, (last, silent) in known.items():
            if silent:
                continue
            due = int(last / 1000 + timeout_s * 1000) + 1
            if due < watermark and who not in heard:
                rows.append((*who, "STALE", last / 1e6 + timeout_s))
                known[who] = (last, True)
            elif soonest is None or due < soonest:
                soonest = due
        state.update((pickle.dumps(known),))
        if soonest is not None:
            state.setTimeoutTimestamp(max(soonest, watermark + 1))
        if rows:
            yield pd.DataFrame(rows, columns=names)

    shard = _shard(["mission_id", "worker"], shards).alias("_shard")
    # as text a mission without an id leaves the others as they are in a pandas column
    timed = samples.withWatermark("ts", delay).select(shard, F.col("mission_id").cast("string"), "worker", "ts", F.unix_micros("ts").alias("us"))
    told = timed.groupBy("_shard").applyInPandasWithState(
        run, "mission_id string, worker string, status string, at_s double", "known binary", "append", GroupStateTimeout.EventTimeTimeout,
    )
    return told.withColumn("mission_id", F.col("mission_id").cast("bigint"))


# -- running a stream over what is there now --------------------------------
def replay(df: DataFrame, order: str, cuts: list[float], closing: float | None = None, rows_a_file: int = 50_000) -> DataFrame:
    """A recorded table as a stream of several micro-batches in order: one for each cut, each of the same number of files.

    The table is worked out once. A cut is written by as many tasks as the largest one needs at ``rows_a_file`` rows each;
    one with fewer rows than files is filled up with files that hold none.
    ``closing``: a last row of nothing but this value of the order column, so far ahead that the watermark passes all
    others; it stays behind the watermark itself and never comes out of an ordered stream."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/replay-{uuid.uuid4().hex}"
    at, edges = F.col(order), [None, *cuts, None]
    spans = [
        F.lit(True) & (at >= low if low is not None else F.lit(True)) & (at < high if high is not None else F.lit(True))
        for low, high in zip(edges, edges[1:])
    ]
    table = cut_lineage(df)
    counts = table.agg(*[F.count_if(span).alias(f"_{i}") for i, span in enumerate(spans)]).first()
    files = max(1, -(-max(counts) // rows_a_file))
    empty = spark.createDataFrame([], df.schema)
    for span in spans:
        before = _data_files(spark, path)
        table.filter(span).repartition(files).write.mode("append").parquet(path)
        # a task without rows writes no file
        for _ in range(files - (_data_files(spark, path) - before)):
            empty.coalesce(1).write.mode("append").parquet(path)
    if closing is not None:
        end = spark.range(1).select(*[F.lit(closing if f.name == order else None).cast(f.dataType).alias(f.name) for f in df.schema])
        end.write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def _data_files(spark, path: str) -> int:
    """Files of a folder as Spark's readers list them."""
    try:
        return len(spark.read.format("binaryFile").load(path).inputFiles())
    except AnalysisException:  # nothing is written yet
        return 0


def drain(stream: DataFrame) -> DataFrame:
    """Process everything there is, write it to the shared folder, and read it back."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark).rstrip('/')}/drain-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def drain_windows(stream: DataFrame, keys: list[str]) -> DataFrame:
    """As drain for windowed counts: every window is kept, also the last ones the watermark has not passed."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark).rstrip('/')}/drain-{uuid.uuid4().hex}"

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/batch_no={number}")

    query = (
        stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{base}/state").outputMode("update")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    written = spark.read.option("recursiveFileLookup", True).parquet(f"{base}/out")
    latest = F.max_by(F.struct(*[c for c in stream.columns if c not in keys]), "_batch")
    return written.groupBy(*keys).agg(latest.alias("_l")).select(*keys, "_l.*")
