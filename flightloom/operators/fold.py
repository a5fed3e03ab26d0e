"""Stateful passes over a mission in time order that window functions cannot express.

A step function turns (state, row) into (state, output). Missions are cut into slices and all
slices run at once, each from a guess of the state it starts in; the state a slice really starts
in is the one its predecessor ended in. Slices whose guess was wrong run again from the right
state until none is left, so the result is exactly that of one pass in order. Filters and
detectors forget or settle, so few slices run twice; a mission that fits in one slice runs once.
Rows stream through a task in sorted order, so memory does not grow with the slice.
"""

from __future__ import annotations

import json
from typing import Protocol

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightloom.operators.timeline import SLICE, join_on, slice_of
from flightloom.session import cut_lineage


class Step(Protocol):
    """What a fold needs. States are lists of numbers, texts, flags and None."""

    outputs: str  # DDL of the output columns

    def start(self) -> list: ...

    def step(self, state: list, row: tuple) -> tuple[list, tuple]: ...


_ARROW = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "bigint": pa.int64()}


def _pass(fold: Step, keys: list[str], inputs: list[str], keep: list[str], made: list[tuple[str, str]], rows: bool):
    """The task side: walk sorted rows, restarting at every new key. Yields rows or final states."""
    width = len(keys)

    def run(batches):
        key, state, ends, key_types = None, None, [], None
        for batch in batches:
            key_types = [batch.schema.field(name).type for name in keys]
            columns = [batch.column(name).to_pylist() for name in [*keys, *inputs, "_entry"]]
            results = []
            for row in zip(*columns):
                if row[:width] != key:
                    if key is not None and not rows:
                        ends.append((*key, json.dumps(state)))
                    key = row[:width]
                    state = json.loads(row[-1]) if row[-1] is not None else fold.start()
                state, result = fold.step(state, row[width:-1])
                results.append(result)
            if rows and results:
                arrays = [batch.column(name) for name in keep]
                arrays += [pa.array(v, type=_ARROW[kind]) for v, (_, kind) in zip(zip(*results), made)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *[name for name, _ in made]])
        if key is not None and not rows:
            ends.append((*key, json.dumps(state)))
            arrays = [pa.array(v, type=t) for v, t in zip(zip(*ends), [*key_types, pa.string()])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "_exit"])

    return run


def _execute(df: DataFrame, fold: Step, by: list[str], order: list[str], inputs: list[str], keep: list[str], rows: bool) -> DataFrame:
    keys = [*by, SLICE]
    needed = list(dict.fromkeys([*keys, *order, *inputs, *(keep if rows else []), "_entry"]))
    sorted_rows = df.select(*needed).repartition(*keys).sortWithinPartitions(*keys, *order)
    fields = {field.name: field for field in df.schema}
    extra = T.StructType.fromDDL(fold.outputs if rows else "_exit string")
    schema = T.StructType([*[fields[name] for name in (keep if rows else keys)], *extra.fields])
    made = [(field.name, field.dataType.simpleString()) for field in extra.fields]
    return sorted_rows.mapInArrow(_pass(fold, keys, inputs, keep if rows else [], made, rows), schema)


def ordered_fold(
    df: DataFrame, by: list[str], order: list[str], inputs: list[str], fold: Step, keep: list[str], width: float,
    slice_on: Column | None = None,
) -> DataFrame:
    """``keep`` columns and the outputs of the fold for every row."""
    # the step classes travel with the job, so executors need no copy of this package
    import flightloom.operators.fold as here
    import flightloom.operators.steps as steps

    for module in (here, steps):
        cloudpickle.register_pickle_by_value(module)

    keys = [*by, SLICE]
    at = slice_on if slice_on is not None else F.col(order[0])
    needed = list(dict.fromkeys([*by, *order, *inputs, *keep]))
    # read once to see how it is sliced and once or more to run, so written once
    sliced = cut_lineage(df.withColumn(SLICE, slice_of(at, width)).select(*needed, SLICE))
    none = F.lit(None).cast("string")
    split = sliced.groupBy(*by).agg(F.min(SLICE).alias("a"), F.max(SLICE).alias("b")).filter("a < b")
    if split.isEmpty():
        return _execute(sliced.withColumn("_entry", none), fold, by, order, inputs, keep, True)

    first = _execute(sliced.withColumn("_entry", none), fold, by, order, inputs, keep, False)
    ends = cut_lineage(first.withColumn("_entry", none))
    along = Window.partitionBy(*by).orderBy(SLICE)
    while True:
        due = ends.withColumn("_due", F.lag("_exit").over(along))
        wrong = cut_lineage(due.filter(~F.col("_due").eqNullSafe(F.col("_entry"))).select(*keys, F.col("_due").alias("_entry")))
        if wrong.isEmpty():
            break
        again = _execute(join_on(sliced, wrong, keys), fold, by, order, inputs, keep, False)
        again = join_on(again, wrong, keys)
        kept = ends.join(wrong.select(*[F.col(k).alias(f"_r_{k}") for k in keys]), [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], "left_anti")
        ends = cut_lineage(kept.unionByName(again.select(*kept.columns)))
    return _execute(join_on(sliced, ends.select(*keys, "_entry"), keys), fold, by, order, inputs, keep, True)
