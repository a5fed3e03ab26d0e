"""Phases that follow one another: a table of rungs, each with the condition that leaves its phase.

A mission passes every rung once at most, so the row that leaves a phase is the first one, behind the row that entered
it, on which the rung's condition holds: one aggregate over all rows for each rung, of a fixed number however long a
mission is. Rows before need no state: a condition that has to hold for k rows in a row looks at its streak, cut off at
the entry of the phase. The same table runs row by row in a stream.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightloom.operators.timeline import join_on
from flightloom.session import cut_lineage

POSITION, NEXT_T = "_n", "_next_t"


@dataclass(frozen=True)
class Rung:
    """How a phase ends: ``flag`` holds for ``rows`` rows in a row, or for ``held_s`` seconds; or ``launch_s`` seconds
    have passed since the first rung was left, or ``entry_s`` since this phase began."""

    phase: str
    target: str
    flag: str | None = None
    rows: int = 0
    held_s: float | None = None
    launch_s: float | None = None
    entry_s: float | None = None
    reason: str | None = None
    #: given instead where the row that ends the phase is (or is not) flagged, or late
    unflagged_reason: str | None = None
    late_reason: str | None = None


def flag(name: str) -> str:
    return f"_is_{name}"


def streak(name: str) -> str:
    return f"_streak_{name}"


def since(name: str) -> str:
    return f"_since_{name}"


def _leaves(rung: Rung, k: int) -> Column:
    """On a row joined with the entries of its key: whether it ends phase k."""
    c = F.col
    ways = []
    if rung.rows == 1:
        ways.append(c(flag(rung.flag)))
    elif rung.rows:
        ways.append(F.least(c(streak(rung.flag)), c(POSITION) - c(f"_n{k}")) >= rung.rows)
    if rung.held_s is not None:
        begun = F.greatest(c(since(rung.flag)), c(f"_next{k}"))
        ways.append(c(flag(rung.flag)) & (c("t") - begun >= rung.held_s))
    if rung.launch_s is not None:
        ways.append(c("t") - c("_launch") > rung.launch_s)
    if rung.entry_s is not None:
        ways.append(c("t") - c(f"_t{k}") >= rung.entry_s)
    out = F.lit(False)
    for way in ways:
        out = out | F.coalesce(way, F.lit(False))
    return out


def _reason(rung: Rung) -> Column:
    out = F.lit(rung.reason).cast("string")
    if rung.unflagged_reason:
        out = F.when(F.coalesce(F.col(flag(rung.flag)), F.lit(False)), out).otherwise(F.lit(rung.unflagged_reason))
    if rung.late_reason:
        out = F.when(F.coalesce(F.col("t") - F.col("_launch") > rung.launch_s, F.lit(False)), F.lit(rung.late_reason)).otherwise(out)
    return out


def begin(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row for each key, in the first phase before its first row."""
    none = F.lit(None).cast("double")
    return rows.select(*by).distinct().select(
        "*", F.lit(0).cast("bigint").alias("_n0"), none.alias("_t0"), none.alias("_next0"), F.lit(None).cast("string").alias("_why0"),
        none.alias("_launch"), F.lit(None).cast("bigint").alias("_abort"),
    )


def climb(rows: DataFrame, by: list[str], entries: DataFrame, rungs: list[Rung], first: int = 0, abort_s: float | None = None) -> DataFrame:
    """entries with the row that left each of the rungs, the ``first`` of which is rung ``first`` of the whole ladder.

    ``rows`` has the key, POSITION (from 1), t, NEXT_T (the next row's t) and what the rungs look at; it is read once
    for each rung, so it should be a table. From the first row ``abort_s`` seconds after launch on nothing is left.
    Runs a small job for each rung.
    """
    for k, rung in enumerate(rungs, first):
        wanted = {POSITION, "t", NEXT_T}
        if rung.flag:
            wanted |= {c for c in (flag(rung.flag), streak(rung.flag), since(rung.flag)) if c in rows.columns}
        met = join_on(rows.select(*by, *sorted(wanted)), entries, by).filter(F.col(POSITION) > F.col(f"_n{k}"))
        on = F.col("_abort").isNull() | (F.col(POSITION) < F.col("_abort"))
        left = F.min(F.when(on & _leaves(rung, k), F.struct(POSITION, "t", NEXT_T, _reason(rung).alias("why")))).alias("_left")
        found = [left]
        if k == 1 and abort_s is not None:
            found.append(F.min(F.when(F.col("t") - F.col("_launch") > abort_s, F.col(POSITION))).alias("_late"))
        ends = met.groupBy(*by).agg(*found)
        entries = join_on(entries, ends, by, "left")
        if k == 1 and abort_s is not None:
            entries = entries.withColumn("_abort", F.col("_late")).drop("_late")
            entries = entries.withColumn("_left", F.when(F.col("_abort").isNull() | (F.col("_left")[POSITION] < F.col("_abort")), F.col("_left")))
        n = k + 1
        entries = entries.withColumns(
            {f"_n{n}": F.col("_left")[POSITION], f"_t{n}": F.col("_left.t"), f"_next{n}": F.col("_left")[NEXT_T], f"_why{n}": F.col("_left.why")}
        ).drop("_left")
        if k == 0:
            entries = entries.withColumn("_launch", F.col("_t1"))
        entries = cut_lineage(entries)
    return entries


def assign(rows: DataFrame, by: list[str], entries: DataFrame, rungs: list[Rung], aborted: tuple[str, str] | None = None) -> DataFrame:
    """rows with phase, entered and phase_reason. ``aborted``: the phase, and its reason, of rows from the abort on,
    unless the last phase was reached before."""
    last = len(rungs)
    both = join_on(rows, entries, by, "left")
    position = F.col(POSITION)
    phase, why, entered = F.lit(rungs[0].phase), F.lit(None).cast("string"), F.lit(False)
    for k, rung in enumerate(rungs, 1):
        there = F.coalesce(position >= F.col(f"_n{k}"), F.lit(False))
        here = F.coalesce(position == F.col(f"_n{k}"), F.lit(False))
        phase, entered, why = F.when(there, F.lit(rung.target)).otherwise(phase), entered | here, F.when(here, F.col(f"_why{k}")).otherwise(why)
    if aborted:
        over = F.col(f"_n{last}").isNull() & F.coalesce(position >= F.col("_abort"), F.lit(False))
        here = over & (position == F.col("_abort"))
        phase, entered, why = F.when(over, F.lit(aborted[0])).otherwise(phase), entered | here, F.when(here, F.lit(aborted[1])).otherwise(why)
    return both.withColumns({"phase": phase, "entered": entered, "phase_reason": why})


class Steps:
    """The ladder row by row: state is phase, launch, entry of the phase, streak, start of the hold, whether aborted."""

    def __init__(self, rungs: list[Rung], abort_s: float | None = None, aborted: tuple[str, str] = ("ABORT", "abort_requested")):
        self.rungs, self.abort_s, self.aborted = {r.phase: r for r in rungs}, abort_s, aborted
        self.order = [r.phase for r in rungs]

    def start(self) -> list:
        return [self.order[0], None, None, 0, None]

    def step(self, state: list, t: float, flags: dict[str, bool]) -> tuple[list, tuple]:
        phase, launch, entry, run, held = state
        rung = self.rungs.get(phase)
        if rung is None:
            return state, (phase, False, None)
        flown = None if launch is None else t - launch
        if flown is not None and self.abort_s is not None and flown > self.abort_s:
            return [self.aborted[0], launch, t, 0, None], (self.aborted[0], True, self.aborted[1])
        up = bool(rung.flag and flags[rung.flag])
        run, held = (run + 1, t if held is None else held) if up else (0, None)
        late = rung.launch_s is not None and flown is not None and flown > rung.launch_s
        ends = (
            late or (rung.rows > 0 and run >= rung.rows) or (rung.held_s is not None and up and t - held >= rung.held_s)
            or (rung.entry_s is not None and entry is not None and t - entry >= rung.entry_s)
        )
        if not ends:
            return [phase, launch, entry, run, held], (phase, False, None)
        why = rung.late_reason if late and rung.late_reason else rung.unflagged_reason if rung.unflagged_reason and not up else rung.reason
        return [rung.target, t if phase == self.order[0] else launch, t, 0, None], (rung.target, True, why)
