"""Ordered scans that do not depend on one task holding a whole mission.

A plain ``Window.partitionBy(mission)`` puts every row of a mission into one task. Here each
mission is cut into slices of its order column. Window functions run inside a slice, one summary
row per slice carries what later (or earlier) slices need, and the two are joined on
(mission, slice). Only the summaries, rows / slice size of them, meet in a per-mission window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "_slice"
RANK = "_rank"
KEY = "_by"
_FIRST_SLICE = -(2**62)


@dataclass(frozen=True)
class Step:
    """One output column of a scan."""

    out: str
    expr: Column | None = None
    cond: Column | None = None
    inclusive: bool = True
    needs_rank = False

    def summary(self, order: list[str]) -> list[Column]:
        raise NotImplementedError

    def carry(self, prev: Window, following: Window, whole: Window) -> list[Column]:
        raise NotImplementedError

    def local(self, here: Window, order: list[str]) -> list[Column]:
        return []

    def combine(self) -> Column:
        raise NotImplementedError

    def _n(self, kind: str) -> str:
        return f"_{kind}_{self.out}"

    def _boxed(self) -> Column:
        return F.struct(self.expr.alias("v"))


class Previous(Step):
    """Value of the row before this one (null on the first row)."""

    def summary(self, order):
        return [F.max_by(self._boxed(), F.struct(*order)).alias(self._n("s"))]

    def carry(self, prev, following, whole):
        return [F.last(self._n("s")).over(prev).alias(self._n("c"))]

    def local(self, here, order):
        return [F.lag(self._boxed()).over(here).alias(self._n("l"))]

    def combine(self):
        return F.coalesce(F.col(self._n("l")), F.col(self._n("c")))["v"]


class Following(Step):
    """Value of the row after this one (null on the last row)."""

    def summary(self, order):
        return [F.min_by(self._boxed(), F.struct(*order)).alias(self._n("s"))]

    def carry(self, prev, following, whole):
        return [F.first(self._n("s")).over(following).alias(self._n("c"))]

    def local(self, here, order):
        return [F.lead(self._boxed()).over(here).alias(self._n("l"))]

    def combine(self):
        return F.coalesce(F.col(self._n("l")), F.col(self._n("c")))["v"]


class LastWhere(Step):
    """Value on the latest row so far for which the condition holds."""

    def summary(self, order):
        return [
            F.max_by(F.when(self.cond, self._boxed()), F.when(self.cond, F.struct(*order))).alias(self._n("s"))
        ]

    def carry(self, prev, following, whole):
        return [F.last(self._n("s"), ignorenulls=True).over(prev).alias(self._n("c"))]

    def local(self, here, order):
        frame = here.rowsBetween(Window.unboundedPreceding, 0 if self.inclusive else -1)
        return [F.last(F.when(self.cond, self._boxed()), ignorenulls=True).over(frame).alias(self._n("l"))]

    def combine(self):
        return F.coalesce(F.col(self._n("l")), F.col(self._n("c")))["v"]


class NextWhere(Step):
    """Value on the earliest row from here on for which the condition holds."""

    def summary(self, order):
        return [
            F.min_by(F.when(self.cond, self._boxed()), F.when(self.cond, F.struct(*order))).alias(self._n("s"))
        ]

    def carry(self, prev, following, whole):
        return [F.first(self._n("s"), ignorenulls=True).over(following).alias(self._n("c"))]

    def local(self, here, order):
        frame = here.rowsBetween(0 if self.inclusive else 1, Window.unboundedFollowing)
        return [F.first(F.when(self.cond, self._boxed()), ignorenulls=True).over(frame).alias(self._n("l"))]

    def combine(self):
        return F.coalesce(F.col(self._n("l")), F.col(self._n("c")))["v"]


class RunningMax(Step):
    def summary(self, order):
        return [F.max(self.expr).alias(self._n("s"))]

    def carry(self, prev, following, whole):
        return [F.max(self._n("s")).over(prev).alias(self._n("c"))]

    def local(self, here, order):
        frame = here.rowsBetween(Window.unboundedPreceding, 0)
        return [F.max(self.expr).over(frame).alias(self._n("l"))]

    def combine(self):
        return F.greatest(F.col(self._n("l")), F.col(self._n("c")))


class RunningSum(Step):
    def summary(self, order):
        return [F.sum(self.expr).alias(self._n("s"))]

    def carry(self, prev, following, whole):
        return [F.sum(self._n("s")).over(prev).alias(self._n("c"))]

    def local(self, here, order):
        frame = here.rowsBetween(Window.unboundedPreceding, 0)
        return [F.sum(self.expr).over(frame).alias(self._n("l"))]

    def combine(self):
        return F.coalesce(F.col(self._n("l")), F.lit(0)) + F.coalesce(F.col(self._n("c")), F.lit(0))


class RowNumber(Step):
    """1-based position within the key."""

    def summary(self, order):
        return [F.count(F.lit(1)).alias(self._n("s"))]

    def carry(self, prev, following, whole):
        return [F.sum(self._n("s")).over(prev).alias(self._n("c"))]

    def local(self, here, order):
        return [F.row_number().over(here).alias(self._n("l"))]

    def combine(self):
        return (F.col(self._n("l")) + F.coalesce(F.col(self._n("c")), F.lit(0))).cast("bigint")


class Streak(Step):
    """Number of consecutive rows, ending here, for which the condition holds."""

    needs_rank = True

    def _broken(self):
        return F.when(~F.coalesce(self.cond, F.lit(False)), F.col(RANK))

    def summary(self, order):
        last_break = F.max(self._broken())
        return [
            (F.max(RANK) - F.coalesce(last_break, F.lit(0))).cast("bigint").alias(self._n("s")),
            last_break.isNull().alias(self._n("u")),
        ]

    def carry(self, prev, following, whole):
        # tail of the last broken slice plus every unbroken slice after it
        rows, unbroken = F.col(self._n("s")), F.col(self._n("u"))
        total = F.sum(rows).over(prev)
        anchor = F.last(
            F.when(~unbroken, F.struct(rows.alias("tail"), F.col(self._n("t")).alias("total"))), ignorenulls=True
        ).over(prev)
        return [
            (total - F.coalesce(anchor["total"] - anchor["tail"], F.lit(0))).alias(self._n("c"))
        ]

    def pre_carry(self, upto):
        return F.sum(self._n("s")).over(upto).alias(self._n("t"))

    def local(self, here, order):
        frame = here.rowsBetween(Window.unboundedPreceding, 0)
        return [F.max(self._broken()).over(frame).alias(self._n("l"))]

    def combine(self):
        broken = F.col(self._n("l"))
        carried = F.coalesce(F.col(self._n("c")), F.lit(0))
        return F.when(broken.isNotNull(), F.col(RANK) - broken).otherwise(F.col(RANK) + carried).cast("bigint")


class Whole(Step):
    """An aggregate of the whole key on every row; ``how`` is sum, min, max or count."""

    def __init__(self, out: str, expr: Column, how: str = "sum"):
        object.__setattr__(self, "out", out)
        object.__setattr__(self, "expr", expr)
        object.__setattr__(self, "how", how)

    def summary(self, order):
        return [getattr(F, self.how)(self.expr).alias(self._n("s"))]

    def carry(self, prev, following, whole):
        again = "sum" if self.how == "count" else self.how
        return [getattr(F, again)(self._n("s")).over(whole).alias(self._n("c"))]

    def combine(self):
        return F.col(self._n("c"))


class FirstOf(Step):
    """Value on the first row of the key (optionally the first one meeting a condition)."""

    def summary(self, order):
        if self.cond is None:
            return [F.min_by(self._boxed(), F.struct(*order)).alias(self._n("s"))]
        return [
            F.min_by(F.when(self.cond, self._boxed()), F.when(self.cond, F.struct(*order))).alias(self._n("s"))
        ]

    def carry(self, prev, following, whole):
        ordered = whole.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return [F.first(self._n("s"), ignorenulls=True).over(ordered).alias(self._n("c"))]

    def combine(self):
        return F.col(self._n("c"))["v"]


def slice_of(column: Column, width: float) -> Column:
    """Slices grow with the column: null sorts first and has the first slice, NaN sorts last and has the last."""
    last = F.when(F.isnan(column.cast("double")), F.lit(-_FIRST_SLICE - 1))
    return F.coalesce(last, F.floor(column / F.lit(width)).cast("bigint"), F.lit(_FIRST_SLICE))


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """As a join using the keys, but a null key part meets a null."""
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    met = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(named, met, how).drop(*[f"_r_{k}" for k in keys])


def scan(
    df: DataFrame,
    by: list[str],
    order: list[str],
    steps: list[Step],
    width: float,
    slice_on: Column | None = None,
) -> DataFrame:
    """Add the step columns to ``df``.

    ``order`` must be a total order within the key; slices are cut on ``slice_on`` (by default the
    first order column), which has to grow with it. ``width`` is in its units.
    """
    at = slice_on if slice_on is not None else F.col(order[0])
    # one struct as key: it is never null itself, and structs with null parts are equal
    sliced = df.withColumn(SLICE, slice_of(at, width)).withColumn(KEY, F.struct(*by))
    by = [KEY]
    here = Window.partitionBy(*by, SLICE).orderBy(*order)
    ranked = any(step.needs_rank for step in steps)
    rank = F.row_number().over(here).cast("bigint")

    source = sliced.withColumn(RANK, rank) if ranked else sliced
    totals = source.groupBy(*by, SLICE).agg(*[c for step in steps for c in step.summary(order)])

    along = Window.partitionBy(*by).orderBy(SLICE)
    prev = along.rowsBetween(Window.unboundedPreceding, -1)
    following = along.rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy(*by)
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    extra = [step.pre_carry(upto) for step in steps if hasattr(step, "pre_carry")]
    if extra:
        totals = totals.select("*", *extra)
    carried = totals.select(*by, SLICE, *[c for step in steps for c in step.carry(prev, following, whole)])

    joined = sliced.join(carried, [*by, SLICE])
    if ranked:
        joined = joined.withColumn(RANK, rank)
    local = [c for step in steps for c in step.local(here, order)]
    if local:
        joined = joined.select("*", *local)
    return joined.select(*df.columns, *[step.combine().alias(step.out) for step in steps])


def with_preceding_rows(
    df: DataFrame,
    by: list[str],
    position: str,
    rows: int,
    block: int = 65536,
) -> tuple[DataFrame, Window, Column]:
    """Blocks of ``block`` rows, each with copies of the ``rows`` rows before it, however many blocks those span.

    Returns the blocked rows, the window spec to use over them, and the test that keeps the rows a
    block owns. ``position`` is a 1-based row number within the key (see RowNumber).
    """
    own = F.floor((F.col(position) - 1) / block).cast("bigint")
    reached = F.floor((F.col(position) - 1 + rows) / block).cast("bigint")
    spread = df.withColumn("_own", own).withColumn("_block", F.explode(F.sequence(F.col("_own"), reached)))
    return spread, Window.partitionBy(*by, "_block").orderBy(position), F.col("_own") == F.col("_block")
