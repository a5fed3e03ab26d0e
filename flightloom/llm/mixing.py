"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Document rates w minimise the relative entropy to 1 under one token constraint for each source, sum(w * size) = target,
with w at most `most`. The solution is exponentially tilted, w = min(most, exp(l * size / mean size)), with one
multiplier l for each source. The dual is convex and separates by source: Newton iterations, kept within a bracket, run
for all sources at once, each one aggregation over the table of distinct (source, size). Rates are rounded into copies
along the sizes of a source: a document gets floor(R + w) - floor(R) copies, R being the sum of the rates before it, so
a source's words miss its target by the largest document of the source at most. Sums that decide are of decimals, so
their order does not matter: reruns agree.

Scale: documents are shuffled once, pre-aggregated to (source, size, slice of a hash); iterations and running sums are
over those counts, never over documents, and a source or size that holds a third of all rows is split by the slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flightloom.llm.shared import stored

WORD = r"[^\x20\x09-\x0D]+"


def size(text: str = "text") -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, source_size, target): the total is shared by weight; weights repeat over sources in code point order,
    null last; a source stops at `most` times its size and the excess is shared again among the others.

    `sizes` is (source, source_size), one row for each source. The share that fills every source is found from the
    order of most * size / weight, in one window over the sources.
    """
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    rows = sizes.withColumn("weight", F.element_at(cycle, (place % len(weights) + 1).cast("int")))
    limit = F.col("source_size") * F.lit(most)
    # sources fill in the order of limit / weight; with those before it full, the share of one unit of weight is known
    order = Window.partitionBy(F.lit(0)).orderBy("fills_at", F.col("source").asc_nulls_last())
    all_ = Window.partitionBy(F.lit(0))
    rows = rows.withColumn("fills_at", limit / F.col("weight"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    share = (F.sum("source_size").over(all_) - F.coalesce(F.sum(limit).over(before), F.lit(0))) / (
        F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    rows = rows.withColumn("share", share).withColumn("nth", F.row_number().over(order))
    # the first source that does not fill fixes the share of all after it
    level = F.min(F.when(F.col("fills_at") >= F.col("share"), F.struct("nth", "share"))).over(all_)["share"]
    target = F.when(F.col("fills_at") >= F.coalesce(level, F.lit(float("inf"))), F.col("weight") * level).otherwise(limit.cast("double"))
    return rows.select("source", "source_size", F.least(target, limit.cast("double")).alias("target"))


def _rate(multiplier: Column, most: int) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(multiplier * F.col("size") / F.col("mean"), F.lit(50.0))))


def _exact(amount: Column) -> Column:
    """A sum that is the same in every order of its rows."""
    return F.sum(amount.cast("decimal(28,6)")).cast("double")


def multipliers(histogram: DataFrame, goals: DataFrame, most: int = 3, rounds: int = 40, close: float = 1e-9) -> DataFrame:
    """(source, mean, multiplier): Newton's method on the dual, one aggregation of the histogram (source, size, n) a round.

    A bracket keeps every step inside; a source whose target is its limit keeps the largest multiplier. Each round's
    state has one row for each source and is written, so rounds do not nest.
    """
    # at 60 times the smallest relative size every rate is at its limit, or 0
    state = stored(
        goals.where("source_size > 0").join(histogram.where("size > 0").groupBy("source").agg(F.sum("n").alias("docs"), F.min("size").alias("small")).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .select("source", "target", (F.col("source_size") / F.col("docs")).alias("mean"), F.lit(0.0).alias("multiplier"),
                (F.col("source_size") / F.col("docs") / F.col("small") * -40.0).alias("low"), (F.col("source_size") / F.col("docs") / F.col("small") * 2.0).alias("high"), F.lit(False).alias("done")),
        "mixing-state",
    )
    for _ in range(rounds):
        h = histogram.where("size > 0").withColumnRenamed("source", "s")
        w = _rate(F.col("multiplier"), most)
        mass = F.col("n") * F.col("size")
        sums = h.join(F.broadcast(state), F.col("s").eqNullSafe(F.col("source"))).groupBy("s").agg(
            _exact(mass * w).alias("got"), _exact(F.when(w < most, mass * w * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope")
        )
        gap = F.col("got") - F.col("target")
        step = F.col("multiplier") - gap / F.col("slope")
        low = F.when(gap < 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("multiplier")).otherwise(F.col("high"))
        inside = F.col("slope").isNotNull() & (F.col("slope") > 0) & (step > low) & (step < high)
        met = F.abs(gap) <= F.lit(close) * F.col("target")
        state = stored(
            state.join(sums, F.col("source").eqNullSafe(F.col("s"))).select(
                "source", "target", "mean",
                F.when(met | F.col("done"), F.col("multiplier")).otherwise(F.when(inside, step).otherwise((low + high) / 2)).alias("multiplier"),
                low.alias("low"), high.alias("high"), (met | F.col("done")).alias("done"),
            ),
            "mixing-state",
        )
        if not state.where("not done").take(1):
            break
    return state.select("source", "mean", "multiplier")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3, text: str = "text", slices: int = 64) -> DataFrame:
    """docs (without the text) with size, source_size, target, rate and copies.

    Documents without words have no share in the words and get no copy. Rows of equal source and size are ranked by
    doc_id and the hash of the text; equal rows are exchangeable. Columns with the names of results are replaced. Runs its jobs at once up to the rates.
    """
    # columns besides doc_id and source travel under names of their own
    others = {c: f"__other{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "source", text, "size", "source_size", "target", "rate", "copies")}
    keep = ["doc_id", "source", *others.values()]
    rows = docs.select("doc_id", "source", *(F.col(f"`{c}`").alias(o) for c, o in others.items()), size(text).alias("size"), F.xxhash64(text).alias("__hash"))
    rows = stored(rows.withColumn("__slice", F.pmod(F.xxhash64("doc_id", "__hash"), F.lit(slices)).cast("int")), "mixing-sizes")
    counts = stored(rows.groupBy("source", "size", "__slice").agg(F.count("*").alias("n")), "mixing-counts")
    histogram = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    goals = stored(targets(histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, most), "mixing-targets")
    found = multipliers(histogram, goals, most).withColumnRenamed("source", "s")
    # a source at its limit has the same rate everywhere, and so has one whose limit no finite multiplier reaches
    plan = goals.join(found, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumnRenamed("source", "g")
    full = F.col("target") >= F.col("source_size") * most
    rate = F.when(F.col("size") == 0, 0.0).when(full, float(most)).otherwise(_rate(F.col("multiplier"), most)).cast("decimal(14,12)")
    by_size = histogram.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("g"))).drop("g").withColumn("rate", rate)
    running = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    by_size = by_size.withColumn("base", F.coalesce(F.sum(F.col("n").cast("decimal(15,0)") * F.col("rate")).over(running), F.lit(0)).cast("decimal(30,12)"))
    earlier = Window.partitionBy("source", "size").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn("rank0", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    where = ranks.join(by_size.drop("n").select(F.col("source").alias("g"), F.col("size").alias("z"), "source_size", "target", "rate", "base"), F.col("source").eqNullSafe(F.col("g")) & (F.col("size") == F.col("z"))).drop("g", "z")
    where = where.select(F.col("source").alias("g"), F.col("size").alias("z"), F.col("__slice").alias("sl"), "rank0", "source_size", "target", "rate", "base")
    own = F.row_number().over(Window.partitionBy("source", "size", "__slice").orderBy("doc_id", "__hash")) - 1
    placed = rows.withColumn("own", own).join(where, F.col("source").eqNullSafe(F.col("g")) & (F.col("size") == F.col("z")) & (F.col("__slice") == F.col("sl")))
    placed = stored(placed.withColumn("place", F.col("rank0") + F.col("own")).drop("g", "z", "sl", "own", "rank0", "__hash", "__slice"), "mixing-places")

    def copies(start: Column) -> Column:
        total = lambda k: F.floor(F.col("base") + k.cast("decimal(15,0)") * F.col("rate") + start.cast("decimal(6,5)")).cast("long")
        return F.least(F.lit(most).cast("long"), total(F.col("place") + 1) - total(F.col("place")))

    # where the rounding starts is free: of 16 starts each source takes the one nearest to its target
    starts = [(k + 0.5) / 16 for k in range(16)]
    got = placed.groupBy("source", "target").agg(*(F.sum(F.col("size") * copies(F.lit(u))).alias(f"w{k}") for k, u in enumerate(starts)))
    nearest = F.array_min(F.array(*(F.struct(F.abs(F.col(f"w{k}") - F.col("target")).alias("miss"), F.lit(u).alias("start")) for k, u in enumerate(starts))))
    starts_by_source = stored(got.select(F.col("source").alias("g"), nearest["start"].alias("start")), "mixing-starts")
    return placed.join(F.broadcast(starts_by_source), F.col("source").eqNullSafe(F.col("g"))).withColumn("copies", copies(F.col("start"))).select(
        "doc_id", "source", *(F.col(o).alias(c) for c, o in others.items()), "size", "source_size", "target", F.col("rate").cast("double").alias("rate"), "copies"
    )
