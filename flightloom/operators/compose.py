"""Running composition of maps that do not commute, for recursions x[n] = f_n(x[n-1]).

``running`` replaces every row's map by the composition of all maps up to it: inside blocks of rows by doubling (each
round composes a row with the one 1, 2, 4, ... before it), then over one row for each block the same again, then the
block's incoming map is applied to its rows. All of it is column arithmetic; a mission is never in one task, and the
number of rounds grows with the logarithm of its rows.

``Affine`` maps are x -> a x + b; ``Gaussian`` elements are the filtering steps of a two-dimensional state (position and
speed) whose composition gives means and covariances at once (associative form of the Kalman recursion).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightloom.operators.timeline import join_on
from flightloom.session import cut_lineage

Parts = dict[str, Column]


def running(df: DataFrame, by: list[str], position: str, parts: list[str], compose: Callable[[Parts, Parts], list[Parts]], block: int = 128) -> DataFrame:
    """df with the columns ``parts`` composed along ``position`` (1, 2, 3, ... within the key).

    ``compose(earlier, later)`` gives layers of named columns, the last of which has the parts' new values; a layer may
    use the names of those before it (as _m_<name>). Counts the rows of the longest key at once.
    """
    longest = df.agg(F.max(position).alias("n")).first()["n"] or 0
    return _running(df, by, position, parts, compose, block, int(longest))


def _running(df: DataFrame, by: list[str], position: str, parts: list[str], compose, block: int, longest: int) -> DataFrame:
    kept = df.columns
    out = df.withColumn("_block", F.floor((F.col(position) - 1) / block).cast("bigint")).withColumn("_in", ((F.col(position) - 1) % block).cast("int"))
    here = Window.partitionBy(*by, "_block").orderBy(position)
    step = 1
    while step < min(block, longest):
        out = out.select("*", *[F.lag(p, step).over(here).alias(f"_e_{p}") for p in parts])
        out = _composed(out, parts, compose, F.col("_in") >= step)
        step *= 2
    if longest > block:
        # what is written once is read by the blocks' ends and by their rows
        out = cut_lineage(out)
        ends = out.filter(F.col("_in") == block - 1).select(*by, (F.col("_block") + 1).alias("_end"), *parts)
        carried = _running(ends, by, "_end", parts, compose, block, longest // block)
        entering = carried.select(*by, F.col("_end").alias("_block"), *[F.col(p).alias(f"_e_{p}") for p in parts])
        out = _composed(join_on(out, entering, [*by, "_block"], "left"), parts, compose, F.col("_block") > 0)
    return out.select(*kept)


def _composed(df: DataFrame, parts: list[str], compose, where: Column) -> DataFrame:
    """df whose parts are composed with the earlier ones _e_<part> where the condition holds."""
    plain = [c for c in df.columns if c not in parts and not c.startswith("_e_")]
    made = compose({p: F.col(f"_e_{p}") for p in parts}, {p: F.col(p) for p in parts})
    out = df
    for layer in made:
        out = out.withColumns({f"_m_{name}": column for name, column in layer.items()})
    return out.select(*plain, *[F.when(where, F.col(f"_m_{p}")).otherwise(F.col(p)).alias(p) for p in parts])


AFFINE = ["_a", "_b"]


def affine(earlier: Parts, later: Parts) -> list[Parts]:
    return [{"_a": later["_a"] * earlier["_a"], "_b": later["_a"] * earlier["_b"] + later["_b"]}]


#: State transition A (2x2), mean b, covariance C (symmetric), information vector e and matrix J (symmetric).
GAUSSIAN = ["_a00", "_a01", "_a10", "_a11", "_b0", "_b1", "_c00", "_c01", "_c11", "_e0", "_e1", "_j00", "_j01", "_j11"]


def gaussian(i: Parts, j: Parts) -> list[Parts]:
    """Element i, then element j."""
    m = lambda name: F.col(f"_m_{name}")
    return [
        # S = I + C_i J_j; (I + J_j C_i) is S transposed
        {
            "s00": 1.0 + i["_c00"] * j["_j00"] + i["_c01"] * j["_j01"], "s01": i["_c00"] * j["_j01"] + i["_c01"] * j["_j11"],
            "s10": i["_c01"] * j["_j00"] + i["_c11"] * j["_j01"], "s11": 1.0 + i["_c01"] * j["_j01"] + i["_c11"] * j["_j11"],
            "u0": i["_b0"] + i["_c00"] * j["_e0"] + i["_c01"] * j["_e1"], "u1": i["_b1"] + i["_c01"] * j["_e0"] + i["_c11"] * j["_e1"],
            "w0": j["_e0"] - j["_j00"] * i["_b0"] - j["_j01"] * i["_b1"], "w1": j["_e1"] - j["_j01"] * i["_b0"] - j["_j11"] * i["_b1"],
        },
        {
            "det": m("s00") * m("s11") - m("s01") * m("s10"),
        },
        # M = A_j S^-1 and N = A_i^T (S^T)^-1
        {
            "m00": (j["_a00"] * m("s11") - j["_a01"] * m("s10")) / m("det"), "m01": (j["_a01"] * m("s00") - j["_a00"] * m("s01")) / m("det"),
            "m10": (j["_a10"] * m("s11") - j["_a11"] * m("s10")) / m("det"), "m11": (j["_a11"] * m("s00") - j["_a10"] * m("s01")) / m("det"),
            "n00": (i["_a00"] * m("s11") - i["_a10"] * m("s01")) / m("det"), "n01": (i["_a10"] * m("s00") - i["_a00"] * m("s10")) / m("det"),
            "n10": (i["_a01"] * m("s11") - i["_a11"] * m("s01")) / m("det"), "n11": (i["_a11"] * m("s00") - i["_a01"] * m("s10")) / m("det"),
        },
        # M C_i and N J_j
        {
            "p00": m("m00") * i["_c00"] + m("m01") * i["_c01"], "p01": m("m00") * i["_c01"] + m("m01") * i["_c11"],
            "p10": m("m10") * i["_c00"] + m("m11") * i["_c01"], "p11": m("m10") * i["_c01"] + m("m11") * i["_c11"],
            "q00": m("n00") * j["_j00"] + m("n01") * j["_j01"], "q01": m("n00") * j["_j01"] + m("n01") * j["_j11"],
            "q10": m("n10") * j["_j00"] + m("n11") * j["_j01"], "q11": m("n10") * j["_j01"] + m("n11") * j["_j11"],
        },
        {
            "_a00": m("m00") * i["_a00"] + m("m01") * i["_a10"], "_a01": m("m00") * i["_a01"] + m("m01") * i["_a11"],
            "_a10": m("m10") * i["_a00"] + m("m11") * i["_a10"], "_a11": m("m10") * i["_a01"] + m("m11") * i["_a11"],
            "_b0": m("m00") * m("u0") + m("m01") * m("u1") + j["_b0"], "_b1": m("m10") * m("u0") + m("m11") * m("u1") + j["_b1"],
            "_c00": m("p00") * j["_a00"] + m("p01") * j["_a01"] + j["_c00"], "_c01": m("p00") * j["_a10"] + m("p01") * j["_a11"] + j["_c01"],
            "_c11": m("p10") * j["_a10"] + m("p11") * j["_a11"] + j["_c11"], "_e0": m("n00") * m("w0") + m("n01") * m("w1") + i["_e0"],
            "_e1": m("n10") * m("w0") + m("n11") * m("w1") + i["_e1"], "_j00": m("q00") * i["_a00"] + m("q01") * i["_a10"] + i["_j00"],
            "_j01": m("q00") * i["_a01"] + m("q01") * i["_a11"] + i["_j01"], "_j11": m("q10") * i["_a01"] + m("q11") * i["_a11"] + i["_j11"],
        },
    ]


def followed(df: DataFrame, element: Parts, where: Column, before: bool = False) -> DataFrame:
    """df whose Gaussian elements are composed with another one behind (or before) them where the condition holds."""
    both = df.select("*", *[element[p].cast("double").alias(f"_e_{p}") for p in GAUSSIAN])
    if before:
        return _composed(both, GAUSSIAN, gaussian, where)
    return _composed(both, GAUSSIAN, lambda other, own: gaussian(own, other), where)


def reset(position: Column, speed: Column, position_var: float, speed_var: float) -> Parts:
    """The element that forgets what was and starts from a known state."""
    values = {"_b0": position, "_b1": speed, "_c00": F.lit(position_var), "_c11": F.lit(speed_var)}
    return {p: values.get(p, F.lit(0.0)) for p in GAUSSIAN}


def moved(dt: float, accel: Column, noise: tuple[float, float], seen: Column, var: float) -> Parts:
    """A step of constant acceleration, and a measurement of the position after it where one is given."""
    u0, u1 = 0.5 * dt * dt * accel, dt * accel
    gain, total = noise[0] / (noise[0] + var), noise[0] + var
    there = seen.isNotNull()
    miss = (seen - u0) / total
    given = {
        "_a00": F.lit(1.0 - gain), "_a01": F.lit((1.0 - gain) * dt), "_a10": F.lit(0.0), "_a11": F.lit(1.0), "_b0": u0 + gain * (seen - u0), "_b1": u1,
        "_c00": F.lit((1.0 - gain) * noise[0]), "_c01": F.lit(0.0), "_c11": F.lit(noise[1]), "_e0": miss, "_e1": dt * miss,
        "_j00": F.lit(1.0 / total), "_j01": F.lit(dt / total), "_j11": F.lit(dt * dt / total),
    }
    free = {"_a00": F.lit(1.0), "_a01": F.lit(dt), "_a11": F.lit(1.0), "_b0": u0, "_b1": u1, "_c00": F.lit(noise[0]), "_c11": F.lit(noise[1])}
    return {p: F.when(there, given[p]).otherwise(free.get(p, F.lit(0.0))) for p in GAUSSIAN}


def seen(value: Column, var: float) -> Parts:
    """A measurement of the position alone."""
    values = {"_a00": F.lit(1.0), "_a11": F.lit(1.0), "_e0": value / var, "_j00": F.lit(1.0 / var)}
    return {p: values.get(p, F.lit(0.0)) for p in GAUSSIAN}
