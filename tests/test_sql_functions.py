"""Every SQL function gives what its column form gives, on values that reach its branches."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from flightloom.functions import footprint as fp
from flightloom.functions.sql import SQL_FUNCTIONS, parameter_names, register_sql_functions

BOXES = [{"min_e": 0.0, "min_n": 0.0, "max_e": 4.0, "max_n": 4.0}, {"min_e": 2.0, "min_n": 1.0, "max_e": 9.0, "max_n": 3.0}]
QUADS = [[{"east": e, "north": n} for e, n in ((-2.0, 2.5), (2.5, 2.0), (2.0, -2.5), (-2.5, -2.0))]]
S, T = "it's $a\\b, (x) and(1.5) & <c>", "2024:03:09 10:11:12"
SAMPLES = {
    "DOUBLE": [0.0, 1.0, -37.25, 725.5, 1013.25, 1e-13, float("nan"), float("inf"), None],
    "STRING": ["", S, T, "12.5", "4807.038", "S", "essential", "/logs/flight_log_20.v2.csv", "C:\\img\\IMG_0042.JPG", "$GPGGA,1*49", "a;b", None],
    "BOOLEAN": [True, False, None],
    "BIGINT": [0, 2_500_000, None],
    "TIMESTAMP": ["2024-03-09 10:11:12.25", None],
    "ARRAY<DOUBLE>": [[1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0], [0.5, -0.5, 0.5, 0.5, 2.0, 1.0, 0.0, 3.0, 7.0], [0.0] * 9, [0.3, 0.1, -0.2, 0.9, 1.0, 0.0, 5.0, 1.0, 1.0]],
    "ARRAY<STRING>": [["1", "2", "x"], ["1", "2.5", "-3"], [], ["a", None, "b"], None],
    "MAP<STRING, STRING>": [{"it's": "1", "S": "2"}, {}, None],
    "STRUCT<width: DOUBLE, height: DOUBLE>": [{"width": 3.0, "height": 2.0}, None],
    "STRUCT<min_e: DOUBLE, min_n: DOUBLE, max_e: DOUBLE, max_n: DOUBLE>": [*BOXES, None],
    "ARRAY<STRUCT<east: DOUBLE, north: DOUBLE>>": [*QUADS, None],
}


def typed(parameters):
    names = parameter_names(parameters)
    cuts = [parameters.index(f"{n} ") if k == 0 else parameters.index(f", {n} ") + 2 for k, n in enumerate(names)] + [len(parameters) + 2]
    return [(n, parameters[a + len(n) + 1 : b - 2]) for n, a, b in zip(names, cuts, cuts[1:])]


@pytest.fixture(scope="module")
def registered(spark):
    return set(register_sql_functions(spark))


@pytest.mark.parametrize("part", range(4))
def test_each_equals_its_column_form(spark, registered, part):
    for name, parameters, expression in SQL_FUNCTIONS[part::4]:
        assert name in registered
        fields = typed(parameters)
        pools = [SAMPLES[t] for _, t in fields]
        # every value of every parameter, each beside several of the others
        rows = [tuple(p[(k * (j + 1) + r) % len(p)] for j, p in enumerate(pools)) for k, r in itertools.product(range(max(map(len, pools))), range(3))]
        read = ", ".join(f"{n} {'STRING' if t == 'TIMESTAMP' else t}" for n, t in fields)
        df = spark.createDataFrame(rows, read).withColumns({n: F.col(n).cast("timestamp") for n, t in fields if t == "TIMESTAMP"})
        names = [n for n, _ in fields]
        both = df.select(expression(*map(F.col, names)).alias("column_form"), F.expr(f"{name}({', '.join(names)})").alias("sql_form"))
        assert both.schema["column_form"].dataType == both.schema["sql_form"].dataType, name
        # digits are compared as text: NaN equals itself
        for r in both.collect():
            assert repr(r.column_form) == repr(r.sql_form), (name, r)


def test_point_in_quad_by_ray_casting(spark, registered):
    quad = [(c["east"], c["north"]) for c in QUADS[0]]

    def inside(x, y):
        crossed = [(ax, ay, bx, by) for (ax, ay), (bx, by) in zip(quad, quad[1:] + quad[:1]) if (ay > y) != (by > y)]
        return sum(x < (bx - ax) * (y - ay) / (by - ay) + ax for ax, ay, bx, by in crossed) % 2 == 1

    points = [(x / 4, y / 4) for x in range(-12, 13) for y in range(-12, 13)]
    df = spark.createDataFrame([(x, y, QUADS[0]) for x, y in points], "x double, y double, corners array<struct<east: double, north: double>>")
    got = df.select("x", "y", fp.point_in_quad(F.col("x"), F.col("y"), F.col("corners")).alias("hit"), F.expr("point_in_quad(x, y, corners)").alias("sql")).collect()
    assert all(r.hit == r.sql == inside(r.x, r.y) for r in got) and 0 < sum(r.hit for r in got) < len(points)
    assert not math.isnan(sum(r.x for r in got))
