"""Ground rectangles seen by a downward camera, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from flightloom import params as P
from flightloom.functions import geo

# Corner order: north-west, north-east, south-east, south-west, as (east sign, north sign).
_CORNERS = ((-1.0, 1.0), (1.0, 1.0), (1.0, -1.0), (-1.0, -1.0))


def footprint_size(altitude: Column, hfov: float = P.HFOV_DEG, vfov: float = P.VFOV_DEG) -> Column:
    alt = F.greatest(altitude, F.lit(P.MIN_FOOTPRINT_ALT_M))
    return F.struct(
        (alt * 2.0 * math.tan(math.radians(hfov) / 2.0)).alias("width"),
        (alt * 2.0 * math.tan(math.radians(vfov) / 2.0)).alias("height"),
    )


def tilt_expansion(roll: Column, pitch: Column) -> Column:
    tilt = F.radians(F.least(F.lit(70.0), F.hypot(roll, pitch)))
    return 1.0 / F.greatest(F.lit(0.35), F.cos(tilt))


def footprint_size_tilted(altitude: Column, roll: Column, pitch: Column) -> Column:
    flat, grow = footprint_size(altitude), tilt_expansion(roll, pitch)
    return F.struct((flat["width"] * grow).alias("width"), (flat["height"] * grow).alias("height"))


def area_m2(size: Column) -> Column:
    return size["width"] * size["height"]


def _rotated(size: Column, yaw: Column) -> list[tuple[Column, Column]]:
    cos, sin = F.cos(F.radians(yaw)), F.sin(F.radians(yaw))
    out = []
    for sign_e, sign_n in _CORNERS:
        e, n = size["width"] * (sign_e / 2.0), size["height"] * (sign_n / 2.0)
        out.append((e * cos + n * sin, n * cos - e * sin))
    return out


def corners_geo(lat: Column, lon: Column, size: Column, yaw: Column) -> Column:
    return F.array(*[geo.offset_latlon(lat, lon, e, n) for e, n in _rotated(size, yaw)])


def corners_local(east: Column, north: Column, size: Column, yaw: Column) -> Column:
    return F.array(
        *[F.struct((east + e).alias("east"), (north + n).alias("north")) for e, n in _rotated(size, yaw)]
    )


def bounds(corners: Column) -> Column:
    """struct(min_e, min_n, max_e, max_n) of four local corners."""
    easts = [corners[i]["east"] for i in range(4)]
    norths = [corners[i]["north"] for i in range(4)]
    return F.struct(
        F.least(*easts).alias("min_e"), F.least(*norths).alias("min_n"),
        F.greatest(*easts).alias("max_e"), F.greatest(*norths).alias("max_n"),
    )


def overlap_ratio(a: Column, b: Column, area_a: Column, area_b: Column) -> Column:
    """Overlap of two bounding boxes as a share of the smaller footprint, 0 to 1."""
    w = F.greatest(F.lit(0.0), F.least(a["max_e"], b["max_e"]) - F.greatest(a["min_e"], b["min_e"]))
    h = F.greatest(F.lit(0.0), F.least(a["max_n"], b["max_n"]) - F.greatest(a["min_n"], b["min_n"]))
    return F.least(F.lit(1.0), w * h / F.greatest(F.lit(1.0), F.least(area_a, area_b)))


def edge_crossing(y: Column, a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """East value where the edge between two (east, north) corners crosses the line north = y, null when
    it does not (even-odd rule; an edge that crosses is never level, so the division is safe)."""
    (ae, an), (be, bn) = a, b
    return F.when((an > y) != (bn > y), (be - ae) * (y - an) / (bn - an) + ae)


def scanline(y: Column, corners: list[tuple[Column, Column]]) -> Column:
    """struct(enter, leave): the stretch of the line north = y inside a convex quad, nulls outside it.

    A point is inside by the even-odd rule when enter <= east < leave.
    """
    cuts = [edge_crossing(y, corners[i], corners[(i + 3) % 4]) for i in range(4)]
    return F.struct(F.least(*cuts).alias("enter"), F.greatest(*cuts).alias("leave"))


def point_in_quad(x: Column, y: Column, corners: Column) -> Column:
    """Even-odd test against four local corners."""
    cut = scanline(y, [(corners[i]["east"], corners[i]["north"]) for i in range(4)])
    return F.coalesce((cut["enter"] <= x) & (x < cut["leave"]), F.lit(False))


def altitude_ratio(a: Column, b: Column) -> Column:
    return F.greatest(a, b) / F.greatest(F.lit(1e-6), F.least(a, b))


def tilt_delta(roll_a: Column, pitch_a: Column, roll_b: Column, pitch_b: Column) -> Column:
    return F.hypot(roll_a - roll_b, pitch_a - pitch_b)


def edge_score(
    overlap: Column, distance: Column, dt: Column, dyaw: Column,
    alt_ratio: Column, dtilt: Column, quality: Column, temporal: Column,
) -> Column:
    def closeness(value, limit):
        return F.greatest(F.lit(0.0), 1.0 - value / max(limit, 1.0))

    # fixed weights; they add up to 1 without the bonus for pairs found by time only
    return (
        overlap * 0.24
        + closeness(distance, P.MAX_DISTANCE_M) * 0.18
        + closeness(dt, P.MAX_TIME_S) * 0.15
        + closeness(dyaw, P.MAX_YAW_DEG) * 0.13
        + closeness(alt_ratio - 1.0, P.MAX_ALTITUDE_RATIO - 1.0) * 0.10
        + closeness(dtilt, P.MAX_TILT_DELTA_DEG) * 0.10
        + quality * 0.10
        + F.when(temporal, 0.08).otherwise(0.0)
    )
