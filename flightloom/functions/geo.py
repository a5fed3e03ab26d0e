"""Geodesy on columns. Three local frames exist on purpose; they differ in which latitude scales east."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flightloom.params import EARTH_RADIUS_M

R = EARTH_RADIUS_M


def is_finite(value: Column) -> Column:
    return F.coalesce(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))


def valid_lat_lon(lat: Column, lon: Column) -> Column:
    return is_finite(lat) & is_finite(lon) & lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2.0)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2.0)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2.0) * R * F.atan2(F.sqrt(chord), F.sqrt(1.0 - chord))


def to_local_ref(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    """struct(east, north), east scaled at the reference latitude."""
    return F.struct(
        (F.radians(lon - lon0) * R * F.cos(F.radians(lat0))).alias("east"),
        (F.radians(lat - lat0) * R).alias("north"),
    )


def to_local_mean(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    """struct(north, east), east scaled at the mean of both latitudes."""
    middle = (F.radians(lat) + F.radians(lat0)) * 0.5
    return F.struct(
        ((F.radians(lat) - F.radians(lat0)) * R).alias("north"),
        ((F.radians(lon) - F.radians(lon0)) * R * F.cos(middle)).alias("east"),
    )


def to_geodetic_mean(north: Column, east: Column, lat0: Column, lon0: Column) -> Column:
    """struct(lat, lon): inverse of to_local_mean."""
    lat = F.radians(lat0) + north / R
    scale = F.greatest(F.abs(F.cos((lat + F.radians(lat0)) * 0.5)), F.lit(1e-9))
    return F.struct(
        F.degrees(lat).alias("lat"),
        F.degrees(F.radians(lon0) + east / (R * scale)).alias("lon"),
    )


def offset_latlon(lat: Column, lon: Column, east: Column, north: Column) -> Column:
    """struct(lat, lon) moved by metres, east scaled at the point's own latitude."""
    scale = F.greatest(F.cos(F.radians(lat)), F.lit(1e-9))
    return F.struct(
        (lat + F.degrees(north / R)).alias("lat"),
        (lon + F.degrees(east / (R * scale))).alias("lon"),
    )


def flat_distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    local = to_local_mean(lat2, lon2, lat1, lon1)
    return F.hypot(local["north"], local["east"])


def wrap_360(degrees: Column) -> Column:
    return F.pmod(degrees, F.lit(360.0))


def angle_diff(a: Column, b: Column) -> Column:
    return F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0


def angle_delta(a: Column, b: Column) -> Column:
    return F.abs(angle_diff(b, a))


def circular_lerp(previous: Column, new: Column, alpha: Column) -> Column:
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), alpha))
    return wrap_360(previous + share * angle_diff(new, previous))


def velocity_from_course(speed: Column, course_deg: Column) -> Column:
    return F.struct(
        (speed * F.cos(F.radians(course_deg))).alias("vn"),
        (speed * F.sin(F.radians(course_deg))).alias("ve"),
    )


def course_from_velocity(vn: Column, ve: Column) -> Column:
    speed = F.hypot(vn, ve)
    return F.struct(
        F.when(speed <= 1e-9, 0.0).otherwise(speed).alias("speed"),
        F.when(speed <= 1e-9, 0.0).otherwise(wrap_360(F.degrees(F.atan2(ve, vn)))).alias("course"),
    )


def dms_to_decimal(deg: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    size = deg + minutes / 60.0 + seconds / 3600.0
    return F.when(ref.isin("S", "W"), -size).otherwise(size)


def rational(numerator: Column, denominator: Column) -> Column:
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def nmea_degrees(raw: Column, hemisphere: Column) -> Column:
    """ddmm.mmmm text to signed degrees; null when it is not a number."""
    number = raw.try_cast("double")
    whole = F.floor(number / 100.0)
    size = whole + (number - whole * 100) / 60.0
    return F.when(hemisphere.isin("S", "W"), -size).otherwise(size)


def knots_to_mps(knots: Column) -> Column:
    return knots * 0.514444


def bearing_and_distance(east: Column, north: Column, target_east: Column, target_north: Column) -> Column:
    """struct(bearing in radians from north, distance in metres) in a metric local frame."""
    de, dn = target_east - east, target_north - north
    return F.struct(F.atan2(de, dn).alias("bearing"), F.hypot(dn, de).alias("distance"))


def grid_cell(east: Column, north: Column, grid: Column | float) -> Column:
    size = F.nullif(F.lit(grid).cast("double"), F.lit(0.0))
    return F.struct(
        F.floor(east / size).cast("bigint").alias("cx"),
        F.floor(north / size).cast("bigint").alias("cy"),
    )
