"""The scalar functions for SQL users, as temporary SQL functions that the optimizer inlines.

Each is written once, as a column expression over its parameters; its SQL body is that expression's text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from flightloom import params as P
from flightloom.functions import attitude as att
from flightloom.functions import footprint as fp
from flightloom.functions import geo, pressure, values

_Q = "ARRAY<DOUBLE>"
_SIZE = "STRUCT<width: DOUBLE, height: DOUBLE>"
_BOX = "STRUCT<min_e: DOUBLE, min_n: DOUBLE, max_e: DOUBLE, max_n: DOUBLE>"
_CORNERS = "ARRAY<STRUCT<east: DOUBLE, north: DOUBLE>>"


def _doubles(names: str) -> str:
    return ", ".join(f"{name} DOUBLE" for name in names.split())


# name, parameters, expression over them
SQL_FUNCTIONS: tuple[tuple[str, str, Callable[..., Column]], ...] = (
    # geodesy
    ("haversine_m", _doubles("lat1 lon1 lat2 lon2"), geo.haversine_m),
    ("to_local_ref", _doubles("lat lon lat0 lon0"), geo.to_local_ref),
    ("to_local_mean", _doubles("lat lon lat0 lon0"), geo.to_local_mean),
    ("to_geodetic_mean", _doubles("north east lat0 lon0"), geo.to_geodetic_mean),
    ("offset_latlon", _doubles("lat lon east north"), geo.offset_latlon),
    ("flat_distance_m", _doubles("lat1 lon1 lat2 lon2"), geo.flat_distance_m),
    ("valid_lat_lon", _doubles("lat lon"), geo.valid_lat_lon),
    ("is_finite", _doubles("v"), geo.is_finite),
    ("wrap_360", _doubles("a"), geo.wrap_360),
    ("angle_diff", _doubles("a b"), geo.angle_diff),
    ("angle_delta", _doubles("a b"), geo.angle_delta),
    ("circular_lerp", _doubles("p n s"), geo.circular_lerp),
    ("velocity_from_course", _doubles("speed course"), geo.velocity_from_course),
    ("course_from_velocity", _doubles("vn ve"), geo.course_from_velocity),
    ("dms_to_decimal", "d DOUBLE, m DOUBLE, s DOUBLE, ref STRING", geo.dms_to_decimal),
    ("rational", _doubles("numerator denominator"), geo.rational),
    ("nmea_degrees", "raw STRING, hemisphere STRING", geo.nmea_degrees),
    ("knots_to_mps", _doubles("k"), geo.knots_to_mps),
    ("bearing_and_distance", _doubles("east north target_east target_north"), geo.bearing_and_distance),
    ("grid_cell", _doubles("east north grid"), geo.grid_cell),
    # footprints
    ("footprint_size", _doubles("alt"), fp.footprint_size),
    ("footprint_width_m", _doubles("alt"), lambda alt: fp.footprint_size(alt)["width"]),
    ("footprint_height_m", _doubles("alt"), lambda alt: fp.footprint_size(alt)["height"]),
    ("tilt_expansion", _doubles("roll pitch"), fp.tilt_expansion),
    ("footprint_size_tilted", _doubles("alt roll pitch"), fp.footprint_size_tilted),
    ("area_m2", f"size {_SIZE}", fp.area_m2),
    ("corners_geo", f"lat DOUBLE, lon DOUBLE, size {_SIZE}, yaw DOUBLE", fp.corners_geo),
    ("corners_local", f"east DOUBLE, north DOUBLE, size {_SIZE}, yaw DOUBLE", fp.corners_local),
    ("polygon_bounds", f"corners {_CORNERS}", fp.bounds),
    ("overlap_ratio", f"a {_BOX}, b {_BOX}, area_a DOUBLE, area_b DOUBLE", fp.overlap_ratio),
    ("point_in_quad", f"x DOUBLE, y DOUBLE, corners {_CORNERS}", fp.point_in_quad),
    ("altitude_ratio", _doubles("a b"), fp.altitude_ratio),
    ("tilt_delta", _doubles("roll_a pitch_a roll_b pitch_b"), fp.tilt_delta),
    ("edge_score", _doubles("overlap distance dt dyaw alt_ratio dtilt quality") + ", temporal BOOLEAN", fp.edge_score),
    # quaternions and attitude
    ("q_norm", f"q {_Q}", att.q_norm),
    ("q_normalize", f"q {_Q}", att.q_normalize),
    ("q_is_finite", f"q {_Q}", att.q_is_finite),
    ("q_multiply", f"a {_Q}, b {_Q}", att.q_multiply),
    ("q_conjugate", f"q {_Q}", att.q_conjugate),
    ("q_from_euler", _doubles("roll pitch yaw"), att.q_from_euler),
    ("q_to_euler", f"q {_Q}", att.q_to_euler),
    ("q_rotate", f"q {_Q}, v {_Q}", att.q_rotate),
    ("q_angle_between", f"a {_Q}, b {_Q}", att.q_angle_between),
    ("q_xyzw_to_wxyz", f"q {_Q}", att.q_xyzw_to_wxyz),
    ("q_slerp", f"a {_Q}, b {_Q}, t DOUBLE", att.q_slerp),
    ("q_to_matrix", f"q {_Q}", att.q_to_matrix),
    ("matrix_to_euler", f"m {_Q}", att.matrix_to_euler),
    ("rotation_matrix", _doubles("roll pitch yaw"), att.rotation_matrix),
    ("mat3_mul", f"a {_Q}, b {_Q}", att.mat3_mul),
    ("mat3_transpose", f"m {_Q}", att.mat3_transpose),
    ("mat3_inv", f"m {_Q}", att.mat3_inv),
    ("normalization_homography", _doubles("roll pitch yaw focal cx cy"), att.normalization_homography),
    ("relative_homography", f"rot_a {_Q}, rot_b {_Q}, focal DOUBLE, cx DOUBLE, cy DOUBLE", att.relative_homography),
    ("tilt_from_accel", _doubles("ax ay az"), att.tilt_from_accel),
    ("mount_rotate", f"mount {_Q}, q {_Q}", att.mount_rotate),
    ("vector_norm", _doubles("x y z"), att.vector_norm),
    ("accel_g", _doubles("x y z"), att.accel_g),
    ("earth_down_accel", _doubles("roll pitch ax ay az"), att.earth_down_accel),
    ("turn_rate_to_bank", _doubles("rate airspeed"), att.turn_rate_to_bank),
    ("bank_to_turn_rate", _doubles("bank airspeed"), att.bank_to_turn_rate),
    ("pose_centre", f"q {_Q}, t {_Q}", att.pose_centre),
    ("v_dot", f"a {_Q}, b {_Q}", att.v_dot),
    ("v_cross", f"a {_Q}, b {_Q}", att.v_cross),
    ("v_rotate", f"v {_Q}, axis {_Q}, angle DOUBLE", att.v_rotate),
    # pressure
    ("altitude_from_pressure", _doubles("hpa level"), pressure.altitude_from_pressure),
    ("sea_level_pressure", _doubles("hpa alt"), pressure.sea_level_pressure),
    ("pressure_from_altitude", _doubles("alt"), pressure.pressure_from_altitude),
    # numbers and vectors
    ("clamp", _doubles("v low high"), values.clamp),
    ("clamp01", _doubles("v"), values.clamp01),
    ("deadband", _doubles("v w"), values.deadband),
    ("minmax_scale", _doubles("v low high to_low to_high"), values.minmax_scale),
    ("num", "v STRING", values.num),
    ("vec3", "v ARRAY<STRING>", values.vec3),
    ("vec_subtract", f"a {_Q}, b {_Q}", values.subtract),
    ("vec_degrees", f"a {_Q}", values.to_degrees),
    ("close_ring", f"corners {_CORNERS}", values.close_ring),
    # text
    ("mission_of_path", "p STRING", values.mission_id),
    ("image_basename", "p STRING", values.basename),
    ("trailing_number", "p STRING", values.trailing_number),
    ("nmea_checksum", "body STRING", values.checksum),
    ("sentence_is_valid", "line STRING", values.sentence_is_valid),
    ("flags_join", "flags ARRAY<STRING>", values.flags_join),
    ("flags_split", "flags STRING", values.flags_split),
    ("xml_escape", "s STRING", values.xml_escape),
    ("model_name", "s STRING", lambda s: values.enum_parse(s, P.MODELS)),
    ("signature", "parts ARRAY<STRING>", lambda parts: values.signature(F.array_join(parts, "\u001f", ""))),
    # time and maps
    ("exif_time", "s STRING", values.exif_time),
    ("epoch_seconds", "ts TIMESTAMP", values.epoch_seconds),
    ("seconds_to_timestamp", "s DOUBLE", values.to_timestamp),
    ("age_ms", "now_ns BIGINT, then_ns BIGINT", values.age_ms),
    ("time_slug", "ts TIMESTAMP", values.time_slug),
    ("utc_stamp", "ts TIMESTAMP", values.utc_stamp),
    ("detail", "details MAP<STRING, STRING>, k STRING, otherwise STRING",
     lambda details, k, otherwise: F.coalesce(F.try_element_at(details, k), otherwise)),
)

# A column prints its operators as functions and its doubles without a suffix; quoted text is left alone.
_PIECES = re.compile(r"(?P<text>'(?:[^'\\]|\\.)*')|(?P<op>[-+*/%^|&<>=!]+|\b(?:and|or|in)\b)\((?=.)|(?<![\w.])(?P<real>\d+\.\d+(?:E-?\d+)?)(?![\w.])|(?P<inf>\bInfinity\b)")


def _piece(m: re.Match) -> str:
    if m["op"]:
        return f"`{m['op']}`("
    if m["real"]:
        return m["real"] + "D"
    return "double('Infinity')" if m["inf"] else m["text"]


def parameter_names(parameters: str) -> list[str]:
    """Names of `a DOUBLE, b STRUCT<x: DOUBLE, y: DOUBLE>`."""
    flat = parameters
    while "<" in flat:
        flat = re.sub(r"<[^<>]*>", "", flat)
    return [p.split()[0] for p in flat.split(",")]


def body(parameters: str, expression: Callable[..., Column]) -> str:
    """The SQL text of the expression over columns named as the parameters."""
    printed = repr(expression(*[F.col(p) for p in parameter_names(parameters)]))
    return _PIECES.sub(_piece, printed.removeprefix("Column<'").removesuffix("'>"))


def register_sql_functions(spark: SparkSession) -> list[str]:
    for name, parameters, expression in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURN {body(parameters, expression)}")
    return [name for name, *_ in SQL_FUNCTIONS]
