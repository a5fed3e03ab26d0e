"""Sinks. Every one is a projection and a distributed write; a mission of any size is never gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightloom.functions.values import close_ring, flags_join, xml_escape
from flightloom.operators.coverage import coverage, footprints
from flightloom.operators.prepare import image_rows, require_rows
from flightloom.operators.reports import endpoints, map_centre
from flightloom.schemas import LOG_COLUMNS, POSE_SCHEMA, log_type
from flightloom.sources.messages import build_packets


def log_columns(df: DataFrame) -> list[Column]:
    """Every log column as text with its fixed decimals; absent ones are null."""
    out = []
    for name, kind in LOG_COLUMNS.items():
        value = F.col(name) if name in df.columns else F.lit(None).cast(log_type(kind))
        if kind.isdigit():
            value = F.format_string(f"%.{kind}f", value.cast("double"))
            value = F.when(F.col(name).isNotNull(), value) if name in df.columns else F.lit(None).cast("string")
        elif kind == "b":
            value = value.cast("boolean").cast("int").cast("string")
        else:
            value = value.cast("string")
        out.append(value.alias(name))
    return out


def _by_mission(df: DataFrame, order: list[str]) -> DataFrame:
    """Range partitions: a large mission becomes several files in time order, small ones share a task."""
    return df.repartitionByRange("mission_id", *order).sortWithinPartitions("mission_id", *order)


def write_mission_log(df: DataFrame, path: str, fmt: str = "csv", order: str = "timestamp", folders: bool = False) -> None:
    """Log files in order of mission and time, their first column the mission: small missions share a file.

    With ``folders``, and for parquet, every mission has a folder of its own and its files the log columns alone;
    the number of files then grows with the missions.
    """
    if fmt == "csv":
        logged = [n for n in LOG_COLUMNS if n in df.columns]
        # values become text after the shuffle, which then moves no column that the log lacks
        rows = _by_mission(df.select("mission_id", F.col(order).alias("_o"), *logged), ["_o"])
        out = rows.select("mission_id", *log_columns(rows))
        if folders:
            out.write.partitionBy("mission_id").option("header", True).csv(path)
        else:  # a mission's name keeps its blanks, as that of a folder does
            named = out.withColumn("mission_id", F.col("mission_id").cast("string"))
            named.write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    else:
        _by_mission(df, [order]).write.partitionBy("mission_id").parquet(path)


def write_packets(df: DataFrame, path: str) -> None:
    build_packets(df, []).write.text(path)


def stream_packets(df: DataFrame, path: str, checkpoint: str):
    """The streaming form; returns the started query."""
    return (
        build_packets(df, []).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def kml_lines(telemetry: DataFrame, slice_s: float = 3600.0) -> DataFrame:
    """A KML document per mission as ordered lines (mission_id, section, seq, line).

    Sections: 0 head with coverage text, 1 path, 2 end of path, 3 footprints, 4 captures, 5 end.
    One line per sample keeps a document of any length distributed.
    """
    c = F.col

    def line(df, section, seq, *parts):
        return df.select("mission_id", F.lit(section).alias("section"), seq.cast("bigint").alias("seq"), F.concat(*parts).alias("line"))

    def lit(text):
        return F.lit(text)

    def text(column, digits=None):
        return (F.format_number(column, digits) if digits is not None else column.cast("string"))

    shapes = footprints(telemetry)
    covered = coverage(shapes, missions=telemetry, slice_s=slice_s)
    head = line(
        covered, 0, F.lit(0),
        lit('<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>Ground Mapping Flight Path</name><description>'),
        lit("Images: "), text(c("image_count")), lit(" Unique coverage estimate: "), F.format_string("%.0f", "unique_area_m2"),
        lit(" m^2 Overlap estimate: "), F.format_string("%.0f", "overlap_area_m2"),
        lit(" m^2</description><Placemark><name>Flight Path</name><LineString><coordinates>"),
    )
    path = line(telemetry, 1, c("seq"), text(c("longitude")), lit(","), text(c("latitude")), lit(","), text(c("baro_altitude")))
    path_end = line(covered, 2, F.lit(0), lit("</coordinates></LineString></Placemark>"))
    ring = F.array_join(
        F.transform(close_ring(c("corners")), lambda p: F.concat(p["lon"].cast("string"), lit(","), p["lat"].cast("string"), lit(",0"))), " "
    )
    polygons = line(
        shapes, 3, c("seq"), lit("<Placemark><name>Footprint: "), xml_escape(c("image_name")),
        lit("</name><Polygon><outerBoundaryIs><LinearRing><coordinates>"), ring,
        lit("</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"),
    )
    points = line(
        image_rows(telemetry), 4, c("seq"), lit("<Placemark><name>"), xml_escape(c("image_name")), lit("</name><Point><coordinates>"),
        text(c("longitude")), lit(","), text(c("latitude")), lit(","), text(c("baro_altitude")), lit("</coordinates></Point></Placemark>"),
    )
    end = line(covered, 5, F.lit(0), lit("</Document></kml>"))
    out = head
    for part in (path, path_end, polygons, points, end):
        out = out.unionByName(part)
    return out


def write_kml(telemetry: DataFrame, path: str) -> None:
    """Text files per mission; joined in name order they are its document."""
    lines = kml_lines(require_rows(telemetry))
    _by_mission(lines, ["section", "seq"]).select("mission_id", "line").write.partitionBy("mission_id").text(path)


def map_layers(telemetry: DataFrame) -> dict[str, DataFrame]:
    """The data behind a map: path, ends, footprints, captures, centre and summary."""
    shapes = footprints(telemetry)
    return {
        "path": telemetry.select("mission_id", "seq", "latitude", "longitude"),
        "ends": endpoints(telemetry),
        "footprints": shapes.select("mission_id", "seq", "image_name", "altitude_m", "width_m", "height_m", "area_m2", "corners"),
        "captures": image_rows(telemetry).select("mission_id", "seq", "t", "image_name", "latitude", "longitude", "gps_altitude", "baro_altitude"),
        "centre": map_centre(telemetry),
        "summary": coverage(shapes, missions=telemetry),
    }


def _csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_quality(quality: DataFrame, path: str) -> None:
    """All verdicts, and the rejected ones apart."""
    _csv(quality.withColumn("flags", flags_join(F.col("flags"))), f"{path}/image_quality")
    rejected = quality.filter(F.col("status") == "REJECTED")
    _csv(rejected.select("mission_id", "image_name", "status", "rejection_reason"), f"{path}/rejected_images")


def edge_columns(edges: DataFrame) -> DataFrame:
    c = F.col
    return edges.select(
        "mission_id", c("source").alias("image_a"), c("target").alias("image_b"), c("time_delta_s").alias("time_difference"),
        c("distance_m").alias("gps_distance"), "altitude_ratio", "predicted_overlap", c("score").alias("candidate_score"),
        c("reason").alias("candidate_reason"),
    )


def write_edges(edges: DataFrame, path: str) -> None:
    _csv(edge_columns(edges), f"{path}/candidate_graph")
    edges.select("mission_id", "source", "target", "score", "reason", "distance_m", "predicted_overlap").write.json(
        f"{path}/candidate_graph_json"
    )


def write_matches(pairs: DataFrame, path: str) -> None:
    """Match counts per pair; needs source, target, raw_matches, matches, inliers, inlier_ratio, model, accepted."""
    c = F.col
    _csv(
        pairs.select(
            "mission_id", "source", "target", "raw_matches", c("matches").alias("filtered_matches"), "inliers", "inlier_ratio",
            "model", "accepted",
        ),
        path,
    )


def write_report(report: DataFrame, path: str, events: DataFrame | None = None) -> None:
    report.write.json(f"{path}/report")
    if events is not None:
        _csv(events.select("mission_id", "mission_time", "severity", "source", "event_type", "message"), f"{path}/events")


def write_poses(poses: DataFrame, path: str) -> None:
    _csv(poses.select(*[part.split()[0] for part in POSE_SCHEMA.split(",")]), path)


def image_id_map(captures: DataFrame, width: float = 3600.0) -> DataFrame:
    """Image names and their 1-based number in time order."""
    from flightloom.operators.timeline import RowNumber, scan

    numbered = scan(captures.select("mission_id", "image_name", "t", "seq"), ["mission_id"], ["t", "seq"], [RowNumber("image_id")], width)
    return numbered.select("mission_id", "image_name", "image_id")


def write_calibration(calibration: DataFrame, path: str) -> None:
    """Nested JSON, one line per device (the columns of reports.calibrate)."""
    c = F.col

    def vec(prefix, names):
        return F.array(*[c(f"{prefix}_{n}") for n in names])

    bias = vec("mean", ("gx", "gy", "gz"))
    nested = calibration.select(
        "mission_id", F.struct(c("samples").alias("imu")).alias("sample_count"),
        F.struct(
            bias.alias("gyro_bias_rads"), F.transform(bias, lambda v: F.degrees(v)).alias("gyro_bias_dps"),
            vec("mean", ("ax", "ay", "az")).alias("accel_level_mps2"), vec("offset", ("mx", "my", "mz")).alias("mag_offset_ut"),
        ).alias("imu"),
        *([F.struct("pressure_mean_hpa", "temperature_mean_c", "sea_level_pressure_hpa").alias("barometer")] if "pressure_mean_hpa" in calibration.columns else []),
    )
    nested.write.partitionBy("mission_id").json(path)
