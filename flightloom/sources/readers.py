"""Readers: logs, images, points, calibration, poses. Schemas are fixed, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightloom import params as P
from flightloom.functions import geo, values
from flightloom.operators.timeline import FirstOf, RowNumber, scan
from flightloom.schemas import CALIBRATION_SCHEMA, DATASET_COLUMNS, LOG_COLUMNS, POSE_SCHEMA, log_type

IMAGE_GLOB_LIVE = "*.{jpg,jpeg,png,JPG,JPEG,PNG}"
IMAGE_GLOB_DATASET = "*.{jpg,jpeg,png,tif,tiff,JPG,JPEG,PNG,TIF,TIFF}"


def _typed(name: str, kind: str) -> Column:
    raw = F.trim(F.col(name))
    if kind == "s":
        # a writer that had no value put 0 there
        return F.when(~raw.isin("0", ""), raw).alias(name)
    if kind == "b":
        return (raw.try_cast("double") != 0).alias(name)
    number = raw.try_cast("double")
    number = F.when(~F.isnan(number), number)
    return (number.cast("bigint") if kind == "i" else number).alias(name)


def read_mission_log(spark: SparkSession, path: str, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(telemetry, rejects) of any number of log files.

    A row may be short (trailing columns are null); a row with too many tokens was shifted by a
    comma in a text and goes to the rejects as a raw line. The mission is the first column of files
    whose header begins with it, as write_mission_log makes them; otherwise the folder or file names it.
    """
    names = columns or list(LOG_COLUMNS)
    lines = spark.read.text(path)
    head = lines.filter(F.col("_metadata.file_block_start") == 0).first()
    in_rows = head is not None and head.value.split(",")[0] == "mission_id"
    held = ["mission_id", *names] if in_rows else names
    # one column more than the layout has, so that a row with too many tokens shows; empty texts stay texts
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*held, "_extra"]])
    raw = (
        spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("nullValue", "\u0000")
        .csv(path)
    )
    if "mission_id" not in raw.columns:  # otherwise the row or the folder names it
        raw = raw.select("*", values.mission_id(F.col("_metadata.file_path")).alias("mission_id"))
    kept = raw.filter(F.col("_extra").isNull()).select("mission_id", *[_typed(n, LOG_COLUMNS[n]) for n in names])
    unquoted = F.regexp_replace("value", r'"[^"]*"', "")
    long = lines.filter(F.size(F.split(unquoted, ",")) > len(held))
    if in_rows:
        long = long.select("value", F.from_csv("value", "mission_id string")["mission_id"].alias("mission_id"))
    elif "mission_id" not in long.columns:
        long = long.select("value", values.mission_id(F.col("_metadata.file_path")).alias("mission_id"))
    return kept, long.select("mission_id", F.col("value").alias("line"))


def read_dataset_log(spark: SparkSession, path: str) -> DataFrame:
    """A log of images without telemetry, in the layout of a mission log."""
    kept, _ = read_mission_log(spark, path, DATASET_COLUMNS)
    absent = [F.lit(None).cast(log_type(k)).alias(n) for n, k in LOG_COLUMNS.items() if n not in DATASET_COLUMNS]
    return kept.select("*", *absent).select("mission_id", *LOG_COLUMNS)


def list_images(spark: SparkSession, path: str, dataset: bool = False) -> DataFrame:
    """Name, size and time of image files; their content is never read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", IMAGE_GLOB_DATASET if dataset else IMAGE_GLOB_LIVE).load(path)
    )
    return files.select(
        "path", values.basename(F.col("path")).alias("image_name"), "length", F.col("modificationTime").alias("modified")
    )


def captures_from_exif(attrs: DataFrame, width: float = 1e6) -> DataFrame:
    """Captures from extracted image attributes.

    Needs mission_id, position (1-based order of the images), image_name, lat_deg, lat_min, lat_sec,
    lat_ref, lon_*, altitude, altitude_ref, taken (text), width_px, height_px. Time counts from the
    first dated image; an undated one gets its index.
    """
    c = F.col
    at = values.exif_time(c("taken"))
    dated = scan(
        attrs.withColumn("_at", at), ["mission_id"], ["position"], [FirstOf("_base", c("_at"), c("_at").isNotNull())], width
    )

    def degrees(axis, default):
        ref = F.coalesce(F.col(f"{axis}_ref"), F.lit(default))
        return F.coalesce(geo.dms_to_decimal(c(f"{axis}_deg"), c(f"{axis}_min"), c(f"{axis}_sec"), ref), F.lit(0.0))

    w = F.coalesce(c("width_px"), F.lit(P.SENSOR_WIDTH_PX)).cast("double")
    h = F.coalesce(c("height_px"), F.lit(P.SENSOR_HEIGHT_PX)).cast("double")
    height = F.when(F.coalesce(c("altitude_ref"), F.lit(0)) == 1, -c("altitude")).otherwise(c("altitude"))
    t = F.coalesce(c("_at") - c("_base"), (c("position") - 1).cast("double"))
    zeros = [F.lit(0.0).alias(n) for n in ("baro_altitude", "roll", "pitch", "yaw", "gyro_x", "gyro_y", "gyro_z")]
    camera = F.struct(
        w.alias("width_px"), h.alias("height_px"), (F.greatest(w, h) * 0.78).alias("focal_px"),
        (w / 2).alias("center_x_px"), (h / 2).alias("center_y_px"), F.array(*[F.lit(0.0)] * 5).alias("distortion"),
    )
    return dated.select(
        "mission_id", c("position").alias("seq"), t.alias("t"), "image_name", degrees("lat", "N").alias("latitude"),
        degrees("lon", "E").alias("longitude"), F.coalesce(height, F.lit(0.0)).alias("gps_altitude"), *zeros,
        camera.alias("camera"), F.lit("DATASET_TEST").alias("state"),
    )


def read_points(spark: SparkSession, path: str, block_bytes: float = 64e6) -> DataFrame:
    """x, y, z of point clouds: parquet with those columns, or ASCII PLY text.

    Lines are numbered by file position, so that the vertex block is exactly the lines the header
    announces; a vertex line with too few numbers is left out.
    """
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path).select("x", "y", "z")
    c = F.col
    lines = spark.read.text(path).select(
        F.trim("value").alias("value"), c("_metadata.file_path").alias("file"),
        c("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"),
    )
    numbered = scan(lines, ["file"], ["_at", "_id"], [RowNumber("no")], block_bytes)
    # header lines start with a word, data lines with a number
    head = numbered.filter(c("value").rlike(r"^(element|property|end_header)")).groupBy("file").agg(
        F.array_sort(F.collect_list(F.struct("no", "value"))).alias("head")
    )
    tokens = F.transform("head", lambda x: F.split(x["value"], r"\s+"))
    vertex_at = F.array_position(F.transform(tokens, lambda w: F.concat_ws(" ", F.slice(w, 1, 2))), "element vertex")
    shaped = head.select(
        "file", tokens.alias("words"), vertex_at.cast("int").alias("v"), F.element_at("head", -1)["no"].alias("end"),
    ).withColumn("after", F.slice("words", c("v") + 1, F.size("words")))
    stop = F.filter(F.sequence(F.lit(1), F.size("after")), lambda i: F.element_at(c("after"), i)[0] != "property")
    shaped = shaped.withColumn("names", F.transform(F.slice("after", F.lit(1), stop[0] - 1), lambda w: F.element_at(w, -1)))
    layout = shaped.select(
        "file", "end", c("words")[c("v") - 1][2].cast("bigint").alias("count"), F.size("names").alias("_w"),
        *[F.array_position("names", a).cast("int").alias(f"i{a}") for a in "xyz"],
    )
    rows = numbered.join(layout, "file").filter((c("no") > c("end")) & (c("no") <= c("end") + c("count")))
    parts = F.split("value", r"\s+")
    placed = rows.withColumn("_p", parts).filter(F.size("_p") >= F.greatest("ix", "iy", "iz"))
    out = placed.select(*[F.element_at("_p", c(f"i{a}")).try_cast("double").alias(a) for a in "xyz"])
    return out.filter(c("x").isNotNull() & c("y").isNotNull() & c("z").isNotNull())


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """One row per readable calibration file: bias, offset and sea-level pressure (null when implausible)."""
    c = F.col
    raw = spark.read.schema(CALIBRATION_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    level = c("barometer.sea_level_pressure_hpa")
    return raw.select(
        values.mission_id(c("_metadata.file_path")).alias("mission_id"),
        values.vec3(c("imu.gyro_bias_rads")).alias("bias"), values.vec3(c("imu.mag_offset_ut")).alias("offset"),
        F.when(level.between(P.SEA_LEVEL_MIN_HPA, P.SEA_LEVEL_MAX_HPA), level).alias("sea_level_pressure_hpa"),
        (c("imu").isNotNull() | c("barometer").isNotNull()).alias("_ok"),
    ).filter("_ok").drop("_ok")


def read_camera_poses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POSE_SCHEMA).option("header", True).csv(path)
