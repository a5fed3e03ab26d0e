"""Text messages to columns and back: radio packets, bench frames, position sentences. Batch or stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightloom.functions import geo, values
from flightloom.schemas import BENCH_SCHEMA, PACKET, PACKET_SCHEMA


def packet_columns(df: DataFrame) -> list[Column]:
    """The packet's fields from telemetry columns; a column the input lacks is null.

    Fused angles are used where the estimator is valid.
    """
    out = []
    for key, column, digits, kind in PACKET:
        if column in ("roll", "pitch", "yaw") and {"ahrs_valid", f"ahrs_{column}"} <= set(df.columns):
            value = F.when(F.coalesce("ahrs_valid", F.lit(False)), F.col(f"ahrs_{column}")).otherwise(F.col(column))
        elif column in df.columns:
            value = F.col(column)
        else:
            value = F.lit(None)
        value = value.cast(kind)
        out.append((F.round(value, digits) if digits is not None else value).alias(key))
    return out


def build_packets(df: DataFrame, keep: list[str]) -> DataFrame:
    """Compact JSON line per row."""
    return df.select(*keep, F.to_json(F.struct(*packet_columns(df))).alias("value"))


def parse_packets(df: DataFrame, column: str = "value") -> DataFrame:
    """Adds the struct ``packet``; null where the text is no JSON object."""
    # explode keeps the parsed struct as a column; as a plain expression the text would be parsed anew for every field
    parsed = df.withColumn("packet", F.explode(F.array(F.from_json(column, PACKET_SCHEMA))))
    filled = F.coalesce(*[F.when(F.col("packet")[key].isNotNull(), F.lit(True)) for key, *_ in PACKET])
    return parsed.withColumn("packet", F.when(F.trim(column).startswith("{") & filled, F.col("packet")))


def parse_bench_frames(df: DataFrame, column: str = "value") -> DataFrame:
    return df.withColumn("frame", F.when(F.trim(column).startswith("{"), F.from_json(column, BENCH_SCHEMA)))


def guidance_frame(columns: list[Column]) -> Column:
    """The nine-field comma line: frame, time, position, both altitudes and attitude."""
    return F.concat_ws(",", *[c.cast("string") for c in columns])


def parse_nmea(df: DataFrame, column: str = "value", talker: str = r"\w*") -> DataFrame:
    """Adds type, fixed, fix, satellites, hdop, lat, lon, altitude_m, ground_speed_mps and course_deg.

    GGA and RMC of the given talkers are read; other valid sentences only get their type; a wrong
    checksum or a malformed number gives nulls.
    """
    line = F.trim(F.col(column))
    body = F.when(values.sentence_is_valid(line), F.regexp_extract(line, r"^\$(.*)\*", 1))
    df = df.withColumn("_w", F.split(body, ","))
    word = F.col("_w")

    def at(i):
        return F.try_element_at(word, F.lit(i + 1))

    def number(i):
        return F.when(at(i) != "", at(i).try_cast("double"))

    kind = at(0)
    gga, rmc = kind.rlike(f"^{talker}GGA$"), kind.rlike(f"^{talker}RMC$")

    def bad(i):  # present but not a number
        return (F.coalesce(at(i), F.lit("")) != "") & at(i).try_cast("double").isNull()

    gga_ok = gga & at(6).try_cast("int").isNotNull() & at(7).try_cast("int").isNotNull() & (F.size("_w") > 9) & ~bad(8) & ~bad(9)
    rmc_ok = rmc & (F.size("_w") > 8) & ~bad(7) & ~bad(8)

    def pick(from_gga, from_rmc):
        return F.when(gga_ok, from_gga).when(rmc_ok, from_rmc)

    none = F.lit(None).cast("double")
    return df.select(
        *[c for c in df.columns if c != "_w"],
        F.when(kind.isNotNull() & ((~gga & ~rmc) | gga_ok | rmc_ok), kind).alias("type"),
        pick(at(6).try_cast("int") >= 1, at(2) == "A").alias("fixed"),
        F.when(gga_ok, at(6).try_cast("int")).alias("fix"),
        F.when(gga_ok, at(7).try_cast("int")).alias("satellites"),
        F.when(gga_ok, number(8)).alias("hdop"),
        pick(geo.nmea_degrees(at(2), at(3)), geo.nmea_degrees(at(3), at(4))).alias("lat"),
        pick(geo.nmea_degrees(at(4), at(5)), geo.nmea_degrees(at(5), at(6))).alias("lon"),
        pick(number(9), none).alias("altitude_m"),
        F.when(rmc_ok, geo.knots_to_mps(number(7))).alias("ground_speed_mps"),
        F.when(rmc_ok, number(8)).alias("course_deg"),
    )


def first_valid_sentence(df: DataFrame, column: str = "value") -> DataFrame:
    """Adds the first checksum-valid sentence inside noisy text, over the whole text."""
    lines = F.split(column, "\n")
    whole = F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0)))

    def starts(line):
        clean = F.regexp_replace(line, r"^\r+|\r+$", "")
        parts = F.split(clean, r"\$")
        later = F.when(F.size(parts) > 1, F.sequence(F.lit(2), F.size(parts))).otherwise(F.array().cast("array<int>"))
        return F.transform(later, lambda i: F.concat(F.lit("$"), F.array_join(F.slice(parts, i, F.size(parts)), "$")))

    found = F.filter(
        F.flatten(F.transform(whole, starts)), lambda s: s.rlike(r"^\$.*\*[0-9A-Fa-f]{2}$") & values.sentence_is_valid(s)
    )
    return df.withColumn("sentence", F.try_element_at(found, F.lit(1)))
