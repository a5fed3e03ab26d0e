"""Numbers, vectors, text, time and JSON helpers, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# numbers -----------------------------------------------------------------
def num(value: Column, default: float = 0.0) -> Column:
    """Tolerant number: null, NaN and text that is no number become the default."""
    return F.coalesce(F.nanvl(value.try_cast("double"), F.lit(None).cast("double")), F.lit(float(default)))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def clamp01(value: Column) -> Column:
    return clamp(value, 0.0, 1.0)


def deadband(value: Column, width: float) -> Column:
    return F.when(F.abs(value) < width, 0.0).otherwise(value)


def minmax_scale(value: Column, low: Column, high: Column, to_low: float, to_high: float) -> Column:
    return F.lit(to_low) + (value - low) / F.greatest(high - low, F.lit(1e-9)) * (to_high - to_low)


# vectors -----------------------------------------------------------------
def vec3(value: Column) -> Column:
    """Three numbers, or null for anything else."""
    cast = F.transform(value, lambda v: v.try_cast("double"))
    return F.when((F.size(value) == 3) & ~F.exists(cast, lambda v: v.isNull()), cast)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def to_degrees(a: Column) -> Column:
    return F.transform(a, lambda v: F.degrees(v))


def close_ring(corners: Column) -> Column:
    return F.concat(corners, F.slice(corners, 1, 1))


# text --------------------------------------------------------------------
def mission_id(path: Column) -> Column:
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    return F.replace(stem, F.lit("flight_log_"), F.lit("mission_"))


def basename(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def trailing_number(name: Column) -> Column:
    """The last run of digits in the file stem, or null."""
    stem = F.regexp_replace(basename(name), r"\.[^.]*$", "")
    return F.try_element_at(F.regexp_extract_all(stem, F.lit(r"(\d+)")), F.lit(-1)).try_cast("bigint")


def checksum(body: Column) -> Column:
    """Exclusive-or of the character codes."""
    codes = F.transform(F.split(body, ""), lambda ch: F.ascii(ch))
    return F.aggregate(codes, F.lit(0), lambda acc, code: acc.bitwiseXOR(code))


def sentence_is_valid(line: Column) -> Column:
    """``$body*hh``: starts with a dollar sign and the hex suffix equals the checksum of the body."""
    body = F.regexp_extract(line, r"^\$(.*)\*", 1)
    suffix = F.substring_index(line, "*", -1)
    shaped = line.rlike(r"^\$.*\*\s*[0-9A-Fa-f]+\s*$")
    return F.coalesce(shaped & (F.conv(F.trim(suffix), 16, 10).try_cast("int") == checksum(body)), F.lit(False))


def flags_join(flags: Column) -> Column:
    return F.array_join(flags, ";")


def flags_split(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ";"))


def xml_escape(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def enum_parse(text: Column, allowed: tuple[str, ...]) -> Column:
    upper = F.upper(text)
    return F.when(upper.isin(*allowed), upper)


def signature(*parts: Column) -> Column:
    """sha-256 over the parts joined by a unit separator."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


# time --------------------------------------------------------------------
def exif_time(text: Column) -> Column:
    """Seconds since the epoch from the two date formats in use, else null."""
    parsed = F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))
    )
    return F.unix_seconds(parsed).cast("double")


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def to_timestamp(seconds: Column) -> Column:
    return F.timestamp_micros(F.round(seconds * 1e6).try_cast("bigint"))


def age_ms(now_ns: Column, then_ns: Column) -> Column:
    return (now_ns - then_ns) / F.lit(1e6)


def time_slug(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def utc_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


# maps --------------------------------------------------------------------
def details(**fields: Column) -> Column:
    pairs = [F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in fields.items()]
    return F.map_from_entries(F.array(*pairs))


def lookup(mapping: Column, key: str, default: str) -> Column:
    return F.coalesce(F.try_element_at(mapping, F.lit(key)), F.lit(default))
