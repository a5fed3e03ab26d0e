"""Queries: messages, files and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from flightloom import params as P
from flightloom.functions import values
from flightloom.plans import catalog_stateful as cs
from flightloom.plans.registry import ORACLES, query
from flightloom.plans.sqltext import CELLS, FOOTPRINTS, r
from flightloom.session import cut_lineage, shared_folder
from flightloom.sources import messages, readers, writers
from flightloom.streaming import streams

c = F.col


def scratch(d) -> str:
    return f"{shared_folder(d.spark).rstrip('/')}/files-{uuid.uuid4().hex}"


def packets(d):
    rows = d.fx_capture.select(
        "*", c("seq").alias("telemetry_sequence"), F.lit("DESCENT").alias("state"), c("t").alias("mission_time"),
        (c("event_id") % 2 == 0).alias("ahrs_valid"), *[(c(x) * 2).alias(f"ahrs_{x}") for x in ("roll", "pitch", "yaw")],
    )
    return messages.build_packets(rows, ["mission_id", "seq", "event_id"])


PACKET_SQL = f"""select mission_id, seq, case when event_id % 10 <> 0 then seq end as p_seq, case when event_id % 10 <> 0 then {r('latitude')} end as p_lat,
  case when event_id % 10 <> 0 then image_name end as p_img, case when event_id % 10 <> 0 then case when event_id % 2 = 0 then roll * 2 else roll end end as p_r,
  case when event_id % 10 <> 0 then baro_altitude end as p_alt from fx_capture"""


@query("packet_round_trip", ["fx_capture"], PACKET_SQL)
def packet_round_trip(d):
    broken = F.when(c("event_id") % 10 == 0, F.lit("garbled")).otherwise(c("value"))
    out = messages.parse_packets(packets(d).withColumn("value", broken))
    return out.select(
        "mission_id", "seq", c("packet.seq").alias("p_seq"), F.round("packet.lat", 6).alias("p_lat"), c("packet.img").alias("p_img"),
        c("packet.r").alias("p_r"), c("packet.alt").alias("p_alt"),
    )


@query("packet_files", ["fx_capture"], "select seq as p_seq, image_name as p_img, t as p_t from fx_capture")
def packet_files(d):
    path = scratch(d)
    rows = d.fx_capture.select("*", c("seq").alias("telemetry_sequence"), c("t").alias("mission_time"))
    writers.write_packets(rows, path)
    out = messages.parse_packets(d.spark.read.text(path))
    return out.select(c("packet.seq").alias("p_seq"), c("packet.img").alias("p_img"), c("packet.t").alias("p_t"))


@query("bench_frames", ["fx_imu"], "select mission_id, seq, case when seq % 9 <> 0 then ax end as ax, case when seq % 9 <> 0 then mz end as mz from fx_imu")
def bench_frames(d):
    text = F.when(c("seq") % 9 != 0, F.to_json(F.struct((c("seq") / 100).alias("t"), "ax", "ay", "az", "gx", "gy", "gz", "mx", "my", "mz"))).otherwise("{oops")
    out = messages.parse_bench_frames(d.fx_imu.withColumn("value", text))
    return out.select("mission_id", "seq", c("frame.ax").alias("ax"), c("frame.mz").alias("mz"))


def nmea_lines(d):
    """GGA, RMC and others in turn; one in ten with a wrong checksum, one in fourteen with a bad number."""
    g = d.fx_gps

    def coded(value, width):
        whole = F.floor(value).cast("int")
        return F.concat(F.lpad((whole).cast("string"), width, "0"), F.format_string("%07.4f", (value - whole) * 60))

    lat, lon = coded(c("latitude"), 2), coded(c("longitude"), 3)
    hdop = F.when(c("seq") % 14 == 0, F.lit("x.y")).otherwise(c("hdop").cast("string"))
    gga = F.concat_ws(",", F.lit("GNGGA"), F.lit("120000"), lat, F.lit("N"), lon, F.lit("W"), F.when(c("fix_type") == "3D", "1").otherwise("0"), c("satellites").cast("string"), hdop, c("altitude_m").cast("string"), F.lit("M"))
    rmc = F.concat_ws(",", F.lit("GPRMC"), F.lit("120000"), F.lit("A"), lat, F.lit("S"), lon, F.lit("E"), c("ground_speed_mps").cast("string"), c("course_deg").cast("string"))
    body = F.when(c("seq") % 3 == 0, gga).when(c("seq") % 3 == 1, rmc).otherwise(F.lit("GPGSV,1,1,00"))
    code = values.checksum(body) + F.when(c("seq") % 10 == 0, 1).otherwise(0)
    return g.select(
        "mission_id", "seq", F.concat(F.lit("$"), body, F.lit("*"), F.lpad(F.hex(code), 2, "0")).alias("value")
    )


NMEA_SQL = """n as (select *, seq % 10 <> 0 and not (seq % 3 = 0 and seq % 14 = 0) as good,
    floor(latitude) + cast(round((latitude - floor(latitude)) * 60, 4) as double) / 60 as la, floor(longitude) + cast(round((longitude - floor(longitude)) * 60, 4) as double) / 60 as lo from fx_gps),
  p as (select mission_id, seq, case when good then case seq % 3 when 0 then 'GNGGA' when 1 then 'GPRMC' else 'GPGSV' end end as type,
    case when good then case seq % 3 when 0 then fix_type = '3D' when 1 then true end end as fixed, case when good and seq % 3 = 0 then satellites end as satellites,
    case when good then case seq % 3 when 0 then la when 1 then -la end end as lat, case when good then case seq % 3 when 0 then -lo when 1 then lo end end as lon,
    case when good and seq % 3 = 0 then altitude_m end as altitude_m, case when good and seq % 3 = 1 then ground_speed_mps * 0.514444 end as ground_speed_mps from n)"""


@query(
    "nmea_sentences", ["fx_gps"],
    f"with {NMEA_SQL} select mission_id, seq, type, fixed, cast(satellites as integer) as satellites, {r('lat', 5)} as lat, {r('lon', 5)} as lon, altitude_m, {r('ground_speed_mps')} as ground_speed_mps from p",
)
def nmea_sentences(d):
    out = messages.parse_nmea(nmea_lines(d))
    return out.select(
        "mission_id", "seq", "type", "fixed", "satellites", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), "altitude_m",
        F.round("ground_speed_mps", 6).alias("ground_speed_mps"),
    )


@query(
    "fix_summary", ["fx_gps"],
    f"with {NMEA_SQL} select mission_id, count(type) as sentences, coalesce(bool_or(fixed), false) as any_fix, {r('last(lat order by seq) filter (where fixed)', 5)} as last_lat, {r('last(lon order by seq) filter (where fixed)', 5)} as last_lon from p group by 1",
)
def fix_summary(d):
    from flightloom.operators.reports import fix_summary as summary

    out = summary(messages.parse_nmea(nmea_lines(d)))
    return out.select("mission_id", "sentences", "any_fix", F.round("last_lat", 5).alias("last_lat"), F.round("last_lon", 5).alias("last_lon"))


@query(
    "sentence_search", ["fx_gps"],
    "select mission_id, seq, seq % 10 <> 0 as found, case when seq % 10 <> 0 then case seq % 3 when 0 then 'GNGGA' when 1 then 'GPRMC' else 'GPGSV' end end as kind from fx_gps",
)
def sentence_search(d):
    noisy = F.concat(F.lit("#!$xy*00\n$ab"), c("value"), F.lit("\r\n$tail"))
    out = messages.first_valid_sentence(nmea_lines(d).withColumn("value", noisy))
    return out.select("mission_id", "seq", c("sentence").isNotNull().alias("found"), F.substring("sentence", 2, 5).alias("kind"))


@query(
    "exif_captures", ["fx_base"],
    f"""with x as (select *, case when event_id % 4 <> 0 then cast(epoch(date_trunc('second', ts)) as double) end as taken from fx_base),
    b as (select mission_id, first(taken order by seq) filter (where taken is not null) as base from x group by 1)
    select mission_id, seq, coalesce(taken - base, cast(seq - 1 as double)) as t, {r('case when event_id % 6 <> 0 then -(18 + (event_id % 60) / 60.0 + (event_id % 50) / 3600.0) else 0 end')} as latitude,
      case when event_id % 5 = 0 then -120.5::double else 120.5::double end as gps_altitude, 3120.0::double as focal_px from x join b using (mission_id)""",
)
def exif_captures(d):
    e = c("event_id")
    have = e % 6 != 0
    attrs = d.fx_base.select(
        "mission_id", c("seq").alias("position"), F.concat(F.lit("i"), c("seq").cast("string"), F.lit(".jpg")).alias("image_name"),
        F.when(have, 18.0).alias("lat_deg"), (e % 60).cast("double").alias("lat_min"), (e % 50).cast("double").alias("lat_sec"), F.lit("S").alias("lat_ref"),
        F.when(have, 73.0).alias("lon_deg"), F.lit(0.0).alias("lon_min"), F.lit(0.0).alias("lon_sec"), F.lit(None).cast("string").alias("lon_ref"),
        F.lit(120.5).alias("altitude"), F.when(e % 5 == 0, 1).otherwise(0).alias("altitude_ref"),
        F.when(e % 4 != 0, F.date_format("ts", "yyyy:MM:dd HH:mm:ss")).alias("taken"), F.lit(4000).alias("width_px"), F.lit(3000).alias("height_px"),
    )
    out = readers.captures_from_exif(attrs)
    return out.select("mission_id", "seq", "t", F.round("latitude", 6).alias("latitude"), "gps_altitude", c("camera.focal_px").alias("focal_px"))


@query(
    "mission_log_files", ["fx_capture"],
    f"select mission_id, image_name, t, {r('latitude')} as latitude, {r('longitude')} as longitude, baro_altitude, yaw, event_id % 2 = 0 as ahrs_valid, event_id as telemetry_sequence from fx_capture",
)
def mission_log_files(d):
    path = scratch(d)
    rows = d.fx_capture.select(
        "*", c("t").alias("timestamp"), F.lit("DESCENT").alias("state"), (c("event_id") % 2 == 0).alias("ahrs_valid"), c("event_id").alias("telemetry_sequence")
    )
    writers.write_mission_log(rows, path)
    kept, _ = readers.read_mission_log(d.spark, path)
    return kept.select(
        c("mission_id").cast("bigint").alias("mission_id"), "image_name", c("timestamp").alias("t"), F.round("latitude", 6).alias("latitude"),
        F.round("longitude", 6).alias("longitude"), "baro_altitude", "yaw", "ahrs_valid", "telemetry_sequence",
    )


@query(
    "quality_files", ["fx_pixel", "fx_capture"],
    None,
)
def quality_files(d):
    from flightloom.plans.catalog_pairs import quality

    path = scratch(d)
    writers.write_quality(quality(d), path)
    return d.spark.read.schema("mission_id bigint, image_name string, status string, rejection_reason string").option("header", True).csv(f"{path}/rejected_images")


def _quality_sql():
    from flightloom.plans import derived
    from flightloom.plans.catalog_pairs import QUALITY

    ORACLES["quality_files"] = derived.with_views(
        ["fx_pixel", "fx_capture"],
        f"with {QUALITY} select mission_id, image_name, status, case when flags = '' then 'low_score' else flags end as rejection_reason from quality where status = 'REJECTED'",
    )


_quality_sql()


@query(
    "kml_documents", ["fx_capture"],
    f"""with {FOOTPRINTS}
    select mission_id, section, count(*) as lines from (select mission_id, unnest([0, 2, 5]) as section from (select distinct mission_id from fx_capture)
      union all select mission_id, 1 from fx_capture union all select mission_id, 3 from shape union all select mission_id, 4 from fx_capture) group by 1, 2""",
)
def kml_documents(d):
    return writers.kml_lines(d.fx_capture).groupBy("mission_id", "section").agg(F.count("line").alias("lines"))


@query(
    "map_layer_counts", ["fx_capture"],
    f"""with {FOOTPRINTS}, {CELLS}, u as (select mission_id, count(*) * 25.0::double as area from (select distinct mission_id, cx, cy from cells) group by 1),
    s as (select mission_id, count(*) as shapes from shape group by 1)
    select mission_id, n as path_rows, coalesce(shapes, 0) as footprints, n as captures, {r('clat')} as centre_lat, coalesce(area, 0) as unique_area_m2
    from (select mission_id, count(*) as n, avg(latitude) as clat from fx_capture group by 1) left join s using (mission_id) left join u using (mission_id)""",
)
def map_layer_counts(d):
    layers = writers.map_layers(d.fx_capture)

    def n(name, alias):
        return layers[name].groupBy("mission_id").agg(F.count(F.lit(1)).alias(alias))

    out = n("path", "path_rows").join(n("footprints", "footprints"), "mission_id", "left").join(n("captures", "captures"), "mission_id")
    out = out.join(layers["centre"], "mission_id").join(layers["summary"], "mission_id").fillna(0, ["footprints"])
    return out.select("mission_id", "path_rows", "footprints", "captures", F.round("centre_lat", 6).alias("centre_lat"), "unique_area_m2")


@query("image_id_map", ["fx_capture"], "select mission_id, image_name, row_number() over (partition by mission_id order by t, seq) as image_id from fx_capture")
def image_id_map(d):
    return writers.image_id_map(d.fx_capture)


# -- streams: the rows of the batch query over the same data ----------------
CUTS = [20.0, 45.0]


def twin(name, uses=()):
    """Register a stream under the SQL of its batch form."""

    def add(fn):
        query(f"stream_{name}", uses)(fn)
        ORACLES[f"stream_{name}"] = ORACLES[name]
        return fn

    return add


@twin("debounced_events")
def stream_debounced_events(d):
    out = streams.drain(streams.debounce_stream(streams.replay(d.fx_event, "t", [14.0, 31.5], closing=1e6)))
    return out.select("mission_id", "seq", "source", "event_code")


@twin("gps_validation")
def stream_gps_validation(d):
    out = streams.drain(streams.validate_gps_stream(streams.replay(d.fx_gps, "seq", CUTS, closing=10**6), F.timestamp_seconds("seq")))
    return out.select("mission_id", "seq", "reason", (c("reason") == "GPS_VALID").alias("valid"), F.round("distance_m", 4).alias("distance_m"))


@twin("flight_phases")
def stream_flight_phases(d):
    df = d.fx_flight.withColumn("raw_accel_x", F.lit(0.0)).withColumn("raw_accel_y", F.lit(0.0))
    out = streams.drain(streams.flight_phase_stream(streams.replay(df, "t", CUTS, closing=1e6)))
    return out.select("mission_id", "seq", "phase", "entered", "phase_reason")


@query("stream_packets", ["fx_capture"], "select mission_id, seq, image_name as img, t from fx_capture")
def stream_packets(d):
    # missions follow each other, each with a start of its own; a third of all packets come twice
    sent = cut_lineage(packets(d).select("mission_id", "seq", "value"))
    repeated = sent.unionByName(sent.filter(c("seq") % 3 == 0))
    bounds = sent.agg(F.percentile("mission_id", [0.3, 0.7]).alias("p")).first()["p"] or []
    start = F.lit(1_700_000_000.0) + F.pmod(c("mission_id") * 7919, F.lit(1000)) * 86_400.0
    out = streams.drain(streams.packet_stream(streams.replay(repeated, "mission_id", bounds).select("mission_id", "value"), start))
    return out.select("mission_id", "seq", "img", "t")


@query(
    "stream_rate_windows", ["fx_base"],
    "select mission_id, epoch_us(time_bucket(interval '1 hour', ts)) as window_us, count(*) as n, count(*) / 3600.0::double as actual_hz from fx_base group by 1, 2",
)
def stream_rate_windows(d):
    df = d.fx_base.select("mission_id", "seq", c("ts").cast("timestamp").alias("ts"))
    source = streams.replay(df.withColumn("day", F.dayofmonth("ts")), "day", [10, 20])
    out = streams.drain_windows(streams.rate_stream(source, 3600.0, ["mission_id"]), ["mission_id", "window_start"])
    return out.select("mission_id", F.unix_micros("window_start").alias("window_us"), "n", "actual_hz")


@query(
    "stream_sync_warnings", ["fx_capture", "fx_worker"],
    f"""with s as (select mission_id, t * 2 - 0.5 as t, case when worker = 'click' then 'GPS' else 'IMU' end as sensor from fx_worker where ok),
    a as (select c.mission_id, c.seq, coalesce((c.t - max(s.t) filter (where sensor = 'GPS')) * 1000, -1) as gps_age_ms, coalesce((c.t - max(s.t) filter (where sensor = 'IMU')) * 1000, -1) as imu_age_ms
      from fx_capture c left join s on s.mission_id = c.mission_id and s.t <= c.t group by c.mission_id, c.seq, c.t)
    select mission_id, seq, {r('gps_age_ms', 3)} as gps_age_ms, {r('imu_age_ms', 3)} as imu_age_ms from a where greatest(gps_age_ms, imu_age_ms) > 3000""",
)
def stream_sync_warnings(d):
    samples = d.fx_worker.filter("ok").select(
        "mission_id", (c("t") * 2 - 0.5).alias("t"), "seq", F.lit(0).alias("side"), F.when(c("worker") == "click", "GPS").otherwise("IMU").alias("sensor")
    )
    shots = d.fx_capture.select("mission_id", "t", "seq", F.lit(1).alias("side"), F.lit(None).cast("string").alias("sensor"))
    source = streams.replay(samples.unionByName(shots), "t", [40.0, 90.0], closing=1e6)
    out = streams.drain(streams.sync_warnings(source, ["GPS", "IMU"], 3000.0))
    return out.select("mission_id", "seq", F.round("gps_age_ms", 3).alias("gps_age_ms"), F.round("imu_age_ms", 3).alias("imu_age_ms"))


@query(
    "stream_stale_workers", ["fx_worker"],
    f"""with g as (select mission_id, worker, t, lead(t) over (partition by mission_id, worker order by t) as later, max(t) over () as over_ from fx_worker where ok)
    select mission_id, worker, 'STALE' as status, t + {P.STALE_S}::double as at_s from g where coalesce(later, over_) - t > {P.STALE_S}
    union all select mission_id, worker, 'HEALTHY', later from g where later - t > {P.STALE_S}""",
)
def stream_stale_workers(d):
    ok = d.fx_worker.filter("ok").select("mission_id", "worker", "t", F.timestamp_micros((c("t") * 1e6).cast("bigint")).alias("ts"))
    return streams.drain(streams.stale_stream(streams.replay(ok, "t", CUTS)))
