"""Flight-shaped views over the given tables; the text of each view serves both engines.

``{name}`` marks another view, so Spark gets it as a DataFrame and the SQL check as a CTE.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightloom.operators.timeline import RowNumber, Whole, scan

BASE_SQL = """
select user_id as mission_id, event_id,
  cast(row_number() over (partition by user_id order by ts, event_id) as bigint) as seq,
  count(*) over (partition by user_id) as n,
  ts, event_type, value, cast(floor(value) as bigint) as vi
from events
"""

VIEWS = {
    "fx_capture": """
select mission_id, event_id, seq, cast(2 * seq as double) as t,
  concat('img_', lpad(cast(seq as varchar(10)), 5, '0'), '.jpg') as image_name,
  case when event_id % 29 = 0 then cast(0 as double) else cast(18520400 + 20 * seq + (event_id * 37) % 11 - 5 as double) / 1000000 end as latitude,
  case when event_id % 29 = 0 then cast(0 as double) else cast(73856700 + 12 * seq + (event_id * 41) % 13 - 6 as double) / 1000000 end as longitude,
  cast(22 + vi % 40 as double) as gps_altitude,
  case when event_id % 17 = 0 then cast(0 as double) else cast(20 + vi % 40 as double) end as baro_altitude,
  cast((event_id * 13) % 41 - 20 as double) as roll,
  cast((event_id * 17) % 31 - 15 as double) as pitch,
  cast((event_id * 8) % 360 as double) as yaw,
  cast((event_id * 7) % 101 - 50 as double) as gyro_x,
  cast((event_id * 11) % 91 - 45 as double) as gyro_y,
  cast((event_id * 5) % 61 - 30 as double) as gyro_z
from {fx_base}""",
    "fx_flight": """
select mission_id, seq, cast(seq as double) as t,
  case when 10 * seq <= n then cast(0 as double)
       when 10 * seq <= 4 * n then floor(cast(1000 * (10 * seq - n) as double) / (3 * n))
       when 10 * seq <= 8 * n then floor(cast(1000 * (8 * n - 10 * seq) as double) / (4 * n))
       else cast(0 as double) end as baro_altitude,
  case when 10 * seq > n and 10 * seq <= 2 * n then cast(22 as double) else cast(980665 as double) / 100000 end as raw_accel_z
from {fx_base}""",
    "fx_gps": """
select mission_id, seq, cast(1000000000000 as bigint) + 500000000 * seq as ts_ns,
  cast(18520400 + 20 * seq + case when event_id % 53 = 0 then 10000 else 0 end as double) / 1000000 as latitude,
  cast(73856700 + 12 * seq as double) / 1000000 as longitude,
  cast(100 + vi % 40 as double) as altitude_m,
  case when event_id % 23 = 0 then 'NO FIX' else '3D' end as fix_type,
  4 + event_id % 9 as satellites,
  cast(5 + (event_id * 3) % 40 as double) / 10 as hdop,
  cast(vi % 20 as double) as ground_speed_mps,
  cast((event_id * 8) % 360 as double) as course_deg
from {fx_base}""",
    "fx_imu": """
select mission_id, seq, 10000000 * seq as ts_ns,
  cast((event_id * 7) % 21 - 10 as double) / 100 as gx, cast((event_id * 11) % 21 - 10 as double) / 100 as gy, cast((event_id * 5) % 21 - 10 as double) / 100 as gz,
  cast((event_id * 3) % 41 - 20 as double) / 10 as ax, cast((event_id * 9) % 41 - 20 as double) / 10 as ay, cast(70 + (event_id * 13) % 60 as double) / 10 as az,
  cast(20 + event_id % 15 as double) as mx, cast(event_id % 9 - 4 as double) as my, cast(30 + event_id % 70 as double) as mz
from {fx_base}""",
    "fx_worker": """
select mission_id, event_type as worker, seq, cast(seq as double) as t, event_id % 6 <> 0 as ok,
  case when event_id % 6 = 0 then concat('err', cast(event_id % 4 as varchar(10))) else '' end as error
from {fx_base}""",
    "fx_event": """
select mission_id, seq, cast(7 * seq as double) / 10 as t,
  case when event_id % 10 = 0 then 'ERROR' when event_id % 3 = 0 then 'WARN' else 'INFO' end as severity,
  event_type as source, concat('E', cast(event_id % 2 as varchar(10))) as event_code, concat('m', cast(event_id % 2 as varchar(10))) as message
from {fx_base}""",
    "fx_power": """
select mission_id, seq, cast(460 + (event_id * 3) % 60 as double) / 100 as bus_voltage_v, cast(30 + (event_id * 7) % 200 as double) / 100 as current_a
from {fx_base}""",
    "fx_file": """
select mission_id, image_name, 1000 + event_id % 977 as length from {fx_capture} where event_id % 19 <> 0
union all select mission_id, concat('orphan_', cast(seq as varchar(10)), '.jpg'), cast(10 as bigint) from {fx_capture} where event_id % 31 = 0""",
    "fx_match": """
select a.mission_id, a.image_name as source, b.image_name as target, a.event_id % 5 as query_idx, b.event_id % 5 as train_idx
from {fx_capture} a join {fx_capture} b on a.mission_id = b.mission_id and b.seq = a.seq + 1 where a.event_id % 4 <> 0""",
    "fx_geometry": """
select mission_id, seq, m.model, 8 + event_id % 40 as matches, (event_id * m.k) % 30 as inliers
from {fx_base} cross join (select 'ESSENTIAL' as model, 3 as k union all select 'FUNDAMENTAL', 5 union all select 'HOMOGRAPHY', 7) m""",
    "fx_point": """
select cast(l_partkey % 97 as double) / 4 as x, cast((l_suppkey * 7 + l_orderkey) % 89 as double) / 4 as y, l_extendedprice / 1000 as z from lineitem""",
    "fx_pixel": """
select vec_id as image_id, label, i // 8 as r, i % 8 as c, cast(floor(abs(embedding[i + 1]) * 1000) as bigint) % 256 as g from (select vec_id, label, embedding, unnest(range(64)) as i from embeddings)""",
}

_SPARK_ONLY = {
    "fx_pixel": """
select vec_id as image_id, label, cast(i div 8 as bigint) as r, cast(i % 8 as bigint) as c, cast(floor(abs(v) * 1000) as bigint) % 256 as g from {embeddings} lateral view posexplode(embedding) p as i, v""",
    "fx_point": VIEWS["fx_point"].replace("from lineitem", "from {lineitem}"),
}

# Events of one user are spread over weeks; an hour of them is the unit one task orders.
_BASE_SLICE_S = 3600.0


def _needs(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


def view(tables, name: str) -> DataFrame:
    """A derived view as a DataFrame."""
    if name == "fx_base":
        events = tables.table("events").select(
            F.col("user_id").alias("mission_id"), "event_id", "ts", "event_type", "value"
        )
        numbered = scan(
            events,
            ["mission_id"],
            ["ts", "event_id"],
            [RowNumber("seq"), Whole("n", F.lit(1), "count")],
            width=_BASE_SLICE_S,
            slice_on=F.unix_seconds(F.col("ts").cast("timestamp")),
        )
        return numbered.select(
            "mission_id", "event_id", "seq", "n", "ts", "event_type", "value",
            F.floor("value").cast("bigint").alias("vi"),
        )
    text = _SPARK_ONLY.get(name) or VIEWS.get(name)
    if text is None:
        raise AttributeError(name)
    inputs = {}
    for dep in _needs(text):
        inputs[dep] = view(tables, dep) if dep.startswith("fx_") else tables.table(dep)
    return tables.spark.sql(text, **inputs)


def _closure(names) -> list[str]:
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        if name != "fx_base":
            for dep in _needs(VIEWS[name]):
                visit(dep)
        done.append(name)

    for name in names:
        visit(name)
    return done


def with_views(names, sql: str) -> str:
    """Put the views a query needs in front of it as common table expressions."""
    parts = []
    for name in _closure(names):
        text = BASE_SQL if name == "fx_base" else VIEWS[name]
        parts.append(f"{name} as ({re.sub(r'[{}]', '', text).strip()})")
    body = sql.strip()
    if not parts:
        return body
    lowered = body.lower()
    if lowered.startswith("with recursive"):
        return "with recursive " + ",\n".join(parts) + ",\n" + body[len("with recursive"):].lstrip()
    if lowered.startswith("with "):
        return "with " + ",\n".join(parts) + ",\n" + body[len("with "):].lstrip()
    return "with " + ",\n".join(parts) + "\n" + body
