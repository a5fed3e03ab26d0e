"""SQL fragments shared by the checks. They are written apart from the DataFrame code on purpose."""

from __future__ import annotations


def r(expression: str, digits: int = 6) -> str:
    """Rounded, without a negative zero."""
    return f"(round({expression}, {digits}) + 0.0)"


def r3(expression: str) -> str:
    return r(expression, 3)


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (
        f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    )
    return f"(2 * 6371000.0 * atan2(sqrt({a}), sqrt(1 - {a})))"


def wrap(x: str, m: str = "360.0") -> str:
    return f"(((({x}) % {m}) + {m}) % {m})"


_W = "(2 * greatest(alt, 2) * tan(radians(62.2) / 2))"
_H = "(2 * greatest(alt, 2) * tan(radians(48.8) / 2))"


def _corner(i: int, se: int, sn: int) -> str:
    e, n = f"({se} * w / 2)", f"({sn} * h / 2)"
    east = f"({e} * cos(radians(yaw)) + {n} * sin(radians(yaw)))"
    north = f"(-{e} * sin(radians(yaw)) + {n} * cos(radians(yaw)))"
    return (
        f"latitude + degrees({north} / 6371000.0) as lat{i}, "
        f"longitude + degrees({east} / (6371000.0 * greatest(cos(radians(latitude)), 1e-9))) as lon{i}"
    )


FOOTPRINTS = f"""sized as (
  select mission_id, seq, t, image_name, latitude, longitude, alt, yaw, {_W} as w, {_H} as h
  from (select *, case when baro_altitude > 0 then baro_altitude else gps_altitude end as alt from fx_capture
        where latitude <> 0 and longitude <> 0 and image_name is not null and image_name <> '')),
shape as (select *, {_corner(1, -1, 1)}, {_corner(2, 1, 1)}, {_corner(3, 1, -1)}, {_corner(4, -1, -1)} from sized)"""


def _local(i: int) -> str:
    return (
        f"radians(lon{i} - ref_lon) * 6371000.0 * cos(radians(ref_lat)) as e{i}, "
        f"radians(lat{i} - ref_lat) * 6371000.0 as n{i}"
    )


def _cross(i: int, j: int) -> str:
    return (
        f"(case when (n{i} > y) <> (n{j} > y) and x < (e{j} - e{i}) * (y - n{i}) / nullif(n{j} - n{i}, 0) + e{i} "
        f"then 1 else 0 end)"
    )


CELLS = f"""anchor as (select mission_id, first(latitude order by t, seq) as ref_lat, first(longitude order by t, seq) as ref_lon from shape group by mission_id),
quad as (select mission_id, seq, image_name, {", ".join(_local(i) for i in range(1, 5))} from shape join anchor using (mission_id)),
span as (select *, cast(floor(least(e1, e2, e3, e4) / 5.0) as bigint) as x0, cast(ceil(greatest(e1, e2, e3, e4) / 5.0) as bigint) as x1,
  cast(floor(least(n1, n2, n3, n4) / 5.0) as bigint) as y0, cast(ceil(greatest(n1, n2, n3, n4) / 5.0) as bigint) as y1 from quad),
spread as (select *, unnest(range(x0, x1)) as cx from span),
candidate as (select *, (cx + 0.5) * 5.0 as x, (cy + 0.5) * 5.0 as y from (select *, unnest(range(y0, y1)) as cy from spread)),
cells as (select mission_id, seq, image_name, cx, cy from candidate
  where ({_cross(1, 4)} + {_cross(2, 1)} + {_cross(3, 2)} + {_cross(4, 3)}) % 2 = 1)"""
