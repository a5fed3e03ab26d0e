"""Queries: footprints and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from flightloom.operators import coverage as cov
from flightloom.plans.registry import query
from flightloom.plans.sqltext import FOOTPRINTS, CELLS, r, r3

c = F.col


@query(
    "coverage_area",
    ["fx_capture"],
    f"""with {FOOTPRINTS}, {CELLS},
    u as (select mission_id, count(*) as cells from (select distinct mission_id, cx, cy from cells) group by mission_id),
    raw as (select mission_id, count(*) as images, sum(w * h) as raw_area from shape group by mission_id)
    select m.mission_id, coalesce(raw.images, 0) as image_count, {r3('coalesce(raw.raw_area, 0)')} as raw_area_m2,
      {r3('cast(coalesce(u.cells, 0) * 25 as double)')} as unique_area_m2,
      {r3('greatest(0, coalesce(raw.raw_area, 0) - cast(coalesce(u.cells, 0) * 25 as double))')} as overlap_area_m2
    from (select distinct mission_id from fx_capture) m left join raw using (mission_id) left join u using (mission_id)""",
)
def coverage_area(d):
    captures = d.fx_capture
    out = cov.coverage(cov.footprints(captures), missions=captures)
    return out.select(
        "mission_id", "image_count",
        *[F.round(x, 3).alias(x) for x in ("raw_area_m2", "unique_area_m2", "overlap_area_m2")],
    )


@query(
    "covered_cells",
    ["fx_capture"],
    f"""with {FOOTPRINTS}, {CELLS}
    select mission_id, cx, cy, count(*) as images, min(seq) as first_seq from cells group by mission_id, cx, cy""",
)
def covered_cells(d):
    cells = cov.covered_cells(cov.footprints(d.fx_capture))
    return cells.groupBy("mission_id", "cx", "cy").agg(
        F.count(F.lit(1)).alias("images"), F.min("seq").alias("first_seq")
    )


@query(
    "footprint_table",
    ["fx_capture"],
    f"""with {FOOTPRINTS}
    select mission_id, image_name, {r('greatest(alt, 2)')} as altitude_m, {r('w')} as width_m, {r('h')} as height_m, {r('w * h')} as area_m2,
      {r('lat1')} as nw_lat, {r('lon1')} as nw_lon, {r('lat2')} as ne_lat, {r('lon2')} as ne_lon,
      {r('lat3')} as se_lat, {r('lon3')} as se_lon, {r('lat4')} as sw_lat, {r('lon4')} as sw_lon
    from shape""",
)
def footprint_table(d):
    shapes = cov.footprints(d.fx_capture)
    named = [("nw", 0), ("ne", 1), ("se", 2), ("sw", 3)]
    corners = [
        F.round(c("corners")[i][part], 6).alias(f"{name}_{part}") for name, i in named for part in ("lat", "lon")
    ]
    return shapes.select(
        "mission_id", "image_name",
        *[F.round(x, 6).alias(x) for x in ("altitude_m", "width_m", "height_m", "area_m2")], *corners,
    )
