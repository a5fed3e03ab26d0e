"""Queries: candidate pairs, image quality, matches and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from flightloom.operators import matching, pairs, raster, reports
from flightloom.plans.registry import query
from flightloom.plans.sqltext import haversine, r

c = F.col
METRICS = ("distance_m", "time_delta_s", "yaw_delta_deg", "altitude_ratio", "roll_pitch_delta_deg", "predicted_overlap")

_T = "(1 / greatest(0.35, cos(radians(least(70, sqrt(roll * roll + pitch * pitch))))))"
NODES = f"""ref as (select mission_id, coalesce(first(latitude order by t, seq) filter (where latitude <> 0), first(latitude order by t, seq)) as lat0,
    coalesce(first(longitude order by t, seq) filter (where longitude <> 0), first(longitude order by t, seq)) as lon0,
    bool_or(abs(latitude) > 1e-9 and abs(longitude) > 1e-9) as gps from cap group by 1),
  n0 as (select cap.*, gps, row_number() over (partition by mission_id order by t, seq) - 1 as idx, radians(longitude - lon0) * 6371000.0 * cos(radians(lat0)) as e, radians(latitude - lat0) * 6371000.0 as n,
    greatest(case when baro_altitude <> 0 then baro_altitude else gps_altitude end, 2.0) as alt from cap join ref using (mission_id)),
  n1 as (select *, 2 * alt * tan(radians(62.2) / 2) * {_T} as w, 2 * alt * tan(radians(48.8) / 2) * {_T} as h from n0),
  nodes as (select *, abs(w / 2 * cos(radians(yaw))) + abs(h / 2 * sin(radians(yaw))) as ex, abs(w / 2 * sin(radians(yaw))) + abs(h / 2 * cos(radians(yaw))) as ny,
    cast(floor(e / 120.0) as bigint) as cx, cast(floor(n / 120.0) as bigint) as cy from n1)"""
MEASURED = f"""a.mission_id, a.idx as ia, b.idx as ib, a.image_name as source, b.image_name as target, a.gps, a.cx as acx, a.cy as acy, b.cx as bcx, b.cy as bcy, a.q as qa, b.q as qb,
  {haversine('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} as distance_m, abs(b.t - a.t) as time_delta_s,
  abs((((b.yaw - a.yaw + 180) % 360) + 360) % 360 - 180) as yaw_delta_deg, greatest(a.alt, b.alt) / greatest(1e-6, least(a.alt, b.alt)) as altitude_ratio,
  sqrt(pow(a.roll - b.roll, 2) + pow(a.pitch - b.pitch, 2)) as roll_pitch_delta_deg,
  least(1.0, greatest(0.0, least(a.e + a.ex, b.e + b.ex) - greatest(a.e - a.ex, b.e - b.ex)) * greatest(0.0, least(a.n + a.ny, b.n + b.ny) - greatest(a.n - a.ny, b.n - b.ny)) / greatest(1.0, least(a.w * a.h, b.w * b.h))) as predicted_overlap"""
MET = f"""met as materialized (select {MEASURED} from nodes a join nodes b on a.mission_id = b.mission_id and b.idx > a.idx and b.t - a.t <= 20),
  spatial as materialized (select * from met where gps and abs(acx - bcx) <= 1 and abs(acy - bcy) <= 1 and distance_m <= 250 and time_delta_s <= 20 and yaw_delta_deg <= 80 and altitude_ratio <= 2.5 and roll_pitch_delta_deg <= 45 and predicted_overlap >= 0.03),
  temporal as (select * from met where ib - ia <= case when gps then 2 else 8 end)"""
GRAPH = f"""{NODES}, {MET},
  both_ as (select *, 'spatial' as reason from spatial union all select *, 'temporal' from temporal t where not exists (select 1 from spatial s where s.mission_id = t.mission_id and s.ia = t.ia and s.ib = t.ib)),
  scored as (select *, 0.24 * predicted_overlap + 0.18 * greatest(0, 1 - distance_m / 250) + 0.15 * greatest(0, 1 - time_delta_s / 20) + 0.13 * greatest(0, 1 - yaw_delta_deg / 80)
     + 0.10 * greatest(0, 1 - (altitude_ratio - 1) / 1.5) + 0.10 * greatest(0, 1 - roll_pitch_delta_deg / 45) + 0.10 * least(qa, qb) + case when reason = 'temporal' then 0.08 else 0 end as score from both_),
  ends as (select mission_id, ia, ib, ia as en, score from scored union all select mission_id, ia, ib, ib, score from scored),
  picked as (select distinct mission_id, ia, ib from (select *, row_number() over (partition by mission_id, en order by round(score, 9) desc, ia, ib) as k from ends) where k <= 8),
  graph as (select scored.* from scored join picked using (mission_id, ia, ib))"""
CAP = "cap as (select *, 1.0 as q from fx_capture)"
# metres between an image with a position and one without are in the thousands of kilometres, hence 3 digits
DIGITS = {m: 3 if m == "distance_m" else 6 for m in METRICS}
MEASURE_SQL = ", ".join(f"{r(m, k)} as {m}" for m, k in DIGITS.items())


def measured(df):
    return df.select(
        "mission_id", c("a_image_name").alias("source"), c("b_image_name").alias("target"),
        *[F.round(m, k).alias(m) for m, k in DIGITS.items()],
    )


@query("spatial_pairs", ["fx_capture"], f"with {CAP}, {NODES}, {MET} select mission_id, source, target, {MEASURE_SQL} from spatial")
def spatial_pairs(d):
    return measured(pairs.spatial_pairs(pairs.image_nodes(d.fx_capture)))


@query("temporal_pairs", ["fx_capture"], f"with {CAP}, {NODES}, {MET} select mission_id, source, target, {MEASURE_SQL} from temporal")
def temporal_pairs(d):
    return measured(pairs.temporal_pairs(pairs.image_nodes(d.fx_capture)))


@query(
    "candidate_graph", ["fx_capture"],
    f"with {CAP}, {GRAPH} select mission_id, source, target, reason, {r('score')} as score from graph",
)
def candidate_graph(d):
    out = pairs.candidate_graph(d.fx_capture)
    return out.select("mission_id", "source", "target", "reason", F.round("score", 6).alias("score"))


@query(
    "edge_profile", ["fx_match"],
    """with e as (select distinct mission_id, source, target, abs(cast(regexp_extract(source, '(\\d+)\\.jpg', 1) as bigint) - cast(regexp_extract(target, '(\\d+)\\.jpg', 1) as bigint)) > 1 as far from (
      select mission_id, source, target from fx_match union all select a.mission_id, a.source, b.target from fx_match a join fx_match b on a.mission_id = b.mission_id and a.target = b.source))
    select mission_id, image_name, count(*) as degree, count(*) filter (where far) as non_sequential from
      (select mission_id, source as image_name, far from e union all select mission_id, target, far from e) group by 1, 2""",
)
def edge_profile(d):
    m = d.fx_match.select("mission_id", "source", "target")
    skip = m.alias("a").join(m.alias("b"), (c("a.mission_id") == c("b.mission_id")) & (c("a.target") == c("b.source")))
    edges = m.unionByName(skip.select("a.mission_id", "a.source", "b.target")).distinct()
    return pairs.edge_profile(edges)


@query(
    "edge_images", ["fx_match", "fx_capture"],
    """select mission_id, image_name, seq from fx_capture where (mission_id, image_name) in (select mission_id, source from fx_match union select mission_id, target from fx_match)""",
)
def edge_images(d):
    return pairs.needed_images(d.fx_match, d.fx_capture).select("mission_id", "image_name", "seq")


@query(
    "dedupe_pairs", ["fx_geometry", "fx_match"],
    """with e as (select mission_id, source, target, cast(query_idx as double) as score from fx_match union all select mission_id, target, source, cast(train_idx as double) + 0.5 from fx_match)
    select mission_id, source, target, score from e qualify row_number() over (partition by mission_id, least(source, target), greatest(source, target) order by score desc, source desc) = 1""",
)
def dedupe_pairs(d):
    m = d.fx_match
    e = m.select("mission_id", "source", "target", c("query_idx").cast("double").alias("score")).unionByName(
        m.select("mission_id", c("target").alias("source"), c("source").alias("target"), (c("train_idx") + 0.5).alias("score"))
    )
    return pairs.dedupe_pairs(e)


_LAP = """px as (select image_id, r, c, g from fx_pixel),
  lap as (select p.image_id, u.g + dn.g + l.g + ri.g - 4 * p.g as v from px p
    join px u on u.image_id = p.image_id and u.c = p.c and u.r = case when p.r = 0 then 1 else p.r - 1 end
    join px dn on dn.image_id = p.image_id and dn.c = p.c and dn.r = case when p.r = 7 then 6 else p.r + 1 end
    join px l on l.image_id = p.image_id and l.r = p.r and l.c = case when p.c = 0 then 1 else p.c - 1 end
    join px ri on ri.image_id = p.image_id and ri.r = p.r and ri.c = case when p.c = 7 then 6 else p.c + 1 end),
  blurs as (select image_id, var_pop(v) as blur_variance from lap group by 1),
  plain as (select image_id, avg(g) as brightness, avg(case when g <= 3 then 1.0 else 0 end) as shadow_share, avg(case when g >= 252 then 1.0 else 0 end) as highlight_share,
    avg(case when g < 20 then 1.0 else 0 end) as dark_share, avg(case when g > 245 then 1.0 else 0 end) as bright_share from px group by 1),
  metrics as (select * from plain join blurs using (image_id))"""


def metrics(d):
    return raster.tile_metrics(d.fx_pixel, ["image_id"], 8, 8)


@query(
    "tile_metrics", ["fx_pixel"],
    f"""with {_LAP} select image_id, {r('blur_variance')} as blur_variance, {r('brightness')} as brightness, {r('shadow_share')} as shadow_share, {r('highlight_share')} as highlight_share,
      {r('dark_share')} as dark_share, {r('bright_share')} as bright_share,
      case when blur_variance < 80 or brightness < 45 or brightness > 210 or dark_share > 0.12 or bright_share > 0.12 then 'DEGRADED' else 'HEALTHY' end as image_status,
      coalesce(nullif(concat_ws('; ', case when blur_variance < 80 then printf('sharpness %.1f below threshold', blur_variance) end, case when brightness < 45 or brightness > 210 then printf('brightness %.1f outside threshold', brightness) end,
        case when dark_share > 0.12 then printf('underexposed %.1f%%', dark_share * 100) end, case when bright_share > 0.12 then printf('overexposed %.1f%%', bright_share * 100) end), ''), 'Latest image quality acceptable.') as image_reason from metrics""",
)
def tile_metrics(d):
    from flightloom.operators.prepare import live_image_verdict

    out = live_image_verdict(metrics(d).withColumn("sharpness", c("blur_variance")))
    names = ("blur_variance", "brightness", "shadow_share", "highlight_share", "dark_share", "bright_share")
    return out.select("image_id", *[F.round(n, 6).alias(n) for n in names], "image_status", "image_reason")


QUALITY = f"""{_LAP},
  b as (select mission_id, seq, image_name, event_id, sqrt(roll * roll + pitch * pitch) as tilt, sqrt(gyro_x * gyro_x + gyro_y * gyro_y + gyro_z * gyro_z) as rate, blur_variance as blur, brightness as br, shadow_share as sh, highlight_share as hi
    from fx_capture left join metrics on image_id = event_id),
  s as (select *, least(1, greatest(0, blur / 80)) as s1, least(1, greatest(0, 0.75 * least(1, greatest(0, 1 - abs(br - 127.5) / 92.5)) + 0.25 * (1 - greatest(sh, hi)))) as s2,
    least(1, greatest(0, 1 - tilt / 35)) as s3, least(1, greatest(0, 1 - rate / 120)) as s4 from b),
  f as (select *, case when blur is null then 0 else 0.35 * s1 + 0.25 * s2 + 0.2 * s3 + 0.2 * s4 end as total, case when blur is null then 'unreadable' else
    concat_ws(',', case when blur < 80 then 'blur' end, case when br < 35 then 'underexposed' end, case when br > 220 then 'overexposed' end, case when sh > 0.15 then 'clipped_shadows' end,
      case when hi > 0.15 then 'clipped_highlights' end, case when tilt > 35 then 'tilt' end, case when rate > 120 then 'motion' end) end as flags from s),
  quality as (select *, case when blur is null then 'REJECTED' when total >= 0.7 and flags = '' then 'GOOD' when total >= 0.4 then 'MARGINAL' else 'REJECTED' end as status from f)"""


def quality(d):
    """Tiles stand in for the images with the same number; the rest have no readable image."""
    return raster.image_quality(d.fx_capture, metrics(d).withColumnRenamed("image_id", "event_id"), ["event_id"])


@query(
    "image_quality", ["fx_pixel", "fx_capture"],
    f"""with {QUALITY} select mission_id, image_name, {r('total + 1e-9')} as total_score, status, status <> 'REJECTED' as usable, replace(flags, ',', ';') as flags,
      case when status = 'GOOD' then '' when status = 'REJECTED' and flags = '' then 'low_score' else flags end as rejection_reason,
      {r('case when blur is null then 0 else tilt end')} as tilt_deg, {r('coalesce(sh, 1)')} as shadow_share from quality""",
)
def image_quality(d):
    from flightloom.functions.values import flags_join

    return quality(d).select(
        "mission_id", "image_name", F.round(c("total_score") + 1e-9, 6).alias("total_score"), "status", "usable",
        flags_join(c("flags")).alias("flags"), "rejection_reason",
        F.round("tilt_deg", 6).alias("tilt_deg"), F.round("shadow_share", 6).alias("shadow_share"),
    )


@query(
    "quality_counts", ["fx_pixel", "fx_capture"],
    f"with {QUALITY} select mission_id, count(*) filter (where status = 'GOOD') as good, count(*) filter (where status = 'MARGINAL') as marginal, count(*) filter (where status = 'REJECTED') as rejected from quality group by 1",
)
def quality_counts(d):
    return reports.quality_counts(quality(d), ["mission_id"])


@query(
    "usable_graph", ["fx_pixel", "fx_capture"],
    f"""with {QUALITY}, cap as (select fx_capture.*, total as q from fx_capture join quality using (mission_id, image_name) where status in ('GOOD', 'MARGINAL')), {GRAPH}
    select mission_id, source, target, reason, {r('score')} as score from graph""",
)
def usable_graph(d):
    q = quality(d)
    out = pairs.candidate_graph(pairs.usable(d.fx_capture, q), q)
    return out.select("mission_id", "source", "target", "reason", F.round("score", 6).alias("score"))


GEOMETRY = """best as (select * from fx_geometry qualify row_number() over (partition by mission_id, seq order by inliers desc, case model when 'ESSENTIAL' then 0 when 'FUNDAMENTAL' then 1 else 2 end) = 1),
  geo as (select mission_id, seq, case when matches >= 12 then model else 'NONE' end as model, matches, case when matches >= 12 then inliers else 0 end as inliers,
    case when matches >= 12 then inliers / matches else 0 end as ratio, matches >= 12 and inliers >= 10 and inliers / matches >= 0.18 as accepted from best)"""


def geometry(d):
    return matching.select_geometry(d.fx_geometry, ["mission_id", "seq"])


@query(
    "pair_acceptance", ["fx_geometry"],
    f"with {GEOMETRY} select mission_id, seq, model, matches, inliers, {r('ratio')} as inlier_ratio, accepted from geo",
)
def pair_acceptance(d):
    return geometry(d).withColumn("inlier_ratio", F.round("inlier_ratio", 6))


@query(
    "sample_pairs", ["fx_geometry"],
    f"""with {GEOMETRY}, k as (select *, row_number() over (partition by mission_id order by inliers desc, seq) as k, count(*) over (partition by mission_id) as n from geo)
    select 'good' as label, mission_id, seq, inliers from k where k = 1 union all select 'average', mission_id, seq, inliers from k where k = n // 2 + 1
    union all select 'rejected', mission_id, seq, inliers from (select * from k where not accepted qualify row_number() over (partition by mission_id order by k desc) = 1)""",
)
def sample_pairs(d):
    return matching.sample_pairs(geometry(d), ["seq"], ["mission_id"]).select("label", "mission_id", "seq", "inliers")


_PAIRS = "pr as (select distinct a.label as a, b.label as b from embeddings a join embeddings b on b.label = a.label + 1)"


@query(
    "descriptor_matches", [],
    f"""with {_PAIRS}, dist as (select pr.a, pr.b, x.vec_id as q, y.vec_id as t, sqrt(list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda z: pow(z[1]::double - z[2]::double, 2)))) as dd
      from pr join embeddings x on x.label = pr.a join embeddings y on y.label = pr.b),
    k as (select *, row_number() over (partition by a, b, q order by dd, t) as k, lead(dd) over (partition by a, b, q order by dd, t) as d2 from dist)
    select a as source, b as target, q as query_idx, t as train_idx, {r('dd')} as distance from k where k = 1 and dd < 0.95 * d2""",
)
def descriptor_matches(d):
    e = d.table("embeddings")
    descriptors = e.select(
        c("label").alias("image_name"), c("vec_id").alias("feature_id"), F.transform("embedding", lambda v: v.cast("double")).alias("vec")
    )
    labels = e.select("label").distinct()
    edges = labels.select(c("label").alias("source"), (c("label") + 1).alias("target")).join(
        labels.select(c("label").alias("target")), "target", "left_semi"
    )
    # the vectors are far from each other, so a looser ratio than the default keeps some matches
    out = matching.ratio_matches(edges.select("source", "target"), descriptors, 0.95)
    return out.select("source", "target", "query_idx", "train_idx", F.round("distance", 6).alias("distance"))


@query(
    "binary_matches", [],
    f"""with {_PAIRS}, bits as (select vec_id, label, list_transform(range(8), lambda j: list_sum(list_transform(range(8), lambda i: case when embedding[j * 8 + i + 1] > 0 then 1 << i else 0 end))::bigint) as w from embeddings),
    dist as (select pr.a, pr.b, x.vec_id as q, y.vec_id as t, list_sum(list_transform(list_zip(x.w, y.w), lambda z: bit_count(xor(z[1], z[2]))))::double as dd
      from pr join bits x on x.label = pr.a join bits y on y.label = pr.b),
    k as (select *, row_number() over (partition by a, b, q order by dd, t) as k, lead(dd) over (partition by a, b, q order by dd, t) as d2 from dist)
    select a as source, b as target, q as query_idx, t as train_idx, dd as distance from k where k = 1 and dd < 0.75 * d2""",
)
def binary_matches(d):
    e = d.table("embeddings")

    def word(j):
        parts = [F.when(c("embedding")[8 * j + i] > 0, 1 << i).otherwise(0) for i in range(8)]
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        return total.cast("bigint")

    descriptors = e.select(c("label").alias("image_name"), c("vec_id").alias("feature_id"), F.array(*[word(j) for j in range(8)]).alias("vec"))
    labels = e.select("label").distinct()
    edges = labels.select(c("label").alias("source"), (c("label") + 1).alias("target")).join(
        labels.select(c("label").alias("target")), "target", "left_semi"
    )
    return matching.ratio_matches(edges.select("source", "target"), descriptors, hamming=True)


@query(
    "raw_match_bound", [],
    f"""with {_PAIRS}, n as (select label, count(*) as n from embeddings group by 1)
    select a as source, b as target, least(x.n, y.n) as bound from pr join n x on x.label = a join n y on y.label = b""",
)
def raw_match_bound(d):
    e = d.table("embeddings").select(c("label").alias("image_name"), c("vec_id").alias("feature_id"))
    labels = e.select("image_name").distinct()
    edges = labels.select(c("image_name").alias("source"), (c("image_name") + 1).alias("target")).join(
        labels.select(c("image_name").alias("target")), "target", "left_semi"
    )
    return matching.raw_match_bound(edges.select("source", "target"), e, []).select("source", "target", "bound")


@query(
    "matched_points", ["fx_match", "fx_capture"],
    f"""with kp as (select mission_id, image_name, event_id % 5 as f, gyro_x + 60 as x, gyro_y + 60 as y, 0.5 as s from fx_capture)
    select m.mission_id, m.source, m.target, {r('a.x / a.s')} as x_a, {r('a.y / a.s')} as y_a, {r('b.x / b.s')} as x_b, {r('b.y / b.s')} as y_b
    from fx_match m join kp a on a.mission_id = m.mission_id and a.image_name = m.source and a.f = m.query_idx join kp b on b.mission_id = m.mission_id and b.image_name = m.target and b.f = m.train_idx""",
)
def matched_points(d):
    kp = d.fx_capture.select(
        "mission_id", "image_name", (c("event_id") % 5).alias("feature_id"), (c("gyro_x") + 60).alias("x"),
        (c("gyro_y") + 60).alias("y"), F.lit(0.5).alias("scale"),
    )
    out = matching.matched_points(d.fx_match, kp, ["mission_id"])
    return out.select("mission_id", "source", "target", *[F.round(x, 6).alias(x) for x in ("x_a", "y_a", "x_b", "y_b")])


@query(
    "inlier_matches", ["fx_geometry"],
    f"""with {GEOMETRY}, m as (select mission_id, seq, unnest(range(matches)) as match_no, inliers from geo where accepted)
    select mission_id, seq, match_no from m where match_no % 3 <> 1 and match_no < inliers""",
)
def inlier_matches(d):
    geo = geometry(d)
    mask = F.transform(F.sequence(F.lit(0), c("matches") - 1), lambda i: (i % 3 != 1) & (i < c("inliers")))
    matches = geo.select("mission_id", "seq", F.explode(F.sequence(F.lit(0), c("matches") - 1)).alias("match_no"))
    out = matching.inlier_matches(matches, geo.withColumn("inlier_mask", mask), ["mission_id", "seq"])
    return out.select("mission_id", "seq", c("match_no").cast("bigint").alias("match_no"))


@query(
    "uncached_images", ["fx_file"],
    """select mission_id, image_name, sha256(image_name || chr(31) || '7' || chr(31) || cast(length as varchar) || chr(31) || 'v1') as signature from fx_file
    where sha256(image_name || chr(31) || '7' || chr(31) || cast(length as varchar) || chr(31) || 'v1') not in
      (select sha256(image_name || chr(31) || '7' || chr(31) || cast(length as varchar) || chr(31) || 'v1') from fx_file where length % 3 = 0)""",
)
def uncached_images(d):
    from flightloom.functions.values import signature

    images = d.fx_file.withColumn("path", c("image_name")).withColumn("modified", F.lit(7))
    cache = images.filter(c("length") % 3 == 0).select(signature(c("path"), c("modified"), c("length"), F.lit("v1")).alias("signature"))
    return matching.uncached(images, cache, "v1").select("mission_id", "image_name", "signature")


@query(
    "dsm_cells", ["fx_point"],
    f"""with lim as (select quantile_cont(z, 0.01) as lo, quantile_cont(z, 0.99) as hi from fx_point),
    p as (select x, y, z from fx_point, lim where z between lo and hi),
    e as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from p),
    g as (select cast(floor((y1 - y) / 0.25) as bigint) as row, cast(floor((x - x0) / 0.25) as bigint) as col, z from p, e)
    select row, col, count(*) as points, {r('quantile_cont(z, 0.9)')} as z from g group by 1, 2""",
)
def dsm_cells(d):
    return raster.dsm(d.fx_point).select("row", "col", "points", F.round("z", 6).alias("z"))


@query(
    "trimmed_heights", ["fx_point"],
    f"""with lim as (select quantile_cont(z, 0.01) as lo, quantile_cont(z, 0.99) as hi from fx_point)
    select x, count(*) as n, {r('min(z)')} as low, {r('max(z)')} as high from fx_point, lim where z between lo and hi group by 1""",
)
def trimmed_heights(d):
    out = raster.trim_heights(d.fx_point).groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.min("z").alias("low"), F.max("z").alias("high"))
    return out.select("x", "n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(
    "blended_cells", ["fx_pixel"],
    f"""select label, r, c, {r('sum(g * w) / sum(w)')} as value, {r('sum(w)')} as weight_sum from (select label, r, c, cast(g as double) as g, (g % 5) / 4.0 as w from fx_pixel) group by 1, 2, 3 having sum(w) > 1e-6""",
)
def blended_cells(d):
    tiles = d.fx_pixel.select("label", "r", "c", c("g").cast("double").alias("v"), ((c("g") % 5) / 4.0).alias("w"))
    out = raster.blend_cells(tiles, ["label", "r", "c"])
    return out.select("label", "r", "c", F.round("value", 6).alias("value"), F.round("weight_sum", 6).alias("weight_sum"))


@query(
    "raster_extent", ["fx_pixel"],
    f"""with b as (select image_id, min(r) as row0, max(r) as row1, min(c) as col0, max(c) as col1 from fx_pixel where g > 200 group by 1),
    s as (select *, least(1.0, 4.0 / greatest(col1 - col0 + 1, row1 - row0 + 1)) as scale from b),
    w as (select *, greatest(1, ceil((col1 - col0 + 1) * scale)) as ww, greatest(1, ceil((row1 - row0 + 1) * scale)) as hh from s)
    select image_id, row0, row1, col0, col1, {r('scale')} as scale, cast(ww as bigint) as width, cast(hh as bigint) as height, {r('ww * hh / 64.0')} as image_ratio from w""",
)
def raster_extent(d):
    cells = d.fx_pixel.filter(c("g") > 200).select("image_id", c("r").alias("row"), c("c").alias("col"))
    out = raster.raster_extent(cells, ["image_id"], 4, 64.0)
    return out.select(
        "image_id", "row0", "row1", "col0", "col1", F.round("scale", 6).alias("scale"), "width", "height",
        F.round("image_ratio", 6).alias("image_ratio"),
    )
