"""Queries: tracks, reachability, chained transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from flightloom.operators import graph
from flightloom.plans.registry import query
from flightloom.plans.sqltext import r

c = F.col

TRACKS = """m as (select mission_id, source || '#' || query_idx as u, target || '#' || train_idx as v from fx_match),
  e as (select * from m union select mission_id, v, u from m),
  reachable as (select mission_id, u as node, u as peer from e union select r.mission_id, r.node, e.v from reachable r join e on e.mission_id = r.mission_id and e.u = r.peer),
  comp as (select mission_id, node, min(peer) as track from reachable group by 1, 2),
  img as (select mission_id, track, split_part(node, '#', 1) as image, count(*) as k from comp group by 1, 2, 3),
  tr as (select mission_id, track, count(*) as length, cast(sum(k) as bigint) as features, max(k) as worst from img group by 1, 2),
  judged as (select *, case when worst > 1 then 'CONFLICT' when length < 2 then 'SHORT' else 'KEPT' end as verdict from tr)"""


@query("feature_tracks", ["fx_match"], f"with recursive {TRACKS} select mission_id, split_part(track, '#', 1) as first_image, length, features, verdict from judged")
def feature_tracks(d):
    _, tracks = graph.feature_tracks(d.fx_match)
    return tracks.select("mission_id", c("track.image_name").alias("first_image"), "length", "features", "verdict")


@query(
    "track_stats", ["fx_match"],
    f"""with recursive {TRACKS} select mission_id, count(*) filter (where verdict = 'KEPT') as total_tracks, {r("coalesce(avg(length) filter (where verdict = 'KEPT'), 0)")} as mean_length,
      coalesce(max(length) filter (where verdict = 'KEPT'), 0) as max_length, count(*) filter (where verdict = 'CONFLICT') as rejected_conflicts, count(*) filter (where verdict = 'SHORT') as rejected_short,
      coalesce(median(length) filter (where verdict = 'KEPT'), 0) as median_length from judged group by 1""",
)
def track_stats(d):
    _, tracks = graph.feature_tracks(d.fx_match)
    return graph.track_stats(tracks, ["mission_id"]).withColumn("mean_length", F.round("mean_length", 6))


EDGES = """ed as (select distinct mission_id, source, target from fx_match union select mission_id, 'img_' || lpad(cast(seq as varchar), 5, '0') || '.jpg', 'img_' || lpad(cast(seq * 2 as varchar), 5, '0') || '.jpg'
    from fx_capture x where event_id % 3 = 0 and exists (select 1 from fx_capture y where y.mission_id = x.mission_id and y.seq = x.seq * 2)),
  un as (select * from ed union select mission_id, target, source from ed),
  an as (select mission_id, min(source) as image_name from ed group by 1)"""


def edges(d):
    cap = d.fx_capture
    far = cap.filter(c("event_id") % 3 == 0).select("mission_id", c("image_name").alias("source"), (c("seq") * 2).alias("_s"))
    far = far.join(cap.select("mission_id", c("seq").alias("_s"), c("image_name").alias("target")), ["mission_id", "_s"]).drop("_s")
    return d.fx_match.select("mission_id", "source", "target").unionByName(far).distinct()


def anchors(e):
    return e.groupBy("mission_id").agg(F.min("source").alias("image_name"))


@query(
    "reachable_images", ["fx_match", "fx_capture"],
    f"""with recursive {EDGES}, bfs as (select mission_id, image_name, 0::bigint as hops from an union select un.mission_id, un.target, hops + 1 from bfs join un on un.mission_id = bfs.mission_id and un.source = bfs.image_name where hops < 45)
    select mission_id, image_name, min(hops) as hops from bfs group by 1, 2""",
)
def reachable_images(d):
    e = edges(d)
    return graph.reach(e, anchors(e)).select("mission_id", "image_name", "hops")


@query(
    "reach_summary", ["fx_match", "fx_capture"],
    f"""with recursive {EDGES}, bfs as (select mission_id, image_name, 0::bigint as hops from an union select un.mission_id, un.target, hops + 1 from bfs join un on un.mission_id = bfs.mission_id and un.source = bfs.image_name where hops < 45),
    b as (select mission_id, image_name, min(hops) as hops from bfs group by 1, 2)
    select mission_id, count(*) as connected, max(hops) as max_hops, count(*) >= 3 as success from b group by 1""",
)
def reach_summary(d):
    e = edges(d)
    return graph.reach_summary(graph.reach(e, anchors(e)))


@query(
    "chained_transforms", ["fx_match", "fx_capture"],
    f"""with recursive ed as (select distinct mission_id, source, target from fx_match), an as (select mission_id, min(source) as image_name from ed group by 1),
    -- pure shifts: h maps source to target by (1, 2) per edge, so a chain adds them up with the sign of the direction
    un as (select mission_id, source, target, -1 as dir from ed union all select mission_id, target, source, 1 from ed),
    w as (select mission_id, image_name, 0::bigint as hops, 0 as n from an union select un.mission_id, un.target, hops + 1, n + dir from w join un on un.mission_id = w.mission_id and un.source = w.image_name where hops < 60)
    select mission_id, image_name, min(hops) as hops, {r('arg_min(n, hops) * 1.0::double')} as shift_x, {r('arg_min(n, hops) * 2.0::double')} as shift_y from w group by 1, 2""",
)
def chained_transforms(d):
    e = d.fx_match.select("mission_id", "source", "target").distinct()
    h = F.array(*[F.lit(float(v)) for v in (1, 0, 1, 0, 1, 2, 0, 0, 1)])
    out = graph.reach(e.withColumn("h", h), anchors(e), transforms=True)
    return out.select(
        "mission_id", "image_name", "hops", F.round(c("transform")[2], 6).alias("shift_x"), F.round(c("transform")[5], 6).alias("shift_y")
    )


@query(
    "largest_track", ["fx_match"],
    f"""with recursive {TRACKS} select mission_id, split_part(track, '#', 1) as first_image, features as images from judged qualify row_number() over (partition by mission_id order by features desc, track) = 1""",
)
def largest_track(d):
    members, _ = graph.feature_tracks(d.fx_match)
    out = graph.largest_component(members.withColumn("component", c("track")))
    return out.select("mission_id", c("component.image_name").alias("first_image"), "images")


@query(
    "contributing_images", ["fx_match", "fx_capture"],
    f"""with recursive {EDGES}, bfs as (select mission_id, image_name from an union select un.mission_id, un.target from bfs join un on un.mission_id = bfs.mission_id and un.source = bfs.image_name)
    select mission_id, image_name, seq from fx_capture join bfs using (mission_id, image_name) qualify row_number() over (partition by mission_id order by t, seq) <= 20""",
)
def contributing_images(d):
    e = edges(d)
    return graph.contributors(graph.reach(e, anchors(e)), d.fx_capture).select("mission_id", "image_name", "seq")
