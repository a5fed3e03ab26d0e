"""Feature tracks, reachability and chained transforms on image graphs."""

from __future__ import annotations

import itertools

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightloom.functions import attitude
from flightloom.session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected edge list (u, v); a component is named by its smallest node.

    Alternates two rewirings until nothing changes: every node links its larger neighbours to its
    smallest one, then every node links its smaller neighbours likewise. Both are one grouping of
    the edge list, a hub's neighbours included, with no list of neighbours held in memory, and the
    number of rounds grows with the logarithm of the component size. Nodes are numbered in their order
    first, so the rounds move numbers and not names.
    """

    def rewired(pairs: DataFrame, larger: bool) -> DataFrame:
        """pairs (n, m): each n with neighbours m."""
        smallest = pairs.groupBy("n").agg(F.min("m").alias("_min")).withColumn("_min", F.least("_min", "n"))
        kept = pairs.join(smallest, "n")
        if larger:
            linked = kept.filter(F.col("m") > F.col("n")).select(F.col("m").alias("u"), F.col("_min").alias("v"))
        else:
            linked = kept.select(F.col("m").alias("u"), F.col("_min").alias("v")).unionByName(
                smallest.select(F.col("n").alias("u"), F.col("_min").alias("v"))
            )
        return linked.filter("u <> v").distinct()

    edges = cut_lineage(edges.select("u", "v"))
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    ranged = nodes.repartitionByRange("node").sortWithinPartitions("node")
    nodes = cut_lineage(ranged.withColumn("id", F.monotonically_increasing_id()))

    def numbered(pairs: DataFrame, end: str) -> DataFrame:
        return pairs.join(nodes.select(F.col("node").alias(end), F.col("id").alias(f"_{end}")), end).drop(end)

    edges = numbered(numbered(edges.filter("u <> v"), "u"), "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
    current = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        both = current.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(
            current.select(F.col("v").alias("n"), F.col("u").alias("m"))
        )
        large = rewired(both, True)
        down = large.select(F.greatest("u", "v").alias("n"), F.least("u", "v").alias("m")).distinct()
        current = cut_lineage(rewired(down, False))
        state = current.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if state == seen:
            break
        seen = state
    linked = nodes.join(current.select(F.col("u").alias("id"), F.col("v").alias("_c")), "id", "left")
    named = nodes.select(F.col("id").alias("_c"), F.col("node").alias("component"))
    return linked.withColumn("_c", F.coalesce("_c", "id")).join(named, "_c").select("node", "component")


def feature_tracks(matches: DataFrame, min_length: int = 2) -> tuple[DataFrame, DataFrame]:
    """Track members and one judged row per track.

    Matches: mission_id, source, query_idx, target, train_idx. A track that holds two features of
    one image is rejected as a conflict, one with too few images as short.
    """
    def node(image, feature):
        return F.struct(
            F.col("mission_id"), F.col(image).alias("image_name"), F.col(feature).cast("bigint").alias("feature_id")
        )

    pairs = matches.select(node("source", "query_idx").alias("u"), node("target", "train_idx").alias("v"))
    members = connected_components(pairs).select("node.*", F.col("component").alias("track"))
    # features per image first, so a huge track is combined before it meets in one place
    per_image = members.groupBy("mission_id", "track", "image_name").agg(F.count(F.lit(1)).alias("_f"))
    tracks = per_image.groupBy("mission_id", "track").agg(
        F.count(F.lit(1)).alias("length"), F.sum("_f").alias("features"), F.max("_f").alias("_worst")
    )
    verdict = (
        F.when(F.col("_worst") > 1, "CONFLICT").when(F.col("length") < min_length, "SHORT").otherwise("KEPT")
    )
    return members, tracks.withColumn("verdict", verdict).drop("_worst")


def track_stats(tracks: DataFrame, by: list[str]) -> DataFrame:
    """Kept tracks with mean, exact median and largest length, and both kinds of rejects."""
    from flightloom.operators.quantiles import exact_quantiles

    kept = tracks.filter(F.col("verdict") == "KEPT")
    counts = tracks.groupBy(*by).agg(
        F.count_if(F.col("verdict") == "KEPT").alias("total_tracks"),
        F.avg(F.when(F.col("verdict") == "KEPT", F.col("length"))).alias("mean_length"),
        F.max(F.when(F.col("verdict") == "KEPT", F.col("length"))).alias("max_length"),
        F.count_if(F.col("verdict") == "CONFLICT").alias("rejected_conflicts"),
        F.count_if(F.col("verdict") == "SHORT").alias("rejected_short"),
    )
    middle = exact_quantiles(kept.withColumn("length", F.col("length").cast("double")), by, "length", {"median_length": 0.5})
    return counts.join(middle.drop("n"), by, "left").fillna(0.0, ["mean_length", "median_length"]).fillna(0, ["max_length"])


def reach(edges: DataFrame, anchors: DataFrame, transforms: bool = False, edges_a_task: int = 200_000) -> DataFrame:
    """Images connected to their mission's anchor, with the fewest hops and the image reached from.

    Edges: mission_id, source, target (and h, nine values, when ``transforms``). Of several parents
    at the same distance the smallest name wins. One join per hop, over the frontier only; with
    ``transforms`` each image carries parent * inverse(h) back to the anchor.

    Edges are dealt by (mission, source) once and kept so on the executors' disks; each hop moves the frontier to
    them and sends nothing through the driver. When half of the missions are done, their edges are left out.
    """
    c = F.col
    there = [c("source"), c("target"), *([c("h")] if transforms else [])]
    back = [c("target").alias("source"), c("source").alias("target")]
    if transforms:
        back.append(attitude.mat3_inv(c("h")).alias("h"))
    both = cut_lineage(
        edges.select("mission_id", F.explode(F.array(F.struct(*there), F.struct(*back))).alias("_e")).select("mission_id", "_e.*")
    )

    def dealt(some: DataFrame) -> DataFrame:
        parts = some.count() // edges_a_task + 1
        return some.repartition(parts, "mission_id", "source").persist(StorageLevel.DISK_ONLY)

    one = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0, 0, 0, 1)])
    found = anchors.select(
        "mission_id", "image_name", F.lit(0).cast("bigint").alias("hops"), F.lit(None).cast("string").alias("parent"),
        *([one.alias("transform")] if transforms else []),
    )
    frontier = found = cut_lineage(found)
    before, kept, most = frontier.limit(0), dealt(both), None
    for hop in itertools.count(1):
        step = frontier.withColumnRenamed("image_name", "source").hint("shuffle_hash").join(kept, ["mission_id", "source"])
        carried = [attitude.mat3_mul(F.col("transform"), attitude.mat3_inv(F.col("h"))).alias("transform")] if transforms else []
        reached = step.select(
            "mission_id", F.col("target").alias("image_name"), F.lit(hop).cast("bigint").alias("hops"),
            F.col("source").alias("parent"), *carried,
        )
        best = F.min_by(F.struct(*reached.columns[2:]), "parent")
        fresh = reached.groupBy("mission_id", "image_name").agg(best.alias("_b")).select("mission_id", "image_name", "_b.*")
        # edges lead both ways, so a neighbour of a frontier is new, of that frontier or of the one before
        recent = frontier.unionByName(before).select("mission_id", "image_name")
        before, frontier = frontier, cut_lineage(fresh.join(recent.hint("shuffle_hash"), ["mission_id", "image_name"], "left_anti"))
        missions = frontier.select("mission_id").distinct()
        active = missions.count()
        if not active:
            kept.unpersist()
            return found
        found = found.unionByName(frontier)
        if hop % 50 == 0:
            found = cut_lineage(found)
        most = most or active
        if 2 * active <= most:
            kept.unpersist()
            both = cut_lineage(both.join(missions, "mission_id", "left_semi"))
            kept, most = dealt(both), active


def reach_summary(reached: DataFrame, min_images: int = 3) -> DataFrame:
    return reached.groupBy("mission_id").agg(
        F.count(F.lit(1)).alias("connected"), F.max("hops").alias("max_hops")
    ).withColumn("success", F.col("connected") >= min_images)


def largest_component(components: DataFrame) -> DataFrame:
    """Per mission the component with most images (smallest name on a tie)."""
    size = components.groupBy("mission_id", "component").agg(F.count(F.lit(1)).alias("images"))
    ranked = Window.partitionBy("mission_id").orderBy(F.col("images").desc(), F.col("component"))
    return size.withColumn("_r", F.row_number().over(ranked)).filter("_r = 1").drop("_r")


def contributors(reached: DataFrame, captures: DataFrame, n: int = 20) -> DataFrame:
    """The first n reachable images in capture order; Spark keeps n per mission before the shuffle."""
    joined = captures.select("mission_id", "image_name", "t", "seq").join(reached, ["mission_id", "image_name"])
    first = Window.partitionBy("mission_id").orderBy("t", "seq")
    return joined.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= n).drop("_r")
