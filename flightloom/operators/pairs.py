"""Which images may overlap: candidates by place, by time, and the best few per image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightloom import params as P
from flightloom.functions import attitude, geo
from flightloom.functions import footprint as fp
from flightloom.operators.coverage import local_shapes
from flightloom.session import cut_lineage
from flightloom.operators.timeline import FirstOf, RowNumber, Whole, scan


def with_quality(captures: DataFrame, quality: DataFrame | None) -> DataFrame:
    """Quality score and status per image, 1.0 and UNKNOWN where there is none."""
    if quality is None:
        return captures.withColumn("quality_score", F.lit(1.0)).withColumn("quality_status", F.lit("UNKNOWN"))
    scores = quality.select("mission_id", "image_name", F.col("total_score").alias("_s"), F.col("status").alias("_q"))
    return (
        captures.join(scores, ["mission_id", "image_name"], "left")
        .withColumn("quality_score", F.coalesce("_s", F.lit(1.0)))
        .withColumn("quality_status", F.coalesce("_q", F.lit("UNKNOWN")))
        .drop("_s", "_q")
    )


def usable(captures: DataFrame, quality: DataFrame) -> DataFrame:
    good = quality.filter(F.col("status").isin("GOOD", "MARGINAL")).select("mission_id", "image_name")
    return captures.join(good, ["mission_id", "image_name"], "left_semi")


def image_nodes(captures: DataFrame, quality: DataFrame | None = None, width: float = 3600.0) -> DataFrame:
    """Images in time order with index, local footprint box, grid cell, tilt and quality."""
    c = F.col
    located = (F.abs(c("latitude")) > 1e-9) & (F.abs(c("longitude")) > 1e-9)
    steps = [
        RowNumber("_n"),
        FirstOf("_lat", c("latitude"), c("latitude") != 0), FirstOf("_lat0", c("latitude")),
        FirstOf("_lon", c("longitude"), c("longitude") != 0), FirstOf("_lon0", c("longitude")),
        Whole("_gps", F.when(located, 1).otherwise(0), "max"),
    ]
    base = scan(with_quality(captures, quality), ["mission_id"], ["t", "seq"], steps, width)
    shaped = local_shapes(
        base.withColumn("ref_lat", F.coalesce("_lat", "_lat0")).withColumn("ref_lon", F.coalesce("_lon", "_lon0"))
    )
    cell = geo.grid_cell(c("centre.east"), c("centre.north"), P.SPATIAL_GRID_M)
    return shaped.select(
        "mission_id", (c("_n") - 1).alias("idx"), "image_name", "t", "latitude", "longitude", "yaw", "roll", "pitch",
        "altitude_m", "box.*", "area_m2", cell["cx"].alias("cx"), cell["cy"].alias("cy"), "quality_score",
        (c("_gps") == 1).alias("has_gps"),
    )


def _measured(pairs: DataFrame) -> DataFrame:
    """Pair measures from the columns a_* of the earlier image and b_* of the later one."""
    a, b = (lambda n: F.col(f"a_{n}")), (lambda n: F.col(f"b_{n}"))
    carried = [f"{side}_{n}" for side in "ab" for n in ("idx", "image_name", "roll", "pitch", "yaw", "quality_score")]

    def box(side):
        return F.struct(*[side(n).alias(n) for n in ("min_e", "min_n", "max_e", "max_n")])

    return pairs.select(
        "mission_id", *carried,
        geo.haversine_m(a("latitude"), a("longitude"), b("latitude"), b("longitude")).alias("distance_m"),
        F.abs(b("t") - a("t")).alias("time_delta_s"),
        geo.angle_delta(a("yaw"), b("yaw")).alias("yaw_delta_deg"),
        fp.altitude_ratio(a("altitude_m"), b("altitude_m")).alias("altitude_ratio"),
        fp.tilt_delta(a("roll"), a("pitch"), b("roll"), b("pitch")).alias("roll_pitch_delta_deg"),
        fp.overlap_ratio(box(a), box(b), a("area_m2"), b("area_m2")).alias("predicted_overlap"),
    )


def _plausible() -> Column:
    c = F.col
    return (
        (c("distance_m") <= P.MAX_DISTANCE_M) & (c("time_delta_s") <= P.MAX_TIME_S)
        & (c("yaw_delta_deg") <= P.MAX_YAW_DEG) & (c("altitude_ratio") <= P.MAX_ALTITUDE_RATIO)
        & (c("roll_pitch_delta_deg") <= P.MAX_TILT_DELTA_DEG) & (c("predicted_overlap") >= P.MIN_OVERLAP)
    )


def _sided(nodes: DataFrame, side: str) -> list[Column]:
    return [F.col(x).alias(f"{side}_{x}") for x in nodes.columns if x not in ("mission_id", "has_gps")]


def spatial_pairs(nodes: DataFrame, max_time_s: float = P.MAX_TIME_S) -> DataFrame:
    """Plausible pairs in touching grid cells.

    A pair must be within ``max_time_s``, so the join key is a time bucket of that length together
    with a coarse grid square: an image meets only images of its own moment and place, also when
    one mission holds most of the table or hovers over one spot for hours. The earlier image is
    sent to its own and the next bucket, and to the squares its neighbouring cells lie in (one to
    four); the exact cell, order and measure tests follow.
    """
    c = F.col
    bucket = F.floor(c("t") / max_time_s).cast("bigint")
    half = 8  # cells per square side
    located = nodes.filter("has_gps").withColumn("_tb", bucket)

    def square(cell):
        # moved by half a square, so that the start of a mission is not on a border
        return F.floor((cell + half // 2) / half).cast("bigint")

    right = located.select(
        "mission_id", "_tb", square(c("cx")).alias("_sx"), square(c("cy")).alias("_sy"), *_sided(nodes, "b")
    )
    left = located.select(
        "mission_id", *_sided(nodes, "a"), F.explode(F.array("_tb", c("_tb") + 1)).alias("_tb"),
    )
    for axis in ("x", "y"):
        around = F.array_distinct(F.array(square(c(f"a_c{axis}") - 1), square(c(f"a_c{axis}") + 1)))
        left = left.withColumn(f"_s{axis}", F.explode(around))
    met = left.join(right, ["mission_id", "_tb", "_sx", "_sy"]).filter(
        (c("a_idx") < c("b_idx"))
        & (F.abs(c("a_cx") - c("b_cx")) <= 1) & (F.abs(c("a_cy") - c("b_cy")) <= 1)
        & (c("b_t") - c("a_t") <= max_time_s)
    )
    return _measured(met).filter(_plausible())


def temporal_pairs(nodes: DataFrame, k: int = P.MAX_NEIGHBORS) -> DataFrame:
    """Pairs with one of the next images in time: two of them, or max(2, k) in a mission without GPS."""
    c = F.col
    steps = F.when(c("has_gps"), F.lit(P.TEMPORAL_NEIGHBORS)).otherwise(F.lit(max(P.TEMPORAL_NEIGHBORS, k)))
    left = nodes.select(
        "mission_id", *_sided(nodes, "a"), F.explode(F.sequence(F.lit(1), steps)).alias("_o")
    ).withColumn("_j", c("a_idx") + c("_o")).drop("_o")
    right = nodes.select("mission_id", c("idx").alias("_j"), *_sided(nodes, "b"))
    return _measured(left.join(right, ["mission_id", "_j"])).filter(c("time_delta_s") <= P.MAX_TIME_S)


def top_edges(edges: DataFrame, k: int, by: str = "score") -> DataFrame:
    """The k best edges of every image, an edge kept when either end picks it.

    Needs mission_id, idx_a, idx_b; ties go to the lower index pair. Each row of the result is an
    edge once. Spark keeps at most k rows per image before the shuffle.
    """
    c = F.col
    ends = edges.withColumn("_end", F.explode(F.array("idx_a", "idx_b")))
    best = Window.partitionBy("mission_id", "_end").orderBy(c(by).desc(), c("idx_a"), c("idx_b"))
    picked = ends.withColumn("_r", F.row_number().over(best)).filter(c("_r") <= k)
    return picked.drop("_r", "_end").dropDuplicates(["mission_id", "idx_a", "idx_b"])


def dedupe_pairs(edges: DataFrame, by: str = "score") -> DataFrame:
    """One row per unordered pair of source and target, the one with the higher score."""
    low, high = F.least("source", "target").alias("image_1"), F.greatest("source", "target").alias("image_2")
    best = F.max_by(F.struct(*edges.columns), F.struct(by, "source"))
    return edges.groupBy("mission_id", low, high).agg(best.alias("_b")).select("_b.*")


def candidate_graph(
    captures: DataFrame, quality: DataFrame | None = None, k: int = P.MAX_NEIGHBORS, width: float = 3600.0,
    prior: bool = False,
) -> DataFrame:
    """Scored candidate edges: pairs by place, pairs by time that are not among them, best k per image.

    ``prior`` adds the expected image transform from the attitudes (nine values).
    """
    c = F.col
    # read four times below, so written once
    nodes = cut_lineage(image_nodes(captures, quality, width))
    by_place = spatial_pairs(nodes).withColumn("temporal", F.lit(False))
    by_time = temporal_pairs(nodes, k).withColumn("temporal", F.lit(True))
    # a pair found both ways counts as found by place
    both = by_place.unionByName(by_time).withColumnsRenamed({"a_idx": "idx_a", "b_idx": "idx_b"})
    ranked = Window.partitionBy("mission_id", "idx_a", "idx_b").orderBy("temporal")
    once = both.withColumn("_r", F.row_number().over(ranked)).filter(c("_r") == 1).drop("_r")
    scored = once.select(
        "mission_id", "idx_a", "idx_b", c("a_image_name").alias("source"), c("b_image_name").alias("target"),
        "distance_m", "yaw_delta_deg", "time_delta_s", "altitude_ratio", "roll_pitch_delta_deg", "predicted_overlap",
        fp.edge_score(
            c("predicted_overlap"), c("distance_m"), c("time_delta_s"), c("yaw_delta_deg"), c("altitude_ratio"),
            c("roll_pitch_delta_deg"), F.least("a_quality_score", "b_quality_score"), c("temporal"),
        ).alias("score"),
        F.when(c("temporal"), "temporal").otherwise("spatial").alias("reason"),
        *([_prior().alias("prior_homography")] if prior else []),
    )
    return top_edges(scored, k)


def _prior() -> Column:
    a, b = (attitude.rotation_matrix(F.col(f"{s}_roll"), F.col(f"{s}_pitch"), F.col(f"{s}_yaw")) for s in "ab")
    return attitude.relative_homography(
        a, b, F.lit(P.FOCAL_PX), F.lit(P.SENSOR_WIDTH_PX / 2.0), F.lit(P.SENSOR_HEIGHT_PX / 2.0)
    )


def edge_images(edges: DataFrame) -> DataFrame:
    """Every image that is an end of an edge, once."""
    return (
        edges.select("mission_id", F.explode(F.array("source", "target")).alias("image_name")).distinct()
    )


def needed_images(edges: DataFrame, captures: DataFrame) -> DataFrame:
    return captures.join(edge_images(edges), ["mission_id", "image_name"], "left_semi")


def edge_profile(edges: DataFrame) -> DataFrame:
    """Degree of every image and how many of its edges skip over image numbers."""
    from flightloom.functions.values import trailing_number

    gap = F.abs(trailing_number(F.col("source")) - trailing_number(F.col("target"))) > 1
    ends = edges.select(
        "mission_id", F.explode(F.array("source", "target")).alias("image_name"), F.coalesce(gap, F.lit(False)).alias("far")
    )
    return ends.groupBy("mission_id", "image_name").agg(
        F.count(F.lit(1)).alias("degree"), F.count_if("far").alias("non_sequential")
    )
