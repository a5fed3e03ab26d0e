"""Elevation cells from points, blended cells, and measures of image tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightloom import params as P
from flightloom.functions.geo import is_finite
from flightloom.functions.values import clamp01
from flightloom.operators.quantiles import exact_quantiles


def finite_points(points: DataFrame) -> DataFrame:
    return points.filter(is_finite(F.col("x")) & is_finite(F.col("y")) & is_finite(F.col("z")))


def trim_heights(points: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Points between two exact height percentiles of the whole cloud (a scalar subquery, no join)."""
    fine = finite_points(points)
    limits = exact_quantiles(fine, [], "z", {"low": low, "high": high}).select(
        F.struct("low", "high").alias("range")
    )
    span = limits.scalar()
    return fine.filter(F.col("z").between(span["low"], span["high"]))


def grid_shape(points: DataFrame, resolution: float) -> DataFrame:
    """One row: origin, width and height of the raster."""
    ext = points.agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
        F.count(F.lit(1)).alias("points"),
    )
    # cells from the lowest to the highest coordinate, both ends included
    return ext.select(
        "x0", "y1", "points",
        (F.ceil((F.col("x1") - F.col("x0")) / resolution).cast("bigint") + 1).alias("width"),
        (F.ceil((F.col("y1") - F.col("y0")) / resolution).cast("bigint") + 1).alias("height"),
    )


def dsm(
    points: DataFrame, resolution: float = 0.25, share: float = 0.9, min_points: int = 100,
) -> DataFrame:
    """Surface height per cell (row, col, z): exact 90th percentile of the trimmed points in it.

    Empty when there are too few points or the grid is degenerate; a cell without
    points has no row.
    """
    c = F.col
    trimmed = trim_heights(points)
    shape = grid_shape(trimmed, resolution).filter((c("width") > 1) & (c("height") > 1))
    grid = shape.select(F.struct("x0", "y1", "width", "height").alias("grid")).scalar()
    enough = points.agg(F.count(F.lit(1)).alias("n")).scalar() >= min_points
    on_grid = trimmed.filter(enough).withColumn("g", grid).filter(c("g").isNotNull())

    def cell(distance, size):
        return F.least(F.greatest(F.floor(distance / resolution), F.lit(0)), size - 1).cast("bigint")

    placed = on_grid.select(
        cell(c("g.y1") - c("y"), c("g.height")).alias("row"), cell(c("x") - c("g.x0"), c("g.width")).alias("col"), "z"
    )
    return exact_quantiles(placed, ["row", "col"], "z", {"height": share}).select(
        "row", "col", c("n").alias("points"), c("height").alias("z")
    )


def blend_cells(tiles: DataFrame, by: list[str], value: str = "v", weight: str = "w") -> DataFrame:
    """Weighted mean per cell where the weights add up to something."""
    sums = tiles.groupBy(*by).agg(
        F.sum(F.col(value) * F.col(weight)).alias("_vw"), F.sum(weight).alias("weight_sum")
    )
    return sums.filter(F.col("weight_sum") > 1e-6).select(*by, (F.col("_vw") / F.col("weight_sum")).alias("value"), "weight_sum")


def raster_extent(cells: DataFrame, by: list[str], max_dim: int, image_pixels: float) -> DataFrame:
    """Bounding rows and columns, the scale that fits a largest side, and the size after it."""
    c = F.col
    box = cells.groupBy(*by).agg(
        F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("col").alias("col0"), F.max("col").alias("col1")
    )
    w, h = c("col1") - c("col0") + 1, c("row1") - c("row0") + 1
    scale = F.least(F.lit(1.0), F.lit(float(max_dim)) / F.greatest(w, h))
    out_w, out_h = F.greatest(F.lit(1), F.ceil(w * scale)), F.greatest(F.lit(1), F.ceil(h * scale))
    return box.select(
        "*", scale.alias("scale"), out_w.cast("bigint").alias("width"), out_h.cast("bigint").alias("height"),
        (out_w * out_h / 1e6).alias("megapixels"), (out_w * out_h / float(image_pixels)).alias("image_ratio"),
    )


def tile_metrics(pixels: DataFrame, by: list[str], rows: int, cols: int) -> DataFrame:
    """Laplacian variance, brightness and clipped shares per tile.

    The 4-neighbour Laplacian is a sum over each pixel's spread of +1 to its neighbours and -4 to
    itself; the border mirrors without repeating the edge pixel. Every pixel sends at most nine
    rows, whatever the tile, and the sums are combined before the shuffle.
    """
    c = F.col

    sends = []
    for axis, size in (("r", rows), ("c", cols)):
        at, other = c(axis), c("c" if axis == "r" else "r")

        def cell(value, axis=axis, other=other):
            r, k = (value, other) if axis == "r" else (other, value)
            return r.cast("bigint").alias("r"), k.cast("bigint").alias("c")

        if size > 1:
            # the pixel below/right of me reads me as its lower neighbour; the border reads me twice
            for step in (-1, 1):
                reader = at + step
                edge = 0 if step == -1 else size - 1
                weight = F.when(reader == edge, 2).otherwise(1)
                inside = (reader >= 0) & (reader < size)
                sends.append(F.when(inside, F.struct(*cell(reader), (c("g") * weight).alias("v"))))
        else:
            sends.append(F.struct(*cell(at), (c("g") * 2).alias("v")))
    own = F.struct(c("r").cast("bigint").alias("r"), c("c").cast("bigint").alias("c"), (c("g") * -4).alias("v"))
    spread = pixels.select(*by, F.explode(F.array_compact(F.array(own, *sends))).alias("_s")).select(*by, "_s.*")
    laplace = spread.groupBy(*by, "r", "c").agg(F.sum("v").alias("lap"))
    blur = laplace.groupBy(*by).agg(F.var_pop("lap").alias("blur_variance"))
    plain = pixels.groupBy(*by).agg(
        F.avg("g").alias("brightness"),
        F.avg(F.when(c("g") <= 3, 1.0).otherwise(0.0)).alias("shadow_share"),
        F.avg(F.when(c("g") >= 252, 1.0).otherwise(0.0)).alias("highlight_share"),
        F.avg(F.when(c("g") < 20, 1.0).otherwise(0.0)).alias("dark_share"),
        F.avg(F.when(c("g") > 245, 1.0).otherwise(0.0)).alias("bright_share"),
    )
    return plain.join(blur, by)


_FLAGS = (
    # name, test over the metric columns; kept in this order
    ("blur", lambda c: c("blur_variance") < P.BLUR_MIN_VARIANCE),
    ("underexposed", lambda c: c("brightness") < P.EXPOSURE_LOW),
    ("overexposed", lambda c: c("brightness") > P.EXPOSURE_HIGH),
    ("clipped_shadows", lambda c: c("shadow_share") > P.CLIPPED_SHARE),
    ("clipped_highlights", lambda c: c("highlight_share") > P.CLIPPED_SHARE),
    ("tilt", lambda c: c("tilt_deg") > P.MAX_TILT_DEG),
    ("motion", lambda c: c("angular_rate_dps") > P.MAX_RATE_DPS),
)


def image_quality(captures: DataFrame, metrics: DataFrame, keys: list[str], missing_file: bool = False) -> DataFrame:
    """Scores, flags, status and usability per image.

    An image without metrics counts as unreadable, or as missing or corrupt when ``missing_file`` says
    that no file is the reason.
    """
    absent, absent_share = ("missing_or_corrupt", 0.0) if missing_file else ("unreadable", 1.0)
    c = F.col
    base = captures.join(metrics, keys, "left").withColumn("_read", c("blur_variance").isNotNull())
    base = base.withColumn("tilt_deg", F.hypot("roll", "pitch")).withColumn(
        "angular_rate_dps", F.sqrt(c("gyro_x") * c("gyro_x") + c("gyro_y") * c("gyro_y") + c("gyro_z") * c("gyro_z"))
    )
    middle, half = (P.EXPOSURE_LOW + P.EXPOSURE_HIGH) / 2.0, (P.EXPOSURE_HIGH - P.EXPOSURE_LOW) / 2.0
    bright = clamp01(1.0 - F.abs(c("brightness") - middle) / half)
    clipping = F.greatest("shadow_share", "highlight_share")
    scores = {
        "sharpness_score": clamp01(c("blur_variance") / P.BLUR_MIN_VARIANCE),
        "exposure_score": clamp01(bright * 0.75 + (1.0 - clipping) * 0.25),
        "pose_score": clamp01(1.0 - c("tilt_deg") / P.MAX_TILT_DEG),
        "motion_score": clamp01(1.0 - c("angular_rate_dps") / P.MAX_RATE_DPS),
    }
    scored = base.select("*", *[F.when(c("_read"), v).otherwise(0.0).alias(k) for k, v in scores.items()])
    total = (
        c("sharpness_score") * 0.35 + c("exposure_score") * 0.25 + c("pose_score") * 0.20 + c("motion_score") * 0.20
    )
    found = F.array_compact(F.array(*[F.when(test(F.col), F.lit(name)) for name, test in _FLAGS]))
    flagged = scored.withColumn("total_score", total).withColumn(
        "flags", F.when(c("_read"), found).otherwise(F.array(F.lit(absent)))
    )
    status = (
        F.when(~c("_read"), "REJECTED")
        .when((c("total_score") >= P.GOOD_SCORE) & (F.size("flags") == 0), "GOOD")
        .when(c("total_score") >= P.MARGINAL_SCORE, "MARGINAL")
        .otherwise("REJECTED")
    )
    judged = flagged.withColumn("status", status)
    joined = F.array_join("flags", ",")
    reason = (
        F.when(c("status") == "GOOD", "")
        .when((c("status") == "REJECTED") & (joined == ""), "low_score")
        .otherwise(joined)
    )

    def blank(name, value):
        return F.when(c("_read"), c(name)).otherwise(F.lit(value)).alias(name)

    return judged.select(
        *dict.fromkeys(["mission_id", "image_name", *keys]),
        "sharpness_score", "exposure_score", "motion_score", "pose_score", "total_score",
        (c("status") != "REJECTED").alias("usable"), reason.alias("rejection_reason"), "status",
        blank("blur_variance", 0.0), blank("brightness", 0.0), blank("shadow_share", absent_share), blank("highlight_share", absent_share),
        blank("tilt_deg", 0.0), blank("angular_rate_dps", 0.0), "flags",
    )
