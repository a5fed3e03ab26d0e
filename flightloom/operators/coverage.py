"""Camera footprints, the ground cells they cover, and area per mission."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightloom import params as P
from flightloom.functions import footprint as fp
from flightloom.functions import geo
from flightloom.functions.values import num
from flightloom.operators.prepare import altitude_pos, image_rows, require_columns
from flightloom.operators.timeline import FirstOf, scan
from flightloom.session import cut_lineage


def footprints(df: DataFrame) -> DataFrame:
    """One footprint per image row with a position: size, area and four geodetic corners."""
    require_columns(df, ["latitude", "longitude", "image_name"])
    c = F.col
    usable = (
        image_rows(df)
        .withColumn("latitude", num(c("latitude")))
        .withColumn("longitude", num(c("longitude")))
        .filter((c("latitude") != 0) & (c("longitude") != 0))
    )
    sized = usable.select(
        "mission_id", "seq", "t", "image_name", "latitude", "longitude",
        altitude_pos(c("baro_altitude"), c("gps_altitude")).alias("altitude_m"),
        num(c("yaw")).alias("yaw_deg"),
    ).withColumn("size", fp.footprint_size(c("altitude_m")))
    return sized.select(
        "mission_id", "seq", "t", "image_name", "latitude", "longitude",
        F.greatest(c("altitude_m"), F.lit(P.MIN_FOOTPRINT_ALT_M)).alias("altitude_m"),
        "yaw_deg",
        c("size.width").alias("width_m"), c("size.height").alias("height_m"),
        fp.area_m2(c("size")).alias("area_m2"),
        fp.corners_geo(c("latitude"), c("longitude"), c("size"), c("yaw_deg")).alias("corners"),
    )


def cell_runs(shapes: DataFrame, grid: float = P.COVERAGE_GRID_M, slice_s: float = 3600.0) -> DataFrame:
    """(mission, seq, image, cy, first, last): the stretch of grid cells of one row whose centres lie
    inside a footprint. Cells are counted from the mission's first footprint.

    A footprint is convex, so each grid row it spans is one stretch; rows grow with the number of
    images and the height of a footprint only.
    """
    c = F.col
    anchored = scan(
        shapes, ["mission_id"], ["t", "seq"],
        [FirstOf("ref_lat", c("latitude")), FirstOf("ref_lon", c("longitude"))], slice_s,
    )
    local = [geo.to_local_ref(c("corners")[i]["lat"], c("corners")[i]["lon"], c("ref_lat"), c("ref_lon")) for i in range(4)]
    # eight plain numbers are cheaper to carry through the explode than nested corners
    flat = [q[part].alias(f"{part[0]}{i}") for i, q in enumerate(local) for part in ("east", "north")]
    quads = anchored.select("mission_id", "seq", "image_name", *flat)
    norths = [c(f"n{i}") for i in range(4)]
    low, high = F.floor(F.least(*norths) / grid).cast("bigint"), F.ceil(F.greatest(*norths) / grid).cast("bigint") - 1
    rows = quads.filter(high >= low).withColumn("cy", F.explode(F.sequence(low, high)))
    cut = fp.scanline((c("cy") + 0.5) * grid, [(c(f"e{i}"), c(f"n{i}")) for i in range(4)])
    # inline keeps the two cuts as columns; as plain expressions they would be worked out anew at every use
    cuts = rows.select("mission_id", "seq", "image_name", "cy", F.inline(F.array(cut))).filter(c("enter").isNotNull())
    # nearest cells, moved by one where their centre is not in [enter, leave)
    near = F.floor(c("enter") / grid).cast("bigint")
    far = F.ceil(c("leave") / grid).cast("bigint") - 1
    first = near + F.when((near + 0.5) * grid < c("enter"), 1).otherwise(0)
    last = far - F.when((far + 0.5) * grid >= c("leave"), 1).otherwise(0)
    return cuts.select(
        "mission_id", "seq", "image_name", "cy", first.alias("first"), last.alias("last")
    ).filter(c("last") >= c("first"))


def covered_cells(
    shapes: DataFrame, grid: float = P.COVERAGE_GRID_M, slice_s: float = 3600.0, cells_a_task: int = 2_000_000
) -> DataFrame:
    """(mission, image, cell) for every grid cell whose centre lies inside a footprint.

    Stretches are written and dealt by grid rows of a mission to as many tasks as their cells need, and listed there: what
    is then grouped by cell has its rows together already, and a task's groups do not grow with the table.
    """
    runs = cut_lineage(cell_runs(shapes, grid, slice_s))
    cells = runs.agg(F.sum(F.col("last") - F.col("first") + 1)).first()[0] or 0
    return runs.repartition(max(1, -(-cells // cells_a_task)), "mission_id", "cy").select(
        "mission_id", "seq", "image_name", F.explode(F.sequence("first", "last")).alias("cx"), "cy"
    )


def unique_cells(runs: DataFrame) -> DataFrame:
    """Distinct cells per mission from stretches, without listing them.

    Stretches that begin at the same cell are merged before the shuffle, so a mission that hovers
    over one place is as small as the place. What meets in one window is one grid row of one
    mission, at most one stretch per cell of it.
    """
    c = F.col
    merged = runs.groupBy("mission_id", "cy", "first").agg(F.max("last").alias("last"))
    before = Window.partitionBy("mission_id", "cy").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(c("first") - 1, F.coalesce(F.max("last").over(before), c("first") - 1))
    fresh = merged.select("mission_id", F.greatest(F.lit(0), c("last") - reached).alias("fresh"))
    return fresh.groupBy("mission_id").agg(F.sum("fresh").alias("cells"))


def coverage(
    shapes: DataFrame, grid: float = P.COVERAGE_GRID_M, missions: DataFrame | None = None, slice_s: float = 3600.0
) -> DataFrame:
    """Images, raw area, unique area and overlap per mission; zeros for a mission without footprints."""
    unique = unique_cells(cell_runs(shapes, grid, slice_s))
    raw = shapes.groupBy("mission_id").agg(F.count(F.lit(1)).alias("images"), F.sum("area_m2").alias("raw_area_m2"))
    both = raw.join(unique, "mission_id", "left")
    if missions is not None:
        both = missions.select("mission_id").distinct().join(both, "mission_id", "left")
    area = F.coalesce(F.col("cells"), F.lit(0)) * (grid * grid)
    raw_area = F.coalesce(F.col("raw_area_m2"), F.lit(0.0))
    return both.select(
        "mission_id",
        F.coalesce(F.col("images"), F.lit(0)).cast("bigint").alias("image_count"),
        raw_area.alias("raw_area_m2"),
        area.alias("unique_area_m2"),
        F.greatest(F.lit(0.0), raw_area - area).alias("overlap_area_m2"),
    )


def footprints_local(captures: DataFrame, slice_s: float = 3600.0) -> DataFrame:
    """Footprints in metres around the mission's first position, widened by tilt (pair prediction)."""
    c = F.col
    order = ["t", "seq"]
    anchored = scan(
        captures, ["mission_id"], order,
        [
            FirstOf("lat_set", c("latitude"), c("latitude") != 0), FirstOf("lat_any", c("latitude")),
            FirstOf("lon_set", c("longitude"), c("longitude") != 0), FirstOf("lon_any", c("longitude")),
        ],
        slice_s,
    )
    return local_shapes(
        anchored.withColumn("ref_lat", F.coalesce("lat_set", "lat_any")).withColumn(
            "ref_lon", F.coalesce("lon_set", "lon_any")
        )
    ).drop("lat_set", "lat_any", "lon_set", "lon_any")


def local_shapes(df: DataFrame) -> DataFrame:
    """Adds local centre, altitude, bounding box and area; needs ref_lat and ref_lon."""
    from flightloom.operators.prepare import altitude_floor

    c = F.col
    placed = df.withColumn("altitude_m", altitude_floor(c("baro_altitude"), c("gps_altitude"))).withColumn(
        "centre", geo.to_local_ref(c("latitude"), c("longitude"), c("ref_lat"), c("ref_lon"))
    )
    sized = placed.withColumn("size", fp.footprint_size_tilted(c("altitude_m"), c("roll"), c("pitch")))
    return (
        sized.withColumn("quad", fp.corners_local(c("centre.east"), c("centre.north"), c("size"), c("yaw")))
        .withColumn("box", fp.bounds(c("quad")))
        .withColumn("area_m2", fp.area_m2(c("size")))
        .drop("quad", "size")
    )
