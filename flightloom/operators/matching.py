"""Descriptor matches between images, and what is made of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from flightloom import params as P

_MATCH_SCHEMA = "{keys}, query_idx bigint, train_idx bigint, distance double"


def _blocks(descriptors: DataFrame, keys: list[str], size: int) -> tuple[DataFrame, DataFrame]:
    """Descriptors with the block of about ``size`` they belong to, and the number of blocks of each image.

    The block number comes from the feature id, so an image with very many features becomes many blocks.
    """
    counts = descriptors.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= 2)
    counts = counts.select(*keys, F.greatest(F.ceil(F.col("_n") / size), F.lit(1)).alias("_blocks"))
    block = F.pmod(F.xxhash64("feature_id"), F.col("_blocks")).cast("bigint")
    return descriptors.join(counts, keys).select(*keys, "feature_id", "vec", block.alias("_block")), counts


def _two_nearest(hamming: bool, keys: list[str], slice_rows: int = 256):
    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not hamming:
            return np.stack([np.sqrt(((b - row) ** 2).sum(axis=1)) for row in a])
        return np.stack([np.bitwise_count(np.bitwise_xor(b, row)).sum(axis=1).astype(float) for row in a])

    def read(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        kind = np.int64 if hamming else np.float64
        ids = np.array(table.column("feature_id").to_pylist())
        order = np.argsort(ids, kind="stable")
        return ids[order], np.array(table.column("vec").to_pandas().tolist(), dtype=kind)[order]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        fields = [(left if left.num_rows else right).schema.field(i).with_name(k) for i, k in enumerate(keys)]
        schema = pa.schema([*fields, ("query_idx", pa.int64()), ("train_idx", pa.int64()), ("distance", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        (ids_a, a), (ids_b, b) = read(left), read(right)
        found = []
        # slices of the query block keep the distances small and the result exact
        for at in range(0, len(a), slice_rows):
            d = distances(a[at : at + slice_rows], b)
            best = np.argsort(d, axis=1, kind="stable")[:, :2]
            found.append((np.repeat(ids_a[at : at + slice_rows], best.shape[1]), ids_b[best].ravel(), np.take_along_axis(d, best, axis=1).ravel()))
        made = [np.concatenate(x) for x in zip(*found)]
        same = [pa.array([left.column(i)[0].as_py()] * len(made[0]), f.type) for i, f in enumerate(fields)]
        return pa.Table.from_arrays([*same, *[pa.array(x, t) for x, t in zip(made, schema.types[len(fields):])]], schema=schema)

    return run


DESCRIPTORS = "image_name string, feature_id bigint, x double, y double, scale double, vec array<double>"


def extract_features(images: DataFrame, backend) -> DataFrame:
    """Descriptors from a backend of the caller's: a function from batches of image rows (pandas) to
    batches of the DESCRIPTORS layout. None is shipped here."""
    return images.mapInPandas(backend, DESCRIPTORS)


def ratio_matches(
    edges: DataFrame, descriptors: DataFrame, ratio: float = P.MATCH_RATIO, hamming: bool = False, block: int = 2048,
    by: list[str] | None = None,
) -> DataFrame:
    """For each feature of an edge's source image its nearest feature in the target image, kept when
    clearly nearer than the second nearest.

    Descriptors meet block against block; a task sees two blocks and passes on two candidates per
    feature, never the pairs. Images with fewer than two descriptors match nothing. Vectors are
    arrays of double (Euclidean) or bigint (bits).
    """
    import flightloom.operators.matching as here

    cloudpickle.register_pickle_by_value(here)
    keys = by or []
    blocked, counts = _blocks(descriptors, [*keys, "image_name"], block)
    names = [*keys, "source", "target"]

    def side(df: DataFrame, image: str, tag: str) -> DataFrame:
        return df.select(*keys, F.col("image_name").alias(image), *[F.col(x).alias(f"{x}{tag}" if x[0] == "_" else x) for x in df.columns if x not in (*keys, "image_name")])

    met = edges.select(*names).distinct().join(side(counts, "source", "_a"), [*keys, "source"]).join(side(counts, "target", "_b"), [*keys, "target"])
    # each descriptor goes to every block of the other image
    others = {tag: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"_blocks{tag}").cast("bigint") - 1)).alias(f"_block{tag}") for tag in ("_a", "_b")}
    a = met.select(*names, others["_b"]).join(side(blocked, "source", "_a"), [*keys, "source"])
    b = met.select(*names, others["_a"]).join(side(blocked, "target", "_b"), [*keys, "target"])
    types = dict(met.dtypes)
    schema = _MATCH_SCHEMA.format(keys=", ".join(f"{k} {types[k]}" for k in names))
    pair = [*names, "_block_a", "_block_b"]

    def grouped(df: DataFrame, tag: str) -> GroupedData:
        # both sides come from the same tables, so their keys get names of their own
        return df.select(*[F.col(k).alias(f"_{tag}{i}") for i, k in enumerate(pair)], "feature_id", "vec").groupBy(*[f"_{tag}{i}" for i in range(len(pair))])

    near = grouped(a, "l").cogroup(grouped(b, "r")).applyInArrow(_two_nearest(hamming, names), schema)
    ranked = Window.partitionBy(*names, "query_idx").orderBy("distance", "train_idx")
    two = near.withColumn("_r", F.row_number().over(ranked)).filter(F.col("_r") <= 2)
    best = two.groupBy(*names, "query_idx").agg(
        F.min_by(F.struct("train_idx", "distance"), "_r").alias("_b"),
        F.max(F.when(F.col("_r") == 2, F.col("distance"))).alias("_second"),
    )
    kept = best.filter(F.col("_b.distance") < F.col("_second") * ratio)
    return kept.select(*names, "query_idx", "_b.train_idx", "_b.distance")


def matched_points(matches: DataFrame, keypoints: DataFrame, keys: list[str]) -> DataFrame:
    """Pixel pairs of the matches in original image size. Keypoints: image_name, feature_id, x, y, scale."""
    def side(image, feature, tag):
        return keypoints.select(
            *keys, F.col("image_name").alias(image), F.col("feature_id").alias(feature),
            (F.col("x") / F.col("scale")).alias(f"x_{tag}"), (F.col("y") / F.col("scale")).alias(f"y_{tag}"),
        )

    return matches.join(side("source", "query_idx", "a"), [*keys, "source", "query_idx"]).join(
        side("target", "train_idx", "b"), [*keys, "target", "train_idx"]
    )


def inlier_matches(matches: DataFrame, geometry: DataFrame, keys: list[str]) -> DataFrame:
    """Matches of accepted pairs whose position is flagged in the pair's inlier mask (array of flags).

    Matches carry ``match_no``, their 0-based position within the pair.
    """
    flags = geometry.filter("accepted").select(*keys, F.posexplode("inlier_mask").alias("match_no", "_in"))
    return matches.join(flags.filter("_in").drop("_in"), [*keys, "match_no"])


def raw_match_bound(edges: DataFrame, descriptors: DataFrame, keys: list[str]) -> DataFrame:
    counts = descriptors.groupBy(*keys, "image_name").agg(F.count(F.lit(1)).alias("n"))
    a = counts.select(*keys, F.col("image_name").alias("source"), F.col("n").alias("n_a"))
    b = counts.select(*keys, F.col("image_name").alias("target"), F.col("n").alias("n_b"))
    both = edges.join(a, [*keys, "source"], "left").join(b, [*keys, "target"], "left")
    return both.withColumn("bound", F.least(F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0)))).drop("n_a", "n_b")


def select_geometry(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Best model of each pair by inliers, then in the fixed order of models, and whether it is accepted.

    Needs model, matches, inliers. Too few matches give model NONE.
    """
    priority = F.coalesce(
        F.nullif(F.array_position(F.array(*[F.lit(m) for m in P.MODELS]), F.col("model")), F.lit(0)), F.lit(10)
    )
    best = F.min_by(F.struct("model", "matches", "inliers"), F.struct(-F.col("inliers"), priority))
    picked = candidates.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")
    enough = F.col("matches") >= P.MIN_MATCHES
    share = F.when(enough, F.col("inliers") / F.nullif(F.col("matches"), F.lit(0))).otherwise(0.0)
    return picked.select(
        *keys, F.when(enough, F.col("model")).otherwise("NONE").alias("model"), "matches",
        F.when(enough, F.col("inliers")).otherwise(0).alias("inliers"), share.alias("inlier_ratio"),
        (enough & (F.col("inliers") >= P.MIN_INLIERS) & (share >= P.MIN_INLIER_RATIO)).alias("accepted"),
    )


def sample_pairs(geometry: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    """Best, middle and worst rejected pair per group, by inliers."""
    from flightloom.operators.timeline import RowNumber, Whole, scan

    ranked = scan(
        geometry.withColumn("_neg", -F.col("inliers")), by, ["_neg", *order],
        [RowNumber("_r"), Whole("_n", F.lit(1), "count")], 64.0,
    )
    worst = scan(
        ranked.filter(~F.col("accepted")), by, ["_neg", *order], [Whole("_last", F.col("_r"), "max")], 64.0
    ).filter(F.col("_r") == F.col("_last"))
    columns = geometry.columns
    return (
        ranked.filter("_r = 1").select(F.lit("good").alias("label"), *columns)
        .unionByName(ranked.filter(F.col("_r") == F.floor(F.col("_n") / 2) + 1).select(F.lit("average").alias("label"), *columns))
        .unionByName(worst.select(F.lit("rejected").alias("label"), *columns))
    )


def uncached(images: DataFrame, cache: DataFrame, settings: str) -> DataFrame:
    """Images whose (path, time, size, settings) signature is not in the cache yet."""
    from flightloom.functions.values import signature

    signed = images.withColumn("signature", signature(F.col("path"), F.col("modified"), F.col("length"), F.lit(settings)))
    return signed.join(cache.select("signature").distinct(), "signature", "left_anti")
