"""Detections of objects in images: filtered by score, size and depth, and lifted to the world."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posegrid.functions import geometry as G


def filter_detections(boxes: DataFrame, pixels: DataFrame, least: float = 0.08, area: float = 300, near: float = 0.1, far: float = 12.0, reach: int = 2) -> DataFrame:
    """Boxes (image, x1, y1, x2, y2, score, ...) with u, v, the whole-number centre, and depth, the
    median depth over `near` of the pixels (image, u, v, depth) at most `reach` from it.

    Corners are cut to whole numbers first. Boxes that score under `least`, are smaller than
    `area`, have no valid pixel or lie deeper than `far` are dropped. Pixels are joined by place,
    once for each centre, so many boxes on one centre cost one patch."""
    x1, y1, x2, y2 = (F.col(c).cast("int") for c in ("x1", "y1", "x2", "y2"))
    big = boxes.where((F.col("score") >= least) & ((x2 - x1) * (y2 - y1) >= area))
    big = big.withColumn("u", ((x1 + x2) / 2).cast("int")).withColumn("v", ((y1 + y2) / 2).cast("int"))
    around = F.sequence(F.lit(-reach), F.lit(reach))
    patch = big.select("image", "u", "v").distinct().withColumn("_a", F.explode(around)).withColumn("_b", F.explode(around))
    patch = patch.select("image", "u", "v", (F.col("u") + F.col("_a")).alias("_u"), (F.col("v") + F.col("_b")).alias("_v"))
    valid = pixels.where(F.col("depth") > near).select("image", F.col("u").alias("_u"), F.col("v").alias("_v"), "depth")
    depths = patch.join(valid, ["image", "_u", "_v"]).groupBy("image", "u", "v").agg(F.median("depth").alias("depth")).where(F.col("depth") <= far)
    return big.join(depths, ["image", "u", "v"])


def lift_detections(found: DataFrame, cameras: DataFrame) -> DataFrame:
    """Filtered detections with x, y, z in the world, by each image's camera: fx, fy, cx, cy and m,
    the 16 numbers of its pose, row-major. Images without a camera are dropped."""
    at = found.join(cameras.select("image", *[F.col(c).alias(f"_{c}") for c in ("fx", "fy", "cx", "cy", "m")]), "image")
    p = ((F.col("u") - F.col("_cx")) * F.col("depth") / F.col("_fx"), (F.col("v") - F.col("_cy")) * F.col("depth") / F.col("_fy"), F.col("depth"))
    m = lambda i: F.col("_m")[i]
    out = G.rotate_translate(p, [m(i) for i in (0, 1, 2, 4, 5, 6, 8, 9, 10)], (m(3), m(7), m(11)))
    return at.select(*found.columns, *[c.alias(k) for k, c in zip("xyz", out)])
