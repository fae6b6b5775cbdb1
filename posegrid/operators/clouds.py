"""Point-cloud operators: voxels, extents, planes, ground, occupancy and morphology on cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posegrid.operators import tiles
from posegrid.operators.spatial import dbscan, density_parts
from posegrid.rand import seeded
from posegrid.session import materialise


#: Points of a task that goes by scene.
SHARE = 1 << 18


def _over_low(points: DataFrame, dims: list[str]) -> DataFrame:
    """points with _<dim>, their scene's least coordinates. They are dealt by scene to tasks whose number
    grows with the points, so that a task's sort and hash tables don't, whatever the number of shuffle
    partitions. Counting Parquet rows reads no column but those that a filter asks for."""
    tasks = max(points.sparkSession.sparkContext.defaultParallelism, -(-points.count() // SHARE))
    low = points.groupBy("scene").agg(*[F.min(d).alias(f"_{d}") for d in dims])
    # both sides dealt alike, or the join would deal the points again, to fewer tasks
    return points.repartition(tasks, "scene").join(low.repartition(tasks, "scene"), "scene")


def voxel_key(points: DataFrame, size: float, dims: list[str]) -> DataFrame:
    """Points with vx, vy, vz: floor((coordinate - the scene's least) / size)."""
    return _over_low(points, dims).withColumns({f"v{d[0]}": F.floor((F.col(d) - F.col(f"_{d}")) / F.lit(size)).cast("long") for d in dims}).drop(*[f"_{d}" for d in dims])


def voxel_downsample(points: DataFrame, size: float, dims: list[str], means: list[str]) -> DataFrame:
    """One row a voxel: means of coordinates and attributes, and the count. Over the union of
    frames this is their merged map, weighted by counts."""
    keyed = voxel_key(points, size, dims)
    return keyed.groupBy("scene", *[f"v{d[0]}" for d in dims]).agg(*[F.avg(c).alias(c) for c in [*dims, *means]], F.count("*").alias("n"))


def voxel_quat_mean(points: DataFrame, keys: list[str]) -> DataFrame:
    """Mean unit quaternion (qw, qx, qy, qz) of each group after members with a negative dot
    product with the naive mean are flipped; the naive mean is its own reference even if short, and
    a product within rounding of 0, as of members that cancel out, flips none."""
    q = ["qw", "qx", "qy", "qz"]
    naive = points.groupBy(*keys).agg(*[F.avg(c).alias(f"_{c}") for c in q])
    dot = sum((F.col(c) * F.col(f"_{c}") for c in q[1:]), F.col("qw") * F.col("_qw"))
    sign = F.when(F.round(dot, 9) < 0, -1.0).otherwise(1.0)
    mean = points.join(naive, keys).withColumn("_s", sign).groupBy(*keys).agg(*[F.avg(F.col(c) * F.col("_s")).alias(c) for c in q])
    size = F.greatest(F.sqrt(sum((F.col(c) * F.col(c) for c in q[1:]), F.col("qw") * F.col("qw"))), F.lit(1e-12))
    return mean.select(*keys, *[(F.col(c) / size).alias(c) for c in q])


def scene_extent(points: DataFrame, dims: list[str]) -> DataFrame:
    """Bounds, centroid and the point nearest the centroid (ties to the least place) of each scene."""
    box = points.groupBy("scene").agg(*[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])
    d2 = sum(((F.col(d) - F.col(f"mean_{d}")) * (F.col(d) - F.col(f"mean_{d}")) for d in dims[1:]), (F.col(dims[0]) - F.col(f"mean_{dims[0]}")) * (F.col(dims[0]) - F.col(f"mean_{dims[0]}")))
    near = points.join(box, "scene").groupBy("scene").agg(*[F.min_by(d, F.struct(F.round(d2, 6), *dims)).alias(f"near_{d}") for d in dims])
    return box.join(near, "scene")


def occupancy(points: DataFrame, size: float, flat: bool = True, pad: int = 4) -> DataFrame:
    """Distinct cells of a scene with the least cell at (pad, pad)."""
    dims = ["x", "y"] if flat else ["x", "y", "z"]
    return _over_low(points, dims).select("scene", *[(F.floor((F.col(d) - F.col(f"_{d}")) / F.lit(size)) + pad).cast("long").alias(f"g{d}") for d in dims]).distinct()


def scene_budget(cells: DataFrame, size: float, density: float, least: int, most: int, name: str) -> DataFrame:
    """int(cells * size^2 * density) within [least, most]: scene capacity and viewpoint budget."""
    return cells.groupBy("scene").agg(F.greatest(F.lit(least), F.least(F.lit(most), F.floor(F.count("*") * size * size * density).cast("int"))).alias(name))


def scene_quality(points: DataFrame, size: float, dims: list[str], eps: float | None = None, min_points: int = 10, least_points: int = 50, least_area: float = 5.0) -> DataFrame:
    """scene, n_points, area of the largest cluster, and ok: at least least_points points and, of their
    means by voxels of `size`, a density cluster (eps 2.5 sizes by default) of at least least_area,
    a voxel counting size^2."""
    low = points.groupBy("scene").agg(*[F.min(d).alias(f"_{d}") for d in dims])
    at = [F.floor((F.col(d) - F.col(f"_{d}")) / F.lit(size)).alias(f"_v{d}") for d in dims]
    even = points.join(low, "scene").groupBy("scene", *at).agg(*[F.round(F.avg(d), 9).alias(d) for d in dims]).select("scene", *dims)
    cell_area, eps = size * size, 2.5 * size if eps is None else eps
    clusters = density_parts(even, eps, min_points, dims).where("_head IS NOT NULL").groupBy("scene", "_head").agg(F.count("*").alias("k"))
    big = clusters.groupBy("scene").agg((F.max("k") * cell_area).alias("area"))
    n = points.groupBy("scene").agg(F.count("*").alias("n_points"))
    out = n.join(big, "scene", "left").withColumn("area", F.coalesce("area", F.lit(0.0)))
    return out.withColumn("ok", (F.col("n_points") >= least_points) & (F.col("area") >= least_area))


def remove_small_clusters(points: DataFrame, eps: float, min_points: int, dims: list[str], least: int) -> DataFrame:
    """Places of clusters with more than `least` places; noise goes."""
    labelled = materialise(dbscan(points, eps, min_points, dims).where("cluster IS NOT NULL").drop("n"), "labelled")
    large = labelled.groupBy("scene", "cluster").agg(F.count("*").alias("k")).where(F.col("k") > least)
    return labelled.join(large.hint("merge"), ["scene", "cluster"], "left_semi").select(*labelled.columns)


def _cell_id(*place: str) -> Column:
    return F.concat_ws("|", *[F.lpad((F.col(c).cast("long") + 10**9).cast("string"), 11, "0") for c in place])


def offsets(cells: DataFrame, shifts: list[tuple[int, int]]) -> DataFrame:
    """Every cell moved by every shift."""
    at = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in shifts])).alias("s")
    return cells.select("scene", "gx", "gy", at).select("scene", (F.col("gx") + F.col("s.a")).alias("gx"), (F.col("gy") + F.col("s.b")).alias("gy"))


def _parts(cells: DataFrame) -> DataFrame:
    """Distinct cells with _head, gx and gy of the least cell of their 8-connected part: a density cluster
    in which each cell is core, and neighbours are at most the square root of 2 away."""
    return density_parts(cells.select("scene", "gx", "gy"), 1.5, 1, ["gx", "gy"])


def cell_components(cells: DataFrame) -> DataFrame:
    """Cells with component: the least cell of their 8-connected part."""
    label = F.when(F.col("_head").isNotNull(), _cell_id("scene", "_head.gx", "_head.gy")).otherwise(_cell_id("scene", "gx", "gy"))
    return _parts(cells).select("scene", "gx", "gy", label.alias("component"))


def despeckle(cells: DataFrame, most: int = 8) -> DataFrame:
    """Cells of 8-connected parts with more than `most` cells, each once."""
    part = _parts(cells)
    large = part.groupBy("scene", "_head").agg(F.count("*").alias("k")).where(F.col("k") > most)
    return part.join(large.hint("merge"), ["scene", "_head"], "left_semi").select("scene", "gx", "gy")


def disk(radius: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]


def dilate(cells: DataFrame, kernel: list[tuple[int, int]]) -> DataFrame:
    return offsets(cells, kernel).distinct()


def erode(cells: DataFrame, kernel: list[tuple[int, int]]) -> DataFrame:
    """Cells all of whose kernel neighbours are cells."""
    back = offsets(cells.select("scene", "gx", "gy").distinct(), [(-a, -b) for a, b in kernel])
    return back.groupBy("scene", "gx", "gy").agg(F.count("*").alias("k")).where(F.col("k") == len(kernel)).drop("k")


def walkable_fill(ground: DataFrame, obstacles: DataFrame, gap: int, grow: int) -> DataFrame:
    """New cells: the ground's closing by a disk of radius `gap`, without ground and without
    obstacles grown by `grow` cells. By tiles: a cell's part hangs on ground within 2 gap of it."""
    halo, near, around = max(2 * gap, grow), disk(gap), disk(grow)

    def run(x: np.ndarray, y: np.ndarray, kind: np.ndarray) -> dict[str, np.ndarray]:
        own, obst = tiles.grid(x[kind == 0], y[kind == 0], halo), tiles.grid(x[kind == 1], y[kind == 1], halo)
        wide = np.logical_or.reduce([tiles.moved(own, a, b) for a, b in near])
        new = np.logical_and.reduce([tiles.moved(wide, -a, -b) for a, b in near])
        for a, b in around:
            new &= ~tiles.moved(obst, a, b)
        return dict(zip("xy", np.nonzero(new & ~own)))

    kinds = [d.select("scene", "gx", "gy", F.lit(k).alias("kind")) for k, d in enumerate((ground, obstacles))]
    return tiles.by_tiles(kinds[0].unionByName(kinds[1]), halo, run)


def fit_planes(points: DataFrame, order: list[str], tolerance: float, tries: int = 50, seed: int = 7, steep: float = 0.5) -> DataFrame:
    """scene, a, b, c, d, inliers: the plane ax + by + cz + d = 0 with unit normal, c >= 0, through
    one of `tries` seeded triples of points that has most points within tolerance; ties to the
    first triple. Planes with |c| < steep are walls and lose to any other. order: a total order of points."""
    w = Window.partitionBy("scene").orderBy(seeded(seed, *order), *order)
    some = points.select("scene", "x", "y", "z", F.row_number().over(w).alias("k")).where(F.col("k") <= 3 * tries).withColumn("t", F.floor((F.col("k") - 1) / 3)).withColumn("j", (F.col("k") - 1) % 3)
    p = some.groupBy("scene", "t").agg(*[F.max(F.when(F.col("j") == j, F.col(c))).alias(f"{c}{j}") for j in range(3) for c in "xyz"]).where("x2 IS NOT NULL")
    u, v = [F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz"], [F.col(f"{c}2") - F.col(f"{c}0") for c in "xyz"]
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    p = p.withColumn("_s", size).where("_s > 1e-9").withColumn("_g", F.when(n[2] < 0, -1.0).otherwise(1.0))
    p = p.select("scene", "t", *[(x * F.col("_g") / F.col("_s")).alias(k) for k, x in zip("abc", n)], "x0", "y0", "z0")
    p = p.withColumn("d", -(F.col("a") * F.col("x0") + F.col("b") * F.col("y0") + F.col("c") * F.col("z0"))).drop("x0", "y0", "z0")
    # at most `tries` planes a scene are joined to its points
    away = F.abs(F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c") * F.col("z") + F.col("d"))
    votes = points.select("scene", "x", "y", "z").join(p, "scene").groupBy("scene", "t").agg(F.count(F.when(F.round(away, 9) <= tolerance, 1)).alias("inliers"))
    best = Window.partitionBy("scene").orderBy(F.abs("c") < steep, F.desc("inliers"), "t")
    return p.join(votes, ["scene", "t"]).withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k", "t")


def level_scene(points: DataFrame, planes: DataFrame, tolerance: float) -> DataFrame:
    """Points rotated so that their scene's plane normal is +z, then lowered by the mean height of
    the plane's points; scenes without a plane are lowered by their median z."""
    d = points.join(planes, "scene", "left")
    a, b, c = (F.col(k) for k in "abc")
    # rotation taking (a, b, c) to (0, 0, 1): I + [v]x + [v]x^2 / (1 + c), v = (b, -a, 0)
    k = 1.0 / (1.0 + c)
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    rx = x * (1.0 - a * a * k) - y * a * b * k - a * z
    ry = -x * a * b * k + y * (1.0 - b * b * k) - b * z
    rz = a * x + b * y + c * z
    r = d.withColumns({"rx": F.coalesce(rx, x), "ry": F.coalesce(ry, y), "rz": F.coalesce(rz, z), "on": F.abs(rz + F.col("d")) <= tolerance})
    base = r.groupBy("scene").agg(F.coalesce(F.avg(F.when(F.col("on"), F.col("rz"))), F.percentile("rz", 0.5)).alias("base"))
    return r.join(base, "scene").select(*[F.col(c) for c in points.columns if c not in ("x", "y", "z")], F.col("rx").alias("x"), F.col("ry").alias("y"), (F.col("rz") - F.col("base")).alias("z"))


def classify_ground(points: DataFrame, planes: DataFrame, tolerance: float, low: float = 0.1, high: float = 1.8) -> DataFrame:
    """Points with layer: ground within tolerance of the plane, obstacle between low and high over it, else other."""
    h = F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c") * F.col("z") + F.col("d")
    d = points.join(planes.select("scene", "a", "b", "c", "d"), "scene").withColumn("h", F.round(h, 9))
    layer = F.when(F.abs("h") <= tolerance, "ground").when((F.col("h") > low) & (F.col("h") < high), "obstacle").otherwise("other")
    return d.withColumn("layer", layer).drop("a", "b", "c", "d", "h")
