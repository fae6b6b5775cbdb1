"""Queries over point clouds and walkable cells (views cloud, cells)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from posegrid.operators import clouds as C
from posegrid.operators import spatial as S
from posegrid.plans.register import Registry
from posegrid.rand import sql_seeded

R = Registry()
XYZ = ["x_cm", "y_cm", "z_cm"]
_LOW = "low AS (SELECT scene, min(x_cm) AS x0, min(y_cm) AS y0, min(z_cm) AS z0 FROM {cloud} GROUP BY scene)"
_PLACES = "places AS (SELECT scene, x_cm, y_cm, z_cm, count(*) AS n FROM {cloud} GROUP BY ALL)"
#: Pairs of places within 5 cm, found by cells of 5 cm.
_PAIRS = """pairs AS (SELECT a.scene, a.x_cm, a.y_cm, a.z_cm, b.n AS bn, b.x_cm AS bx, b.y_cm AS b_y, b.z_cm AS bz
  FROM (SELECT *, x_cm // 5 + i AS cx, y_cm // 5 + j AS cy, z_cm // 5 + k AS cz FROM places, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j), (SELECT unnest([-1, 0, 1]) AS k)) a
  JOIN places b ON a.scene = b.scene AND a.cx = b.x_cm // 5 AND a.cy = b.y_cm // 5 AND a.cz = b.z_cm // 5
  WHERE pow(a.x_cm - b.x_cm, 2) + pow(a.y_cm - b.y_cm, 2) + pow(a.z_cm - b.z_cm, 2) <= 25)"""


def _mean(*cols):
    return [F.round(F.col(c) + 1e-9, 6).alias(c) for c in cols]


@R.query("cloud", sql=f"""
WITH {_LOW} SELECT scene, (x_cm - x0) // 5 AS vx, (y_cm - y0) // 5 AS vy, (z_cm - z0) // 5 AS vz, round(avg(x_cm) + 1e-9, 6) AS x_cm, round(avg(r) + 1e-9, 6) AS r, round(avg(g) + 1e-9, 6) AS g, round(avg(b) + 1e-9, 6) AS b, count(*) AS n
FROM {{cloud}} JOIN low USING (scene) GROUP BY scene, (x_cm - x0) // 5, (y_cm - y0) // 5, (z_cm - z0) // 5""")
def voxel_downsample(cloud):
    v = C.voxel_downsample(cloud, 5, XYZ, ["r", "g", "b"])
    return v.select("scene", "vx", "vy", "vz", *_mean("x_cm", "r", "g", "b"), "n")


@R.query("cloud", sql=f"""
WITH {_LOW}, f AS (SELECT * FROM {{cloud}} WHERE l_linenumber <= 3 UNION ALL SELECT * FROM {{cloud}} WHERE l_linenumber > 3)
SELECT scene, (x_cm - x0) // 10 AS vx, (y_cm - y0) // 10 AS vy, (z_cm - z0) // 10 AS vz, round(avg(r) + 1e-9, 6) AS r, count(*) AS n FROM f JOIN low USING (scene) GROUP BY scene, (x_cm - x0) // 10, (y_cm - y0) // 10, (z_cm - z0) // 10""")
def scene_map(cloud):
    frames = cloud.where("l_linenumber <= 3").unionByName(cloud.where("l_linenumber > 3"))
    return C.voxel_downsample(frames, 10, XYZ, ["r"]).select("scene", "vx", "vy", "vz", *_mean("r"), "n")


_Q = "q AS (SELECT scene, x_cm // 20 AS vx, y_cm // 20 AS vy, cos(r * 20) * s AS qw, sin(r * 20) * s AS qx FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN 1.0 ELSE -1.0 END AS s FROM {cloud}))"


@R.query("cloud", sql=f"""
WITH {_Q}, m AS (SELECT scene, vx, vy, avg(qw) AS mw, avg(qx) AS mx FROM q GROUP BY ALL),
f AS (SELECT q.scene, q.vx, q.vy, avg(qw * g) AS qw, avg(qx * g) AS qx FROM (SELECT q.*, CASE WHEN round(qw * mw + qx * mx, 9) < 0 THEN -1.0 ELSE 1.0 END AS g FROM q JOIN m ON q.scene = m.scene AND q.vx = m.vx AND q.vy = m.vy) q GROUP BY ALL)
SELECT scene, vx, vy, round(abs(qw / greatest(sqrt(qw * qw + qx * qx), 1e-12)), 4) AS qw, round(abs(qx / greatest(sqrt(qw * qw + qx * qx), 1e-12)), 4) AS qx FROM f""")  # fmt: skip
def voxel_quaternions(cloud):
    s = F.when(F.col("l_linenumber") % 2 == 0, 1.0).otherwise(-1.0)
    q = cloud.select("scene", F.floor(F.col("x_cm") / 20).alias("vx"), F.floor(F.col("y_cm") / 20).alias("vy"), (F.cos(F.col("r") * 20) * s).alias("qw"), (F.sin(F.col("r") * 20) * s).alias("qx"), F.lit(0.0).alias("qy"), F.lit(0.0).alias("qz"))
    return C.voxel_quat_mean(q, ["scene", "vx", "vy"]).select("scene", "vx", "vy", F.round(F.abs("qw"), 4).alias("qw"), F.round(F.abs("qx"), 4).alias("qx"))


@R.query("cloud", sql="""
WITH b AS (SELECT scene, min(x_cm) AS min_x, max(x_cm) AS max_x, avg(x_cm) AS mx, min(y_cm) AS min_y, max(y_cm) AS max_y, avg(y_cm) AS my, avg(z_cm) AS mz FROM {cloud} GROUP BY scene),
d AS (SELECT c.scene, x_cm, y_cm, z_cm, round(pow(x_cm - mx, 2) + pow(y_cm - my, 2) + pow(z_cm - mz, 2), 6) AS d FROM {cloud} c JOIN b ON c.scene = b.scene),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY d, x_cm, y_cm, z_cm) AS k FROM d) WHERE k = 1)
SELECT b.scene, min_x, max_x, round(mx + 1e-9, 6) AS mean_x, min_y, max_y, n.x_cm AS near_x, n.y_cm AS near_y, n.z_cm AS near_z FROM b JOIN n ON b.scene = n.scene""")
def scene_extent(cloud):
    e = C.scene_extent(cloud, XYZ)
    return e.select("scene", F.col("min_x_cm").alias("min_x"), F.col("max_x_cm").alias("max_x"), F.round(F.col("mean_x_cm") + 1e-9, 6).alias("mean_x"), F.col("min_y_cm").alias("min_y"), F.col("max_y_cm").alias("max_y"), *[F.col(f"near_{d}").alias(f"near_{d[0]}") for d in XYZ])


def _metres(cloud):
    return cloud.select("scene", *[F.col(d).alias(d[0]) for d in XYZ])


@R.query("cloud", sql=f"WITH {_LOW} SELECT DISTINCT scene, (x_cm - x0) // 5 + 4 AS gx, (y_cm - y0) // 5 + 4 AS gy FROM {{cloud}} JOIN low USING (scene)")
def occupancy_flat(cloud):
    return C.occupancy(_metres(cloud), 5)


@R.query("cloud", sql=f"WITH {_LOW} SELECT DISTINCT scene, (x_cm - x0) // 5 + 4 AS gx, (y_cm - y0) // 5 + 4 AS gy, (z_cm - z0) // 5 + 4 AS gz FROM {{cloud}} JOIN low USING (scene)")
def occupancy_solid(cloud):
    return C.occupancy(_metres(cloud), 5, flat=False)


@R.query("cells", sql="SELECT scene, greatest(50, least(1000, CAST(floor(count(*) * 0.05 * 0.05 * 20) AS INTEGER))) AS capacity FROM {cells} GROUP BY scene")
def scene_capacity(cells):
    return C.scene_budget(cells, 0.05, 20, 50, 1000, "capacity")


@R.query("cells", sql="SELECT scene, greatest(10, least(500, CAST(floor(count(*) * 0.05 * 0.05 * 0.5) AS INTEGER))) AS views FROM {cells} GROUP BY scene")
def view_budget(cells):
    return C.scene_budget(cells, 0.05, 0.5, 10, 500, "views")


@R.query("cloud", sql=f"WITH {_PLACES}, {_PAIRS} SELECT scene, x_cm, y_cm, z_cm, sum(bn)::BIGINT AS neighbours FROM pairs GROUP BY ALL")
def radius_counts(cloud):
    return S.place_counts(cloud, 5.0, XYZ).drop("n")


@R.query("cloud", sql=f"WITH {_PLACES}, {_PAIRS}, k AS (SELECT scene, x_cm, y_cm, z_cm FROM pairs GROUP BY ALL HAVING sum(bn) >= 2) SELECT scene, x_cm, y_cm, z_cm, n FROM places JOIN k USING (scene, x_cm, y_cm, z_cm)")
def denoised(cloud):
    return S.place_counts(cloud, 5.0, XYZ).where("neighbours >= 2").drop("neighbours")


@R.query("cloud", sql=f"WITH {_PLACES}, {_PAIRS}, k AS (SELECT scene, x_cm, y_cm, z_cm FROM pairs GROUP BY ALL HAVING sum(bn) >= 3) SELECT scene, x_cm, y_cm, z_cm, n FROM places JOIN k USING (scene, x_cm, y_cm, z_cm)")
def outliers_removed(cloud):
    return S.place_counts(cloud, 5.0, XYZ).where("neighbours >= 3").drop("neighbours")


_REF = "SELECT DISTINCT scene, x_cm, y_cm, z_cm FROM {cloud} WHERE l_linenumber = 1"
_HITS = """hits AS (SELECT DISTINCT a.scene, a.x_cm, a.y_cm, a.z_cm FROM (SELECT *, x_cm // 5 + i AS cx, y_cm // 5 + j AS cy FROM places, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)) a
  JOIN ref b ON a.scene = b.scene AND a.cx = b.x_cm // 5 AND a.cy = b.y_cm // 5 WHERE pow(a.x_cm - b.x_cm, 2) + pow(a.y_cm - b.y_cm, 2) + pow(a.z_cm - b.z_cm, 2) <= 25)"""


@R.query("cloud", sql=f"WITH {_PLACES}, ref AS ({_REF}), {_HITS} SELECT scene, x_cm, y_cm, z_cm, n FROM places JOIN hits USING (scene, x_cm, y_cm, z_cm)")
def near_reference(cloud):
    kept = S.near_reference(cloud, cloud.where("l_linenumber = 1"), 5.0, XYZ, [])
    return kept.groupBy("scene", *XYZ).agg(F.count("*").alias("n"))


_CAPPED = f"""ref AS (SELECT scene, x_cm, y_cm, z_cm FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY {sql_seeded(1, 'scene', 'x_cm', 'y_cm', 'z_cm')}, x_cm, y_cm, z_cm) AS k FROM (
  SELECT DISTINCT scene, x_cm, y_cm, z_cm FROM {{cloud}} WHERE l_linenumber = 7)) WHERE k <= 40)"""


@R.query("cloud", sql=f"WITH {_PLACES}, {_CAPPED}, {_HITS} SELECT scene, x_cm, y_cm, z_cm, n FROM places p WHERE NOT EXISTS (SELECT 1 FROM hits q WHERE q.scene = p.scene AND q.x_cm = p.x_cm AND q.y_cm = p.y_cm AND q.z_cm = p.z_cm)")
def away_from_obstacles(cloud):
    """Places away from at most 40 seeded obstacles a scene."""
    kept = S.away_from(cloud, cloud.where("l_linenumber = 7"), 5.0, XYZ, most=40, seed=1)
    return kept.groupBy("scene", *XYZ).agg(F.count("*").alias("n"))


#: Neighbouring cells within 2.5, by offsets.
_NEAR = "near AS (SELECT a.scene, a.gx AS ax, a.gy AS ay, b.gx AS bx, b.gy AS b_y, i * i + j * j AS d2 FROM {cells} a, (SELECT unnest([-2, -1, 0, 1, 2]) AS i), (SELECT unnest([-2, -1, 0, 1, 2]) AS j), {cells} b WHERE i * i + j * j <= 6.25 AND a.scene = b.scene AND b.gx = a.gx + i AND b.gy = a.gy + j)"
_EDGES = _NEAR + ", edges AS (SELECT scene, ax, ay, bx, b_y AS by_, sqrt(d2) AS dist FROM near WHERE ax < bx OR (ax = bx AND ay < b_y))"


@R.query("cells", sql=f"WITH {_EDGES} SELECT scene, ax, ay, bx, by_ AS by, round(dist, 6) AS dist FROM edges")
def radius_edges(cells):
    return S.radius_edges(cells).select("scene", "ax", "ay", "bx", "by", F.round("dist", 6).alias("dist"))


_SAMPLES = """s AS (SELECT *, greatest(1, CAST(ceil(dist * 2) AS INTEGER)) AS n FROM edges),
t AS (SELECT s.*, i, CAST(round(ax + (bx - ax) * i / n::DOUBLE) AS BIGINT) AS gx, CAST(round(ay + (by_ - ay) * i / n::DOUBLE) AS BIGINT) AS gy FROM s, (SELECT unnest(generate_series(0, 5)) AS i) WHERE i <= n),
h AS (SELECT t.*, CASE WHEN c.scene IS NULL THEN 0 ELSE 1 END AS hit FROM t LEFT JOIN {cells} c ON t.scene = c.scene AND t.gx = c.gx AND t.gy = c.gy),
d AS (SELECT *, max(hit) OVER (PARTITION BY scene, ax, ay, bx, by_ ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS wide FROM h),
e AS (SELECT *, min(wide) OVER (PARTITION BY scene, ax, ay, bx, by_ ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS closed FROM d),
sight AS (SELECT scene, ax, ay, bx, by_, any_value(dist) AS dist FROM e GROUP BY scene, ax, ay, bx, by_ HAVING min(closed) = 1)"""


@R.query("cells", sql=f"WITH {_EDGES}, {_SAMPLES} SELECT scene, ax, ay, bx, by_ AS by FROM sight")
def walkable_edges(cells):
    return S.line_of_sight(S.radius_edges(cells), cells, reach=2.5).select("scene", "ax", "ay", "bx", "by")


@R.query("cells", sql="""
WITH q AS (SELECT scene, gx AS qx, gy AS qy FROM {cells}),
p AS (SELECT q.scene, q.qx, q.qy, c.gx, c.gy, pow(q.qx + 0.0 - c.gx, 2) + pow(q.qy + 2 - c.gy, 2) AS d2 FROM q JOIN {cells} c ON q.scene = c.scene WHERE (c.gx + c.gy) % 3 = 0)
SELECT scene, qx, qy, nx, ny FROM (SELECT scene, qx, qy, gx AS nx, gy AS ny, row_number() OVER (PARTITION BY scene, qx, qy ORDER BY d2, gx, gy) AS k FROM p) WHERE k = 1""")
def snap_to_cells(cells):
    q = cells.select("scene", F.col("gx").alias("qx"), F.col("gy").alias("qy"), "gx", (F.col("gy") + 2).alias("gy"))
    nodes = cells.where("(gx + gy) % 3 = 0")
    return S.snap(q, nodes, ["gx", "gy"], 2.0).select("scene", "qx", "qy", F.col("b_gx").alias("nx"), F.col("b_gy").alias("ny"))


@R.query("cloud", sql="""
WITH nodes AS (SELECT DISTINCT scene, x_cm AS x, y_cm AS y, z_cm AS z FROM {cloud}),
q AS (SELECT DISTINCT scene, l_orderkey AS q, x_cm + 2 AS x, y_cm + 1 AS y, 1 AS z FROM {cloud} WHERE l_orderkey % 50 = 0),
p AS (SELECT q.scene, q.q, q.x, q.y, q.z, n.x AS bx, n.y AS b_y, n.z AS bz, pow(q.x - n.x, 2) + pow(q.y - n.y, 2) AS d2 FROM q JOIN nodes n ON q.scene = n.scene),
f AS (SELECT *, min(bz) OVER (PARTITION BY scene, q, x, y) AS low FROM p WHERE d2 <= 25 AND bz >= z - 1 AND bz <= z),
a AS (SELECT *, row_number() OVER (PARTITION BY scene, q, x, y ORDER BY d2, bx, b_y, bz) AS k FROM f WHERE bz <= low),
b AS (SELECT *, row_number() OVER (PARTITION BY scene, q, x, y ORDER BY d2, bx, b_y, bz) AS k FROM p)
SELECT q.scene, q.q, q.x, q.y, coalesce(a.bx, b.bx) AS nx, coalesce(a.b_y, b.b_y) AS ny, coalesce(a.bz, b.bz) AS nz FROM q LEFT JOIN (SELECT * FROM a WHERE k = 1) a ON q.scene = a.scene AND q.q = a.q AND q.x = a.x AND q.y = a.y LEFT JOIN (SELECT * FROM b WHERE k = 1) b ON q.scene = b.scene AND q.q = b.q AND q.x = b.x AND q.y = b.y""")  # fmt: skip
def floor_aware_snap(cloud):
    nodes = _metres(cloud).distinct()
    q = cloud.where("l_orderkey % 50 = 0").select("scene", F.struct("l_orderkey", (F.col("x_cm") + 2).alias("x"), (F.col("y_cm") + 1).alias("y")).alias("q"), (F.col("x_cm") + 2).alias("x"), (F.col("y_cm") + 1).alias("y"), F.lit(1).alias("z")).distinct()
    return S.floor_snap(q, nodes, 5.0, 1.0, 0.0, 0.0).select("scene", F.col("q.l_orderkey").alias("q"), "x", "y", F.col("b_x").alias("nx"), F.col("b_y").alias("ny"), F.col("b_z").alias("nz"))


@R.query("cells", sql="""
WITH p AS (SELECT a.scene, a.gx, a.gy, b.gx AS bx, b.gy AS b_y, i * i + j * j AS d2 FROM {cells} a, (SELECT unnest(generate_series(-4, 4)) AS i), (SELECT unnest(generate_series(-4, 4)) AS j), {cells} b
  WHERE i * i + j * j <= 16 AND a.scene = b.scene AND b.gx = a.gx + i AND b.gy = a.gy + j)
SELECT scene, gx, gy, count(CASE WHEN d2 <= 4 THEN 1 END) AS n_near, count(*) AS n_wide, round(avg(bx) + 1e-9, 6) AS mean_x, round(avg(b_y) + 1e-9, 6) AS mean_y FROM p GROUP BY scene, gx, gy""")
def neighbour_support(cells):
    out = S.neighbour_support(cells, cells, 2.0)
    return out.select("scene", "gx", "gy", "n_near", "n_wide", *_mean("mean_x", "mean_y"))


@R.query("cells", sql="""
WITH h AS (SELECT * FROM {cells} WHERE gx % 20 = 1 AND gy % 20 = 1), c AS (SELECT * FROM {cells}),
d AS (SELECT c.scene, c.gx, c.gy, min(pow(h.gx - c.gx, 2) + pow(h.gy - c.gy, 2))::BIGINT AS d2 FROM c LEFT JOIN h ON c.scene = h.scene GROUP BY ALL)
SELECT scene, gx, gy, d2, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY d2 DESC NULLS LAST, gx, gy) AS k FROM d) WHERE k <= 5""")
def furthest_candidates(cells):
    return S.furthest_candidates(cells, cells.where("gx % 20 = 1 AND gy % 20 = 1"), 5).select("scene", "gx", "gy", "d2", "rank")


@R.query("cells")
def density_clusters(cells):
    return S.dbscan(cells, 1.5, 4, ["gx", "gy"]).select("scene", "gx", "gy", "cluster")


@R.query("cells")
def scene_quality(cells):
    return C.scene_quality(cells, 2.0, ["gx", "gy"], min_points=3, least_area=600.0)


@R.query("cells")
def small_clusters_removed(cells):
    return C.remove_small_clusters(cells, 1.5, 3, ["gx", "gy"], 5).select("scene", "gx", "gy", "cluster")


@R.query("cells")
def despeckled(cells):
    return C.despeckle(cells, 8)


def _planes(cloud):
    pts = cloud.select("scene", F.col("x_cm").cast("double").alias("x"), F.col("y_cm").cast("double").alias("y"), F.col("z_cm").cast("double").alias("z"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "price")
    return pts, C.fit_planes(pts, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "price"], 0.5, tries=20)


@R.query("cloud")
def ground_planes(cloud):
    p = _planes(cloud)[1]
    return p.select("scene", *[F.round(c, 6).alias(c) for c in "abcd"], "inliers")


@R.query("cloud")
def levelled_scenes(cloud):
    pts, planes = _planes(cloud)
    lev = C.level_scene(pts.select("scene", "x", "y", "z"), planes, 0.5)
    return lev.groupBy("scene").agg(F.count("*").alias("n"), F.round(F.min("z"), 4).alias("low"), F.round(F.max("z"), 4).alias("high"))


@R.query("cloud", sql="""
SELECT scene, CASE WHEN abs(h) <= 0.1 THEN 'ground' WHEN h > 0.1 AND h < 1.8 THEN 'obstacle' ELSE 'other' END AS layer, count(*) AS n
FROM (SELECT scene, round(0.6 * (y_cm / 100.0) + 0.8 * z_cm - 1.0, 9) AS h FROM {cloud}) GROUP BY ALL""")
def ground_layers(cloud):
    pts = cloud.select("scene", F.lit(0.0).alias("x"), (F.col("y_cm") / 100.0).alias("y"), F.col("z_cm").cast("double").alias("z"))
    planes = pts.select("scene").distinct().select("scene", F.lit(0.0).alias("a"), F.lit(0.6).alias("b"), F.lit(0.8).alias("c"), F.lit(-1.0).alias("d"))
    return C.classify_ground(pts, planes, 0.1).groupBy("scene", "layer").agg(F.count("*").alias("n"))


_DISK = {r: "(SELECT i, j FROM (SELECT unnest(generate_series(-{0}, {0})) AS i), (SELECT unnest(generate_series(-{0}, {0})) AS j) WHERE i * i + j * j <= {0} * {0})".format(r) for r in (1, 2)}
_KERNEL = len(C.disk(2))


@R.query("cells", sql=f"""
WITH ground AS (SELECT * FROM {{cells}} WHERE (gx * 31 + gy * 17) % 97 <> 6), obst AS (SELECT * FROM {{cells}} WHERE (gx * 31 + gy * 17) % 97 = 6),
wide AS (SELECT DISTINCT scene, gx + i AS gx, gy + j AS gy FROM ground, {_DISK[2]}),
closed AS (SELECT scene, gx - i AS gx, gy - j AS gy FROM wide, {_DISK[2]} GROUP BY scene, gx - i, gy - j HAVING count(*) = {_KERNEL}),
grown AS (SELECT DISTINCT scene, gx + i AS gx, gy + j AS gy FROM obst, {_DISK[1]})
SELECT scene, gx, gy FROM closed EXCEPT SELECT scene, gx, gy FROM ground EXCEPT SELECT scene, gx, gy FROM grown""")
def walkable_fill(cells):
    return C.walkable_fill(cells.where("(gx * 31 + gy * 17) % 97 <> 6"), cells.where("(gx * 31 + gy * 17) % 97 = 6"), 2, 1)


@R.query("cloud", sql="SELECT scene, x_cm, y_cm, z_cm, count(*) AS n FROM (SELECT * FROM {cloud} WHERE l_linenumber <= 3 UNION ALL SELECT * FROM {cloud} WHERE l_linenumber > 3) GROUP BY ALL")
def union_points(cloud):
    return cloud.where("l_linenumber <= 3").unionByName(cloud.where("l_linenumber > 3")).groupBy("scene", *XYZ).agg(F.count("*").alias("n"))


@R.query("cells", sql="SELECT DISTINCT scene, gx // 10 AS bx, gy // 10 AS by FROM {cells}")
def distinct_blocks(cells):
    return cells.select("scene", F.floor(F.col("gx") / 10).alias("bx"), F.floor(F.col("gy") / 10).alias("by")).distinct()


@R.query("cells", sql="SELECT scene, gx, gy FROM {cells} EXCEPT SELECT scene, gx, gy FROM {cells} WHERE (gx + gy) % 3 = 0")
def cell_difference(cells):
    return cells.join(cells.where("(gx + gy) % 3 = 0"), ["scene", "gx", "gy"], "left_anti")


@R.query("cells", sql="SELECT scene, gx, gy FROM {cells} WHERE gx % 2 = 0 INTERSECT SELECT scene, gx, gy FROM {cells} WHERE gy % 3 = 0")
def cell_intersection(cells):
    return cells.where("gx % 2 = 0").intersect(cells.where("gy % 3 = 0"))


@R.query("cells", sql="SELECT scene, gx, gy, h * 30 AS heading, CASE WHEN h = 11 THEN 0 ELSE h + 1 END AS next_view FROM {cells}, (SELECT unnest(generate_series(0, 11)) AS h)")
def view_fanout(cells):
    h = F.explode(F.sequence(F.lit(0), F.lit(11))).alias("h")
    return cells.select("scene", "gx", "gy", h).select("scene", "gx", "gy", (F.col("h") * 30).alias("heading"), ((F.col("h") + 1) % 12).alias("next_view"))


QUERIES, SQL = R.queries, R.sql
