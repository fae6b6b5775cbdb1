"""Queries of projections, poses, masks and boxes (views pixels, poses, cloud, seg, objects, boxes, steps)."""

from __future__ import annotations

from pyspark.sql import functions as F

from posegrid.functions import geometry as G
from posegrid.operators import detections as D
from posegrid.plans.register import Registry

R = Registry()
XYZ = ("px", "py", "pz")


def _cols(v, names=XYZ, places=5):
    return [F.round(c + F.lit(1e-9), places).alias(n) for n, c in zip(names, v)]


def _sql(*exprs, names=XYZ, places=5):
    return ", ".join(f"round({e} + 1e-9, {places}) AS {n}" for n, e in zip(names, exprs))


def _uv():
    return F.col("u"), F.col("v"), F.col("gt")


@R.query("pixels", sql=f"SELECT image, u, v, {_sql('((u - 15.5) * gt / 20.0) * 0.6 - ((v - 11.5) * gt / 18.0) * 0.8 + 1.0', '((u - 15.5) * gt / 20.0) * 0.8 + ((v - 11.5) * gt / 18.0) * 0.6 + 2.0', 'gt + 0.5')} FROM {{pixels}}")
def backproject_pinhole(pixels):
    p = G.pinhole(*_uv(), 20.0, 18.0, 15.5, 11.5)
    r = [F.lit(x) for x in (0.6, -0.8, 0.0, 0.8, 0.6, 0.0, 0.0, 0.0, 1.0)]
    return pixels.select("image", "u", "v", *_cols(G.rotate_translate(p, r, (F.lit(1.0), F.lit(2.0), F.lit(0.5)))))


_LON, _LAT = "(u / 32 * (2 * pi()) - pi())", "(pi() / 2 - v / 24 * pi())"
_PHI = "(v / 24 * pi())"


@R.query("pixels", sql=f"SELECT image, u, v, {_sql(f'gt * cos{_LAT} * sin{_LON}', f'gt * cos{_LAT} * cos{_LON}', f'gt * sin{_LAT}')} FROM {{pixels}}")
def equirect_lonlat(pixels):
    return pixels.select("image", "u", "v", *_cols(G.equirect(*_uv(), 32, 24)))


@R.query("pixels", sql=f"SELECT image, u, v, {_sql(f'gt * sin{_PHI} * sin({_LON} + 0.25)', f'gt * cos{_PHI}', f'-gt * sin{_PHI} * cos({_LON} + 0.25)')} FROM {{pixels}}")
def equirect_thetaphi(pixels):
    return pixels.select("image", "u", "v", *_cols(G.equirect(*_uv(), 32, 24, "thetaphi", 0.25)))


@R.query("pixels", sql=f"SELECT image, u, v, {_sql(f'gt * cos{_LAT} * sin{_LON}', f'gt * cos{_LAT} * cos{_LON}', f'gt * sin{_LAT}')} FROM {{pixels}}")
def equirect_yawpitch(pixels):
    p = G.equirect(*_uv(), 32, 24, "yawpitch")
    return pixels.select("image", "u", "v", *_cols(G.z_up(*p, source="pano")))


@R.query("pixels", sql="SELECT image, count(CASE WHEN gt > 0.01 AND gt < 10 THEN 1 END) AS pinhole, count(CASE WHEN gt > 0.1 AND gt < 3 THEN 1 END) AS ordinal, count(CASE WHEN gt > 0.1 AND gt < 5 THEN 1 END) AS filled FROM {pixels} GROUP BY image")
def depth_filter(pixels):
    n = lambda c: F.count(F.when(c, 1))
    d = F.col("gt")
    return pixels.groupBy("image").agg(n(G.depth_valid("pinhole", d)).alias("pinhole"), n(G.depth_valid("ordinal", d)).alias("ordinal"), n(G.depth_valid("rooms", d, 5.0)).alias("filled"))


@R.query("pixels", sql="SELECT image, u, v FROM {pixels} WHERE abs(90.0 - (v + 0.5) * (180.0 / 24)) <= 60 AND gt >= 0.4 AND gt < 10 AND u % 4 <> 0")
def panorama_mask(pixels):
    return pixels.where(G.panorama_mask(F.col("v"), F.col("gt"), 24) & (F.col("u") % 4 != 0)).select("image", "u", "v")


@R.query("pixels", sql="SELECT image, u, v FROM {pixels} WHERE abs(90.0 - (v + 0.5) * (180.0 / 24)) <= 60 AND gt >= 0.4 AND gt < 10 AND r >= 0.5")
def panorama_mask_external(pixels):
    mask = F.when(F.col("r") >= 0.5, 255).otherwise(0)
    return pixels.where(G.panorama_mask(F.col("v"), F.col("gt"), 24, external=mask)).select("image", "u", "v")


@R.query("pixels", sql="SELECT image, u, v FROM {pixels} WHERE v >= 24 * 145 // 1024 AND v < 24 - 24 * 149 // 1024")
def strip_mask(pixels):
    return pixels.where(G.strip_mask(F.col("v"), 24, 145, 149, 1024)).select("image", "u", "v")


@R.query("pixels", sql="SELECT image, u, v FROM {pixels} WHERE round(abs(r - 1.0) + abs(g - 0.5) + abs(b - 0.2), 6) < 0.4")
def colour_match(pixels):
    d = sum((F.abs(F.col(c) - t) for c, t in (("g", 0.5), ("b", 0.2))), F.abs(F.col("r") - 1.0))
    return pixels.where(F.round(d, 6) < 0.4).select("image", "u", "v")


@R.query("pixels", sql="SELECT image, u, v, round(CASE image % 4 WHEN 0 THEN gt WHEN 1 THEN gt / 1000.0 WHEN 2 THEN gt / 5000.0 ELSE 0.0 END + 1e-11, 9) AS metres FROM {pixels}")
def depth_units(pixels):
    k = F.when(F.col("image") % 4 == 0, "metres").when(F.col("image") % 4 == 1, "millimetres").when(F.col("image") % 4 == 2, "scaled").otherwise("none")
    return pixels.select("image", "u", "v", F.round(G.depth_metres(k, F.col("gt"), F.lit(5000.0)) + 1e-11, 9).alias("metres"))


@R.query("pixels", sql="""
WITH a AS (SELECT *, (u + 0.5) / 32 * 2.0 - 1.0 AS x, (v + 0.5) / 24 * 2.0 - 1.0 AS y FROM {pixels})
SELECT image, u, v, CAST(least(65535, greatest(0, floor(gt / (greatest(abs(x), abs(y), 1.0) / sqrt(x * x + y * y + 1.0)) * 1000.0))) AS INTEGER) AS mm FROM a""")
def zdepth_to_euclid(pixels):
    return pixels.select("image", "u", "v", G.zdepth_to_euclid(F.col("gt"), F.col("u"), F.col("v"), 32, 24).alias("mm"))


def _q():
    return F.lit(0.0), F.lit(0.0), F.sin(F.col("yaw") / 2), F.cos(F.col("yaw") / 2)


def _t():
    return F.col("tx"), F.col("ty"), F.col("tz")


@R.query("poses", sql="SELECT id, round(1 - 2 * pow(sin(yaw / 2), 2), 6) + 0.0 AS m00, round(-2 * sin(yaw / 2) * cos(yaw / 2), 6) + 0.0 AS m01, round(2 * sin(yaw / 2) * cos(yaw / 2), 6) + 0.0 AS m10, ty AS m13 FROM {poses}")
def pose_matrix(poses):
    m = G.pose_matrix(_q(), _t())
    return poses.select("id", m.alias("m")).select("id", *[(F.round(F.col("m")[i], 6) + 0.0).alias(n) for i, n in ((0, "m00"), (1, "m01"), (4, "m10"))], F.col("m")[7].alias("m13"))


@R.query("poses", sql="SELECT id, round(cos(0.2) * cos(yaw / 2) - sin(0.2) * sin(yaw / 2), 6) AS qw, round(cos(0.2) * sin(yaw / 2) + sin(0.2) * cos(yaw / 2), 6) AS qz FROM {poses}")
def rotate_quaternions(poses):
    import math

    z = F.lit(0.0)
    q = G.unit_quat(G.hamilton((_q()[3], z, z, _q()[2]), (F.lit(math.cos(0.2)), z, z, F.lit(math.sin(0.2)))))
    return poses.select("id", F.round(q[0], 6).alias("qw"), F.round(q[3], 6).alias("qz"))


@R.query("poses", sql="SELECT id, round(cos(yaw) * -tx + sin(yaw) * -ty + 1e-9, 5) AS px, round(-sin(yaw) * -tx + cos(yaw) * -ty + 1e-9, 5) AS py, round(-tz + 1e-9, 5) AS pz FROM {poses}")
def invert_pose(poses):
    _, t = G.invert_pose(G.quat_rotation(*_q()), _t())
    return poses.select("id", *_cols(t))


@R.query("poses", sql="SELECT id, round(cos(yaw) * 1.5 - sin(yaw) * 0.5 + tx + 1e-9, 5) AS px, round(sin(yaw) * 1.5 + cos(yaw) * 0.5 + ty + 1e-9, 5) AS py, round(tz + 1 + 1e-9, 5) AS pz FROM {poses}")
def transform_points(poses):
    return poses.select("id", *_cols(G.rotate_translate((F.lit(1.5), F.lit(0.5), F.lit(1.0)), G.quat_rotation(*_q()), _t())))


@R.query("cloud", sql="SELECT l_orderkey, l_linenumber, x_cm AS x, -z_cm AS y, y_cm AS z FROM {cloud}")
def to_z_up(cloud):
    x, y, z = G.z_up(F.col("x_cm"), F.col("y_cm"), F.col("z_cm"))
    return cloud.select("l_orderkey", "l_linenumber", x.alias("x"), y.alias("y"), z.alias("z"))


_MOD = "((({0}) % (2 * pi())) + 2 * pi()) % (2 * pi())"
# a tilted camera: its quaternion is (0.6 cos yaw, 0.6 sin yaw, 0.48, 0.64)
_AXIS = ("(2 * (0.6 * cos(yaw) * 0.48 + 0.6 * sin(yaw) * 0.64))", "(2 * (0.6 * sin(yaw) * 0.48 - 0.6 * cos(yaw) * 0.64))", "(1 - 2 * (0.36 * cos(yaw) * cos(yaw) + 0.36 * sin(yaw) * sin(yaw)))")


@R.query("poses", sql=f"""
SELECT id, round(CASE WHEN frame IN ('matterport', 'gibson') THEN pi() / 2 - atan2(-{_AXIS[1]}, -{_AXIS[0]}) WHEN frame = 'realsee' THEN pi() / 2 - atan2({_AXIS[2]}, {_AXIS[0]}) WHEN frame = 'structured3d_perspective' THEN atan2(-{_AXIS[1]}, -{_AXIS[0]}) ELSE 0.0 END + 1e-9, 6) AS heading,
  tx AS x, CASE WHEN frame = 'realsee' THEN tz ELSE ty END AS y, CASE WHEN frame = 'realsee' THEN -ty ELSE tz END AS z FROM {{poses}}""")
def pose_headings(poses):
    r = G.quat_rotation(0.6 * F.cos("yaw"), 0.6 * F.sin("yaw"), F.lit(0.48), F.lit(0.64))
    at = G.pose_position(F.col("frame"), (F.col("tx"), F.col("ty"), F.col("tz")))
    return poses.select("id", F.round(G.pose_heading(F.col("frame"), r) + 1e-9, 6).alias("heading"), *[c.alias(k) for k, c in zip("xyz", at)])


@R.query("poses", sql="""
SELECT id, round(((yaw * 3 + 0.1 + pi()) % (2 * pi()) + 2 * pi()) % (2 * pi()) - pi() + 1e-9, 6) AS wrapped, round(((pi() / 2 - atan2(ty, tx + 0.5)) % (2 * pi()) + 2 * pi()) % (2 * pi()) + 1e-9, 6) AS heading,
  round(cos(yaw) * tx - sin(yaw) * ty + 1e-9, 6) AS x, round(sin(yaw) * tx + cos(yaw) * ty + 1e-9, 6) AS y, round(atan2(sin(yaw), cos(yaw)) + 1e-9, 6) AS turned FROM {poses}""")
def sql_helpers(poses):
    spark = poses.sparkSession
    G.register_helpers(spark)
    rotated = "quat_rotate(0, 0, sin(yaw / 2), cos(yaw / 2), array(tx, ty, tz))"
    return spark.sql(f"""SELECT id, round(wrap_angle(yaw * 3 + 0.1) + 1e-9, 6) AS wrapped, round(heading_of(tx + 0.5, ty) + 1e-9, 6) AS heading, round({rotated}[0] + 1e-9, 6) AS x, round({rotated}[1] + 1e-9, 6) AS y,
      round(quat_yaw(0, 0, sin(yaw / 2), cos(yaw / 2)) + 1e-9, 6) AS turned FROM {{poses}}""", poses=poses)


_PREV = "(SELECT episode, step, x - lag(x) OVER (PARTITION BY episode ORDER BY step) AS dx, y - lag(y) OVER (PARTITION BY episode ORDER BY step) AS dy, tick, lag(tick) OVER (PARTITION BY episode ORDER BY step) AS t0 FROM {steps})"


@R.query("steps", sql=f"SELECT episode, step, round({_MOD.format('pi() / 2 - atan2(dy, dx)')}, 5) AS heading FROM {_PREV} WHERE dx * dx + dy * dy > 0.01")
def step_headings(steps):
    from posegrid.operators.trajectories import in_order

    d = steps.select("episode", "step", (F.col("x") - F.lag("x").over(in_order())).alias("dx"), (F.col("y") - F.lag("y").over(in_order())).alias("dy")).where("dx * dx + dy * dy > 0.01")
    return d.select("episode", "step", F.round(G.heading_of(F.col("dx"), F.col("dy")), 5).alias("heading"))


@R.query("steps", sql=f"SELECT episode, step, round((((tick - t0) * pi() / 12 + pi()) % (2 * pi()) + 2 * pi()) % (2 * pi()) - pi(), 4) AS turn FROM {_PREV} WHERE t0 IS NOT NULL AND abs(tick - t0) <> 12")
def turn_angles(steps):
    import math

    from posegrid.operators.trajectories import in_order

    d = steps.withColumn("t0", F.lag("tick").over(in_order())).where("t0 IS NOT NULL AND abs(tick - t0) <> 12")
    return d.select("episode", "step", F.round(G.wrap_angle((F.col("tick") - F.col("t0")) * (math.pi / 12)), 4).alias("turn"))


@R.query("seg", sql="SELECT image, count(*) AS n, count(CASE WHEN label = 255 THEN 1 END) AS ignored, sum(CASE WHEN label = 255 OR label = 0 THEN 255 ELSE label - 1 END)::BIGINT AS total FROM {seg} GROUP BY image")
def reduced_labels(seg):
    return seg.groupBy("image").agg(F.count("*").alias("n"), F.count(F.when(F.col("label") == 255, 1)).alias("ignored"), F.sum(G.reduce_zero_label(F.col("label"))).alias("total"))


@R.query("pixels", sql="SELECT image, u, v, (u + v) % 16 IN (3, 9, 11, 12, 13, 29, 94) AND gt > 0.2 AND gt < 10.0 AS walkable, (u + v) % 16 = 14 AND gt > 0.2 AND gt < 10.0 AS door FROM {pixels}")
def class_mask(pixels):
    cls = (F.col("u") + F.col("v")) % 16
    return pixels.select("image", "u", "v", G.class_mask(cls, F.col("gt")).alias("walkable"), G.class_mask(cls, F.col("gt"), G.DOOR_IDS).alias("door"))


_DETECTED = """b AS (SELECT cy AS image, (cx % 32 - 3)::INTEGER AS x1, (3 * l_linenumber - 2)::INTEGER AS y1, (cx % 32 + w / 4)::DOUBLE AS x2, (3 * l_linenumber + h)::DOUBLE AS y2, score, l_partkey, price FROM {boxes}),
big AS (SELECT *, trunc((x1 + trunc(x2)) / 2)::INTEGER AS u, trunc((y1 + trunc(y2)) / 2)::INTEGER AS v FROM b WHERE score >= 0.08 AND (trunc(x2) - x1) * (trunc(y2) - y1) >= 60),
patch AS (SELECT k.image, k.u, k.v, median(p.gt) AS depth FROM (SELECT DISTINCT image, u, v FROM big) k JOIN {pixels} p ON p.image = k.image AND p.u BETWEEN k.u - 2 AND k.u + 2 AND p.v BETWEEN k.v - 2 AND k.v + 2 WHERE p.gt > 0.1 GROUP BY ALL HAVING median(p.gt) <= 6),
found AS (SELECT big.*, depth FROM big JOIN patch USING (image, u, v))"""


def _detected(boxes, pixels):
    corners = boxes.select(F.col("cy").alias("image"), (F.col("cx") % 32 - 3).alias("x1"), (3 * F.col("l_linenumber") - 2).alias("y1"), (F.col("cx") % 32 + F.col("w") / 4).alias("x2"), (3 * F.col("l_linenumber") + F.col("h")).cast("double").alias("y2"), "score", "l_partkey", "price")
    return D.filter_detections(corners, pixels.select("image", "u", "v", F.col("gt").alias("depth")), area=60, far=6.0)


@R.query("boxes", "pixels", sql=f"WITH {_DETECTED} SELECT image, l_partkey, price, u, v, round(depth + 1e-9, 5) AS depth FROM found")
def filter_detections(boxes, pixels):
    return _detected(boxes, pixels).select("image", "l_partkey", "price", "u", "v", F.round(F.col("depth") + 1e-9, 5).alias("depth"))


@R.query("boxes", "pixels", sql=f"""WITH {_DETECTED}
SELECT image, l_partkey, price, round((u - 15.5) * depth / 20.0 + image + 1e-9, 4) AS x, round(depth + 0.5 + 1e-9, 4) AS y, round(-(v - 11.5) * depth / 18.0 + 1.0 + 1e-9, 4) AS z FROM found""")
def lift_detections(boxes, pixels):
    m = [F.lit(x) for x in (1.0, 0.0, 0.0)] + [F.col("image").cast("double")] + [F.lit(x) for x in (0.0, 0.0, 1.0, 0.5, 0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)]
    cameras = pixels.select("image").distinct().select("image", F.lit(20.0).alias("fx"), F.lit(18.0).alias("fy"), F.lit(15.5).alias("cx"), F.lit(11.5).alias("cy"), F.array(*m).alias("m"))
    return D.lift_detections(_detected(boxes, pixels), cameras).select("image", "l_partkey", "price", *[F.round(F.col(c) + 1e-9, 4).alias(c) for c in "xyz"])


_B = ("x0", "y0", "x1", "y1")
_KEY = ("image", "cx", "cy", "w", "h")


@R.query("boxes", sql="SELECT image, cx, cy, w, h, cx - w / 2.0 AS x0, cy - h / 2.0 AS y0, cx + w / 2.0 AS x1, cy + h / 2.0 AS y1 FROM {boxes}")
def box_corners(boxes):
    c = G.box_corners(*[F.col(k) for k in _KEY[1:]])
    return boxes.select(*_KEY, *[x.cast("double").alias(n) for n, x in zip(_B, c)])


@R.query("boxes", sql="SELECT image, CAST(cx AS DOUBLE) AS bx, CAST(cy AS DOUBLE) AS by_, CAST(w AS DOUBLE) AS bw, CAST(h AS DOUBLE) AS bh FROM {boxes}")
def box_centres(boxes):
    back = G.box_centre(*G.box_corners(*[F.col(k) for k in _KEY[1:]]))
    return boxes.select("image", *[x.cast("double").alias(n) for n, x in zip(("bx", "by_", "bw", "bh"), back)])


@R.query("boxes", sql="SELECT image, cx, cy, w, h, " + ", ".join(f"greatest(0.0, least({t}.0, ({e}) * {s}))::DOUBLE AS {n}" for n, e, t, s in (("x0", "cx - w / 2.0", 80, 1.5), ("y0", "cy - h / 2.0", 60, 2.0), ("x1", "cx + w / 2.0", 80, 1.5), ("y1", "cy + h / 2.0", 60, 2.0))) + " FROM {boxes}")
def scaled_boxes(boxes):
    c = G.scale_box(G.box_corners(*[F.col(k) for k in _KEY[1:]]), 1.5, 2.0, 80, 60)
    return boxes.select(*_KEY, *[x.cast("double").alias(n) for n, x in zip(_B, c)])


@R.query("steps", sql="SELECT episode, string_agg(CASE action WHEN 0 THEN 'STOP' WHEN 1 THEN '↑' WHEN 2 THEN '←' WHEN 3 THEN '→' END, '' ORDER BY step) AS arrows FROM {steps} GROUP BY episode")
def action_arrows(steps):
    name = F.when(F.col("action") == 1, "MOVE_FORWARD").when(F.col("action") == 2, "TURN_LEFT").when(F.col("action") == 3, "TURN_RIGHT").otherwise("unknown")
    a = steps.select("episode", F.struct("step", G.action_arrow(G.encode_action(name)).alias("a")).alias("s"))
    return a.groupBy("episode").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s.a), "").alias("arrows"))


QUERIES, SQL = R.queries, R.sql
