"""Results that must be whole: clusters in metres, far nodes, far floors, long paths, short windows."""

import random

import pandas as pd
from pyspark.sql import functions as F

from posegrid.functions import text as X
from posegrid.operators import detections, graphs, spatial
from posegrid.plans import graphs as plans
from posegrid.streaming import jobs


def _clusters(points, eps, least):
    near = lambda a, b: (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 <= eps * eps
    core = [p for p in points if sum(near(p, q) for q in points) >= least]
    part = {p: p for p in core}

    def find(p):
        while part[p] != p:
            p = part[p]
        return p

    for p in core:
        for q in core:
            if near(p, q):
                a, b = sorted((find(p), find(q)))
                part[b] = a
    out = {}
    for p in points:
        reach = [find(q) for q in core if near(p, q)]
        out[p] = find(p) if p in part else min(reach) if reach else None
    return out


def test_dbscan_in_metres(spark):
    rng = random.Random(1)
    points = list({(round(rng.uniform(0, 1.2), 3), round(rng.uniform(-0.6, 0.6), 3)) for _ in range(150)} | {(0.1, 0.1), (0.12, 0.1), (0.9, 0.9), (0.92, 0.9)})
    df = spark.createDataFrame([("s", x, y) for x, y in points], "scene string, x double, y double")
    got = {(r.x, r.y): r.cluster for r in spatial.dbscan(df, 0.06, 2, ["x", "y"]).collect()}
    want = {p: c and f"s|{c[0]}|{c[1]}" for p, c in _clusters(points, 0.06, 2).items()}
    assert got == want and got[(0.1, 0.1)] != got[(0.9, 0.9)]


def test_snap_finds_nodes_at_any_distance(spark):
    q = spark.createDataFrame([("s", 0.0, 0.0), ("s", 5000.0, 1.0), ("empty", 0.0, 0.0), ("s", None, 1.0)], "scene string, x double, y double")
    n = spark.createDataFrame([("s", 100.0, 0.0, 7), ("s", 0.0, 100.0, 8), ("other", 0.0, 0.0, 9)], "scene string, x double, y double, k int")
    got = {(r.scene, r.x): (r.b_x, r.b_y, r.b_k) for r in spatial.snap(q, n, ["x", "y"], 2.0).collect()}
    assert got == {("s", 0.0): (0.0, 100.0, 8), ("s", 5000.0): (100.0, 0.0, 7), ("empty", 0.0): (None,) * 3, ("s", None): (None,) * 3}


def test_floor_snap_falls_back_at_any_distance(spark):
    q = spark.createDataFrame([("s", 1, 0.0, 0.0, 1.0), ("s", 2, 50.0, 0.0, 1.0), ("t", 3, 0.0, 0.0, 0.0)], "scene string, q int, x double, y double, z double")
    n = spark.createDataFrame([("s", 0.5, 0.0, 0.0), ("s", 0.2, 0.0, 5.0), ("s", 9.0, 0.0, -3.0)], "scene string, x double, y double, z double")
    got = {r.q: (r.b_x, r.b_z) for r in spatial.floor_snap(q, n).collect()}
    assert got == {1: (0.5, 0.0), 2: (9.0, -3.0), 3: (None, None)}


def test_trace_paths_of_more_than_2000_steps(spark):
    n = 2500
    place = "struct<gx:long,gy:long>"
    rows = [("s", (0, 0), (i, 0), (i - 1, 0) if i else None) for i in range(n)]
    tree = spark.createDataFrame(rows, f"scene string, source {place}, node {place}, via {place}")
    goals = spark.createDataFrame([("s", (0, 0), (n - 1, 0)), ("s", (0, 0), (3, 0)), ("s", (0, 0), (n, 0))], f"scene string, source {place}, goal {place}")
    got = graphs.trace_paths(tree, goals).collect()
    long = sorted((r.i, r.node.gx) for r in got if r.goal.gx == n - 1)
    assert long == [(i, n - 1 - i) for i in range(n)]
    assert sorted((r.i, r.node.gx) for r in got if r.goal.gx == 3) == [(0, 3), (1, 2), (2, 1), (3, 0)] and len(got) == n + 4


def test_detections_against_a_plain_version(spark):
    rng = random.Random(4)
    pixels = {(i, u, v): round(rng.choice([0.0, 0.05, rng.uniform(0.2, 15)]), 3) for i in range(3) for u in range(16) for v in range(12) if rng.random() < 0.8}
    boxes = [(rng.randrange(3), rng.uniform(-3, 10), rng.uniform(-3, 8), rng.uniform(4, 20), rng.uniform(3, 14), rng.choice([0.05, 0.5]), k) for k in range(80)]
    boxes += [boxes[0], (7, 0.0, 0.0, 9.0, 9.0, 0.9, 99)]
    found = detections.filter_detections(spark.createDataFrame(boxes, "image int, x1 double, y1 double, x2 double, y2 double, score double, k int"), spark.createDataFrame([(*p, d) for p, d in pixels.items()], "image int, u int, v int, depth double"), area=20)
    want = []
    for i, x1, y1, x2, y2, score, k in boxes:
        a, b, c, d = map(int, (x1, y1, x2, y2))
        u, v = int((a + c) / 2), int((b + d) / 2)
        z = sorted(pixels[i, p, q] for p in range(u - 2, u + 3) for q in range(v - 2, v + 3) if pixels.get((i, p, q), 0) > 0.1)
        if score >= 0.08 and (c - a) * (d - b) >= 20 and z:
            depth = (z[(len(z) - 1) // 2] + z[len(z) // 2]) / 2
            if depth <= 12:
                want.append((k, u, v, round(depth, 9)))
    assert sorted((r.k, r.u, r.v, round(r.depth, 9)) for r in found.collect()) == sorted(want) and want
    pose = [0.0, -1.0, 0.0, 5.0, 1.0, 0.0, 0.0, 6.0, 0.0, 0.0, 1.0, 7.0, 0.0, 0.0, 0.0, 1.0]
    cameras = spark.createDataFrame([(i, 10.0, 20.0, 8.0, 6.0, pose) for i in range(2)], "image int, fx double, fy double, cx double, cy double, m array<double>")
    for r in detections.lift_detections(found, cameras).collect():
        x, y = (r.u - 8) * r.depth / 10, (r.v - 6) * r.depth / 20
        assert r.image < 2 and abs(r.x - (5 - y)) < 1e-9 and abs(r.y - (6 + x)) < 1e-9 and abs(r.z - (7 + r.depth)) < 1e-9


def test_class_groups(spark):
    rows = spark.createDataFrame([("mug",), ("sofa",), (None,)], "c string").select(X.class_group(F.col("c")).alias("g")).collect()
    assert [r.g for r in rows] == ["manipulation", "other", None]


def test_objects_at_the_end_of_long_detours_are_reachable(spark):
    """5.83 cells away and 8.47 along the path, of at most 1.5 * 5.83."""
    cells = spark.createDataFrame([(1, x, y) for x, y in ((0, 0), (0, 2), (1, 4), (3, 4), (5, 3))], "scene long, gx long, gy long")
    got = {r.obj: r.dist for r in plans.reachable_objects(cells).collect()}
    assert got == {2: 2.0, 104: 4.236068, 304: 6.236068, 503: 8.472136}
