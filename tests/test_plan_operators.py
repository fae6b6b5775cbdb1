"""Drawn tasks and their plans, manifests, regression sweeps, and other operators against plain versions."""

import heapq

import numpy as np
from pyspark.sql import functions as F

from posegrid.functions import geometry as geo
from posegrid.functions.text import marked_spans
from posegrid.operators import graphs as G
from posegrid.operators import metrics as M
from posegrid.operators import vectors as V
from posegrid.operators.sampling import BUCKETS, STYLE_SCALES
from posegrid.sources import manifests as S


def _scene(spark, n):
    cells = spark.range(n * n).selectExpr("0 AS scene", "id % {0} AS gx".format(n), "id div {0} AS gy".format(n))
    right = cells.where(f"gx < {n - 1}").selectExpr("scene", "struct(gx, gy) AS src", "struct(gx + 1 AS gx, gy) AS dst", "1.0D AS w")
    up = cells.where(f"gy < {n - 1}").selectExpr("scene", "struct(gx, gy) AS src", "struct(gx, gy + 1 AS gy) AS dst", "1.0D AS w")
    one = right.unionByName(up)
    return cells, one.unionByName(one.selectExpr("scene", "dst AS src", "src AS dst", "w"))


def _dijkstra(n, start):
    best, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        d, (x, y) = heapq.heappop(heap)
        for a, b in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
            if 0 <= a < n and 0 <= b < n and d + 1 < best.get((a, b), 1e9):
                best[a, b] = d + 1
                heapq.heappush(heap, (d + 1, (a, b)))
    return best


def test_tasks_lie_in_their_buckets_and_plans_follow_edges(spark):
    n = 9
    cells, arcs = _scene(spark, n)
    tasks = G.draw_tasks(cells, arcs, 2, 3)
    rows = {r["round"]: r for r in tasks.collect()}
    assert set(rows) == {0, 1}
    for r in rows.values():
        scale = STYLE_SCALES[r["style"]]
        assert (r["low"], r["high"]) in [(a * scale, b * scale) for a, b, _ in BUCKETS]
        assert r["low"] <= r["dist"] <= r["high"]
        assert _dijkstra(n, tuple(r["start"]))[tuple(r["goal"])] == r["dist"]
    things = spark.createDataFrame([(0, 10 * x + y, f"c{(x + y) % 3}", x, y) for x in range(n) for y in range(n)], "scene int, obj long, cls string, gx long, gy long")
    for p in G.episode_plan(tasks, cells, arcs, things, 5).collect():
        path = [tuple(q) for q in p["path"]]
        assert path[0] == tuple(p["start"]) and path[-1] == tuple(p["goal"]) and len(path) == p["dist"] + 1
        assert all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(path, path[1:]))
        assert p["target"] in {"c0", "c1", "c2"} and p["phrase"] and p["episode_id"].startswith("scene-0_")


def test_tasks_without_a_goal_in_the_bucket_fall_back(spark):
    cells, arcs = _scene(spark, 2)
    got = G.draw_tasks(cells, arcs, 1, 3, trials=1).collect()
    # the longest way is 2; halved buckets of 1.5 to 3 fit it, others fall back to 1.5 or more
    assert [r["dist"] for r in got] == [2.0]
    assert G.draw_tasks(cells.limit(0), arcs, 1, 3, trials=1).count() == 0


def test_limits_of_geodesics_by_source(spark):
    cells, arcs = _scene(spark, 6)
    sources = cells.where("(gx = 0 AND gy = 0) OR (gx = 5 AND gy = 5)").selectExpr("scene", "struct(gx, gy) AS source", "CASE WHEN gx = 0 THEN 2.0D ELSE 4.0D END AS reach")
    far = {tuple(r["source"]): r["m"] for r in G.geodesic(arcs, sources, "reach").groupBy("source").agg(F.max("dist").alias("m")).collect()}
    assert far == {(0, 0): 2.0, (5, 5): 4.0}


def test_sequence_and_triplet_manifests(spark):
    paths = ["a/s/color/1.jpg", "a/s/depth/1.png", "a/s/pose/1.txt", "a/s/color/2.jpg", "a/s/depth/2.png", "a/s/color/3.png", "a/s/depth/3.png", "a/s/pose/3.txt", None]
    got = S.sequence_manifest(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    assert [tuple(r) for r in got] == [("a/s", "1", "a/s/color/1.jpg", "a/s/depth/1.png", "a/s/pose/1.txt")]
    paths = [f"b/sequence/f.{i}{e}" for i in (1, 2) for e in (".color.jpg", ".depth.pgm", ".pose.txt")][:-1]
    got = S.triplet_manifest(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    assert [tuple(r) for r in got] == [("b/sequence", "f.1", *paths[:3])]


def test_regression_sweep_and_refit(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=3) + 4 * np.eye(3)[i % 3]], i % 3) for i in range(120)]
    d = spark.createDataFrame(rows, "vec_id int, embedding array<float>, label int")
    train, val, test = (d.where(c) for c in ("vec_id % 4 > 1", "vec_id % 4 = 1", "vec_id % 4 = 0"))
    sweep = V.logreg_sweep(train, val, [1e-6, 1.0])
    got = sweep.orderBy("c").collect()
    assert [r["c"] for r in got] == [1e-6, 1.0] and got[1]["accuracy"] >= 0.9
    most = max(r["accuracy"] for r in got)
    assert [r["best"] for r in got].index(True) == [r["accuracy"] for r in got].index(most) and sum(r["best"] for r in got) == 1
    out = V.logreg_refit(train, val, test, sweep).collect()
    assert len(out) == 30 and sum(r["predicted"] == r["label"] for r in out) >= 27
    assert len(V.POWERS) == 45 and V.POWERS[0] == -6 and V.POWERS[-1] == 5


def test_multilabel_f1_counts_absent_classes_as_0(spark):
    rows = [(0, 0, 0.9, [0]), (0, 1, 0.2, [0]), (0, 2, 0.1, [0]), (1, 0, 0.8, [1]), (1, 1, 0.7, [1]), (1, 2, 0.5, [1])]
    d = spark.createDataFrame(rows, "q int, cls int, score double, labels array<int>")
    assert abs(M.f1_multilabel(d).first()["f1"] - (2 / 3 + 1 + 0) / 3) < 1e-9
    assert abs(M.f1_multilabel(d, "micro").first()["f1"] - 4 / 5) < 1e-9


def test_headings_by_frame_kind(spark):
    turn = [[0.0, 0.0, -1.0], [1.0, 0.0, 0.0], [0.0, -1.0, 0.0]]  # plus z of the camera is minus x of the world
    r = [F.lit(x) for row in turn for x in row]
    kinds = spark.createDataFrame([("hm3d",), ("realsee",), ("structured3d_panorama",), ("other",), (None,)], "kind string")
    got = [round(x[0], 6) for x in kinds.select(geo.pose_heading(F.col("kind"), r)).collect()]
    half = round(np.pi / 2, 6)
    assert [abs(g - w) < 1e-5 for g, w in zip(got, [half, -half, 0.0, 0.0, 0.0])] == [True] * 5


def test_marked_spans_against_a_loop(spark):
    rng = np.random.default_rng(1)
    lists = [[["<", ">", "x", "y"][i] for i in rng.integers(0, 4, n)] for n in (0, 1, 5, 30, 200)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(lists)], "i int, t array<string>").select("i", marked_spans(F.col("t"), "<", ">").alias("m")).collect()
    for row in got:
        inside, want = False, []
        for t in lists[row["i"]]:
            inside = t == "<" or (inside and t != ">")
            want.append(t if inside and t != "<" else None)
        assert row["m"] == (want if any(want) else None)
