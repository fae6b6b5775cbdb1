"""Hand-made goldens: edges that the given tables do not reach."""

import math

import pytest
from pyspark.sql import functions as F

from posegrid.functions import geometry as G
from posegrid.operators import clouds, components, graphs, metrics, spatial, trajectories
from posegrid.plans import catalogue
from posegrid.views import view

STEPS = "episode long, step long, action int, tick long, x double, y double"


def _walk(spark, actions):
    rows = [(e, i, a) for e, acts in actions.items() for i, a in enumerate(acts)]
    return trajectories.dead_reckon(spark.createDataFrame(rows, "episode long, step long, action int"))


def test_square_walk_closes(spark):
    square = ([1] * 4 + [3] * 6) * 4 + [0]
    last = _walk(spark, {1: square}).orderBy(F.desc("step")).first()
    assert abs(last.x) < 1e-9 and abs(last.y) < 1e-9 and last.tick == 0


def test_stuck_walk_both_modes(spark):
    s = trajectories.stuck_steps(_walk(spark, {1: [4, 4, 4, 4, 1, 1], 2: [1] * 6}))
    cut = trajectories.truncate_stuck(s).where("episode = 1").orderBy("step").collect()
    assert [r.action for r in cut] == [4, 4, 0]
    assert {r.episode for r in trajectories.truncate_stuck(s, "reject").collect()} == {2}


def test_macro_steps_cut_by_distance_turn_stop_and_tail(spark):
    got = trajectories.macro_steps(_walk(spark, {1: [1, 1, 1, 1, 3, 3, 3, 1, 0, 1]})).orderBy("chunk").collect()
    assert [(r.first, r.last) for r in got] == [(0, 4), (4, 7), (7, 8), (8, 9)]


def test_ndtw_identical_shifted_and_repeated(spark):
    path = [(1, i, 0.25 * i, 0.0) for i in range(8)]
    shifted = [(1, i, 0.25 * i, 3.0) for i in range(8)]
    twice = [(1, 2 * i + j, 0.25 * i, 0.0) for i in range(8) for j in range(2)]
    kind = "episode long, step long, x double, y double"
    df = lambda rows: spark.createDataFrame(rows, kind)
    one = lambda a, b: trajectories.ndtw(df(a), df(b)).first().ndtw
    assert one(path, path) == 1.0 and one(twice, path) == 1.0
    assert math.isclose(one(shifted, path), math.exp(-8 * 3.0 / (8 * 3.0)))
    assert trajectories.ndtw(df(path), df(path).where("false")).first().ndtw == 0.0


def test_quaternions_of_both_signs_average(spark):
    rows = [(1, 0.6, 0.8, 0.0, 0.0), (1, -0.6, -0.8, 0.0, 0.0), (1, 0.6, 0.8, 0.0, 0.0)]
    q = clouds.voxel_quat_mean(spark.createDataFrame(rows, "k long, qw double, qx double, qy double, qz double"), ["k"]).first()
    assert math.isclose(q.qw, 0.6) and math.isclose(q.qx, 0.8)


def _cells(spark, places):
    return spark.createDataFrame([(1, x, y) for x, y in places], "scene long, gx long, gy long")


def test_dbscan_against_brute_force(spark):
    import random

    rng = random.Random(1)
    pts = sorted({(rng.randrange(25), rng.randrange(25)) for _ in range(150)})
    near = {p: [q for q in pts if (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= 2.25] for p in pts}
    core = {p for p in pts if len(near[p]) >= 4}
    label = {p: p for p in core}
    for _ in range(len(core)):
        for p in core:
            label[p] = min([label[p], *(label[q] for q in near[p] if q in core)])
    want = {p: label[p] if p in core else min((label[q] for q in near[p] if q in core), default=None) for p in pts}
    got = {(r.gx, r.gy): r.cluster for r in spatial.dbscan(_cells(spark, pts), 1.5, 4, ["gx", "gy"]).collect()}
    name = {v: k for k, v in ((p, (got[p])) for p in pts if want[p] == p)}
    assert {p: name.get(c) for p, c in got.items()} == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "src long, dst long")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}
    assert components.connected_components(edges.where("false")).count() == 0


def test_two_rooms_with_a_door(spark):
    wall = {(4, y) for y in range(9) if y != 4}
    cells = _cells(spark, [(x, y) for x in range(9) for y in range(9) if (x, y) not in wall])
    edges = spatial.radius_edges(cells, 1.0)
    tree = graphs.geodesic(graphs.both_ways(edges, "dist"), cells.where("gx = 0 AND gy = 0").select("scene", F.struct("gx", "gy").alias("source")), 30.0)
    d = {(r.node.gx, r.node.gy): r.dist for r in tree.collect()}
    assert d[(8, 0)] == 16.0 and d[(3, 0)] == 3.0 and len(d) == 73
    path = graphs.trace_paths(tree, spark.createDataFrame([(1, (0, 0), (8, 0))], "scene long, source struct<gx:long,gy:long>, goal struct<gx:long,gy:long>"))
    nodes = {(r.node.gx, r.node.gy) for r in path.collect()}
    assert (4, 4) in nodes and len(nodes) == 17
    sight = spatial.line_of_sight(spark.createDataFrame([(1, 3, 1, 5, 1, 2.0), (1, 1, 1, 3, 1, 2.0)], "scene long, ax long, ay long, bx long, by long, dist double"), cells, gap=0)
    assert [(r.ax, r.bx) for r in sight.collect()] == [(1, 3)]
    clear = {(r.gx, r.gy): r.clearance for r in graphs.clearance(cells, 4).collect()}
    assert clear[(3, 0)] == 1.0 and clear[(2, 4)] == math.sqrt(5)


def test_metric_edges(spark):
    preds = spark.createDataFrame([(1, 0, 0.5, 1), (1, 1, 0.5, 1), (2, 0, 0.9, 0), (2, 1, 0.1, 0)], "q long, cls int, score double, label int")
    assert metrics.topk_accuracy(preds, [1]).first().accuracy == 0.5  # a tie goes to the least class
    seg = spark.createDataFrame([(1, 0, 255), (1, 1, 255)], "image long, pred int, label int")
    assert metrics.seg_areas(seg).count() == 0 and metrics.seg_scores(metrics.seg_areas(seg)).first().miou is None
    empty = spark.createDataFrame([], "success int, spl double, ne double")
    assert tuple(trajectories.nav_summary(empty).first()) == (0.0, 0.0, 0.0, 0)
    rows = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (1.0,)], "x double")
    assert metrics.finite_only(rows, ["x"]).count() == 1


def test_range_joins_have_no_cartesian_plan(spark, sf_dir):
    cells = view(spark, sf_dir, "cells")
    plan = spatial.radius_edges(cells)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_angles_wrap(spark):
    r = spark.range(1).select(G.wrap_angle(F.lit(math.pi)).alias("a"), G.wrap_angle(F.lit(-3 * math.pi / 2)).alias("b"), G.heading_of(F.lit(0.0), F.lit(1.0)).alias("h")).first()
    assert math.isclose(r.a, -math.pi) and math.isclose(r.b, math.pi / 2) and r.h == 0.0


def test_sinkhorn_rows_sum_to_one(spark):
    from posegrid.operators import vectors

    s = spark.createDataFrame([(i, j, float((i * 7 + j * 3) % 5) / 10) for i in range(6) for j in range(3)], "sample long, prototype long, score double")
    sums = vectors.sinkhorn(s).groupBy("sample").agg(F.sum("p").alias("t")).collect()
    assert all(math.isclose(r.t, 1.0, rel_tol=1e-9) for r in sums)


@pytest.mark.parametrize("name", ["nav_metrics", "stuck_steps", "voxel_downsample", "radius_edges", "topk_accuracy_macro", "depth_metrics", "frame_manifest", "scene_blocks", "equirect_lonlat", "merged_logs"])
def test_queries_match_their_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    from posegrid.views import BASE

    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = catalogue.QUERIES[name](spark, sf_dir)
    cols = sorted(got.columns)
    res = con.execute(catalogue.ORACLE_SQL[name])
    at = [[d[0] for d in res.description].index(c) for c in cols]
    norm = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    assert sorted([tuple(norm(r[c]) for c in cols) for r in got.collect()], key=str) == sorted([tuple(norm(r[i]) for i in at) for r in res.fetchall()], key=str)
