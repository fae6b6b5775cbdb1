"""Tasks, groups and shuffles that grew with a key, a scene or the pairs."""

import re

import numpy as np
from pyspark.sql import functions as F

from posegrid.operators import clouds, graphs, spatial, vectors
from posegrid.plans import streams
from posegrid.streaming import jobs

CELLS = "scene long, gx long, gy long"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df, places=9):
    return sorted(tuple(round(v, places) if isinstance(v, float) else v for v in r) for r in df.collect())


def _cells(spark, seed, n=5_000):
    rng = np.random.default_rng(seed)
    at = {(int(s), int(x), int(y)) for s, x, y in zip(rng.integers(1, 3, n), rng.integers(-50, 150, n), rng.integers(-8, 12, n))}
    return at, spark.createDataFrame([*at], CELLS)


def test_voxels_take_more_tasks_for_more_points(spark, monkeypatch):
    monkeypatch.setattr(clouds, "SHARE", 10)
    points = spark.createDataFrame([(i % 9, float(i % 7), float(i % 5)) for i in range(300)], "scene long, x double, y double")
    for out in (clouds.voxel_downsample(points, 2.0, ["x", "y"], []), clouds.occupancy(points, 2.0)):
        assert "30" in re.findall(r"hashpartitioning\(scene#\d+L, (\d+)\), REPARTITION_BY_NUM", _plan(out))
        assert out.agg(F.countDistinct("scene")).first()[0] == 9


def test_safe_edges_equal_the_joins_of_their_parts(spark):
    _, cells = _cells(spark, 21)
    got = graphs.safe_edge_costs(cells, 2.5, 4, 0.15, 0.05, 5.0, 0.2)
    edges = spatial.line_of_sight(spatial.radius_edges(cells), cells, reach=2.5)
    want = graphs.edge_costs(edges, graphs.clearance(cells, 4), 0.15, 0.05, 5.0, 0.2)
    assert _rows(got) == _rows(want.select(*got.columns)) and got.count() > 1_000
    assert "Join" not in _plan(got)


def test_nearest_over_tiles_and_far_away(spark, monkeypatch):
    at, _ = _cells(spark, 22, 1_500)
    nodes = sorted(p for p in at if sum(p) % 7 == 0) + [(1, 900, 0)]
    asked = sorted(at) + [(1, 400, 0), (3, 0, 0), (None, 1, 1)]
    shape = "scene long, x long, y long"
    got = spatial.snap(spark.createDataFrame(asked, shape), spark.createDataFrame(nodes, shape), ["x", "y"], 2.0)
    want = {}
    for q in asked:
        near = [((n[1] - q[1]) ** 2 + (n[2] - q[2]) ** 2, n[1], n[2]) for n in nodes if n[0] == q[0]]
        want[q] = min(near) if near else (None, None, None)
    assert {(r.scene, r.x, r.y): (r.d2, r.b_x, r.b_y) for r in got.collect()} == want
    # what is near takes no join of pairs
    monkeypatch.setattr(spatial, "radius_pairs", None)
    assert spatial.snap(spark.createDataFrame(asked[:500], shape), spark.createDataFrame(asked[:500], shape), ["x", "y"], 2.0).count() == 500


def test_best_products_with_ties():
    rng = np.random.default_rng(4)
    sims = np.round(rng.normal(size=(40, 300)), 1) + rng.uniform(-4e-10, 4e-10, (40, 300))
    ids = rng.permutation(300)
    for want in (1, 3, 20, 400):
        order = np.lexsort((np.broadcast_to(ids, sims.shape), -np.round(sims, 9)), axis=1)[:, :want]
        row, col, value = vectors.best(sims, ids, want)
        assert np.array_equal(col, order.ravel()) and np.array_equal(row, np.repeat(np.arange(40), order.shape[1]))
        assert np.array_equal(value, np.take_along_axis(np.round(sims, 9), order, 1).ravel())


def test_registry_is_called_by_scene(spark):
    """Two scenes of many classes make two groups."""
    rows = [(s, f"c{c}" if c else None, i, 30.0 * i, -1.0, 0.0) for s in (1, 2) for c in range(40) for i in range(3)]
    df = spark.createDataFrame(rows, "scene long, cls string, seq long, x double, y double, z double")
    got = streams.streamed(df.repartition(3), lambda s: jobs.object_registry(s, 50.0), batches=[df.where("seq = 0"), df.where("seq > 0")])
    assert sorted((r.scene, r.cls or "", r.x) for r in got.collect()) == sorted((s, f"c{c}" if c else "", x) for s in (1, 2) for c in range(40) for x in (0.0, 60.0))
    seen = []

    class Rows:
        def select(self, *_):
            return self

        def groupBy(self, *keys):
            seen.extend(keys)
            return self

        def transformWithStateInPandas(self, *_):
            return self

    jobs.object_registry(Rows(), 50.0)
    assert seen == ["_scene"]


def test_meter_goes_by_pieces(spark, sf_dir, monkeypatch):
    whole = _rows(streams.QUERIES["stream_sliding_meter"](spark, sf_dir))
    keys, keep = [], jobs.sliding_meter
    monkeypatch.setattr(streams, "METER_PIECE", 40)
    monkeypatch.setattr(jobs, "sliding_meter", lambda rows, key: keep(rows, key) if not keys.append(key) else None)
    assert _rows(streams.QUERIES["stream_sliding_meter"](spark, sf_dir)) == whole and len(keys) == 1
