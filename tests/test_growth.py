"""Steps whose memory, disk or time grew faster than their tables."""

import numpy as np
from pyspark.sql import functions as F

from posegrid.operators import clouds, components, graphs, registry, spatial, vectors
from posegrid.plans import graphs as plans
from posegrid.plans import space, streams
from posegrid.sources import readers, sinks

CELLS = "scene long, gx long, gy long"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rounds_of_the_registry_broadcast_nothing(spark, monkeypatch):
    plans, keep = [], registry.materialise
    monkeypatch.setattr(registry, "materialise", lambda df, name: plans.append(_plan(df)) or keep(df, name))
    rows = [(1, 1, i, float(i % 7), float(i % 5), 0.0) for i in range(60)]
    got = registry.first_seen(spark.createDataFrame(rows, "scene long, cls long, seq long, x double, y double, z double"), 1.5, ["seq"])
    assert got.count() and len(plans) > 2 and not any("BroadcastHashJoin" in p for p in plans)


def test_clusters_broadcast_nothing(spark):
    cells = spark.createDataFrame([(s, x, y) for s in (1, 2) for x, y in ((0, 0), (0, 1), (1, 0), (1, 1), (5, 5), (7, 7), (7, 8), (8, 7))], CELLS)
    got = clouds.remove_small_clusters(cells, 1.5, 3, ["gx", "gy"], 3)
    assert "BroadcastHashJoin" not in _plan(got)
    assert {tuple(r) for r in got.select("scene", "gx", "gy", "cluster").collect()} == {(s, x, y, f"{s}|0|0") for s in (1, 2) for x in (0, 1) for y in (0, 1)}


def test_parts_are_linked_in_chunks_first(spark, monkeypatch):
    """A path in shuffled order, whole in one chunk, needs no round but the one that finds no change."""
    order = np.random.default_rng(1).permutation(400)
    rounds, keep = [], components._star
    monkeypatch.setattr(components, "_star", lambda e, small: rounds.append(small) or keep(e, small))
    edges = spark.createDataFrame([(1, int(i), int(i) + 1) for i in order], "scene long, src long, dst long")
    got = {r.node: r.component for r in components.connected_components(edges, near=["scene"]).collect()}
    assert got == {i: 0 for i in range(401)} and len(rounds) == 2
    monkeypatch.setattr(components, "CHUNK", 16)
    node, low = components.least_linked(np.array([5, 9, 2]), np.array([9, 7, 3]))
    assert dict(zip(node.tolist(), low.tolist())) == {2: 2, 3: 2, 5: 5, 7: 5, 9: 5}


def test_points_of_many_scenes_in_few_folders(spark, tmp_path):
    points = spark.createDataFrame([(s, s % 2, i) for s in range(-5, 300) for i in range(3)], "scene_id long, layer int, x_cm long")
    sinks.write_points(points, f"{tmp_path}/p")
    assert len([*(tmp_path / "p").glob("shelf=*/layer=*")]) <= 2 * sinks.SHELVES
    for s in (3, -5, 299):
        one = readers.read_points(spark, f"{tmp_path}/p", s)
        assert sorted((r.scene_id, r.layer, r.x_cm) for r in one.collect()) == [(s, s % 2, i) for i in range(3)]
    assert readers.read_points(spark, f"{tmp_path}/p").count() == 915


def test_scanned_points_are_all_points(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    got = streams.QUERIES["scan_points"](spark, sf_dir)
    assert got.agg(F.sum("n")).first()[0] == lines


def test_poses_are_scanned_from_few_files(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "_folder", lambda df, name: f"{tmp_path}/{name}")
    rows = streams.QUERIES["scan_pose_text"](spark, sf_dir).count()
    assert rows == spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    assert len([*tmp_path.rglob("part-*")]) < rows / 10


def test_pose_packs_drop_what_is_no_pose(spark, tmp_path):
    (tmp_path / "a.txt").write_text("id=1/pose.txt\t1.5, 2 3 0 0 0 1\nid=2/pose.txt\t1 2\nno path 1 2 3 4 5 6 7\n")
    (r,) = readers.read_pose_packs(spark, str(tmp_path)).collect()
    assert (r.path, r.tx, r.qw) == ("id=1/pose.txt", 1.5, 1.0)


def test_tiles_hold_what_lies_across_their_borders(spark):
    rng = np.random.default_rng(3)
    at = {(int(x), int(y)) for x, y in rng.integers(-70, 140, (9000, 2))}
    cells = spark.createDataFrame([(1, x, y) for x, y in at], CELLS)
    far = {p: min([4.0] + [(a * a + b * b) ** 0.5 for a in range(-4, 5) for b in range(-4, 5) if a * a + b * b <= 16 and (p[0] + a, p[1] + b) not in at]) for p in at}
    clear = graphs.clearance(cells, 4)
    assert {(r.gx, r.gy): r.clearance for r in clear.collect()} == far
    obst = {p for p in at if sum(p) % 9 == 0}
    kernel = clouds.disk(2)
    wide = {(x + a, y + b) for x, y in at - obst for a, b in kernel}
    closed = {p for p in {(x + a, y + b) for x, y in wide for a, b in kernel} if all((p[0] + a, p[1] + b) in wide for a, b in kernel)}
    grown = {(x + a, y + b) for x, y in obst for a, b in clouds.disk(1)}
    fill = clouds.walkable_fill(cells.where("pmod(gx + gy, 9) <> 0"), cells.where("pmod(gx + gy, 9) = 0"), 2, 1)
    assert {(r.gx, r.gy) for r in fill.collect()} == closed - (at - obst) - grown
    # one shuffle of cells, no join
    assert "Join" not in _plan(fill) and "Join" not in _plan(clear)


def test_bounded_searches_take_cells_within_reach_only(spark, monkeypatch):
    rng = np.random.default_rng(5)
    cells = spark.createDataFrame([(s, int(x), int(y)) for s in (1, 2) for x, y in {(0, 0)} | {tuple(p) for p in rng.integers(0, 40, (900, 2)).tolist()}], CELLS)
    sources = plans._sources(cells)
    assert graphs.within(cells, sources, 4.0).where("gx * gx + gy * gy > 25").isEmpty()
    rows = lambda df: sorted(map(tuple, df.collect()))
    near = rows(plans._bounded(cells, 6.0)), rows(plans.least_cost_paths(cells))
    monkeypatch.setattr(graphs, "within", lambda places, *a, **k: places)
    assert near == (rows(plans._bounded(cells, 6.0)), rows(plans.least_cost_paths(cells)))


def test_floor_snap_takes_all_lines_and_copies_the_queries(spark, sf_dir, monkeypatch):
    sides, keep = [], spatial.radius_pairs
    monkeypatch.setattr(spatial, "radius_pairs", lambda a, b, r, dims, keys=["scene"], explode="right": sides.append(explode) or keep(a, b, r, dims, keys, explode))  # noqa: B006
    got = space.QUERIES["floor_aware_snap"](spark, sf_dir)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_orderkey % 50 = 0")
    at = lines.selectExpr("l_suppkey", "l_orderkey", "l_partkey % 60 * 5 + l_linenumber % 5").distinct()
    assert got.count() == at.count() and {*sides} == {"left"}


def test_registry_waits_at_borders_only(spark, monkeypatch):
    """The first seen of 3,000 rows in tiles of 4 x 4 cells, against a plain loop; with cells that
    remember one open row too. Rows of one tile take one pass; no pass joins."""
    rng = np.random.default_rng(7)
    at = [(int(s), float(x), float(y)) for s, x, y in zip(rng.integers(0, 2, 3000), rng.integers(0, 60, 3000) / 2, rng.integers(0, 60, 3000) / 2)]
    rows = [(s, 1, int(i), x, y) for (s, x, y), i in zip(at, rng.permutation(3000))] + [(0, 1, 5000 + i, i / 2, 30.0) for i in range(80)]
    rows += [(0, 1, 9000, float("nan"), 0.0), (0, 1, 9000, float("nan"), 0.0), (1, 1, 9001, float("inf"), 0.0), (0, None, 9002, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "scene long, cls long, seq long, x double, y double").repartition(4)
    want, kept = [], {}
    for s, _, i, x, y in sorted(rows[:3080], key=lambda r: r[2]):
        near = kept.setdefault(s, [])
        if all((x - a) ** 2 + (y - b) ** 2 > 2.25 for a, b in near):
            near.append((x, y))
            want.append(i)
    passes, keep = [], registry.materialise
    monkeypatch.setattr(registry, "materialise", lambda d, name: passes.append((name, _plan(d))) or keep(d, name))
    for side, most in ((64, 256), (4, 256), (4, 1)):
        passes.clear()
        monkeypatch.setattr(registry.packs, "SIDE", side)
        monkeypatch.setattr(registry, "MOST", most)
        got = registry.first_seen(df, 1.5, ["seq"], dims=["x", "y"])
        assert sorted(r.seq for r in got.collect()) == sorted([*want, 9000, 9001, 9002])
        assert got.columns == df.columns and not any("Join" in p for _, p in passes)
        assert (len([n for n, _ in passes if n == "first-seen"]) > 1) == (side == 4)


def test_nearest_neighbours_copy_no_vectors(spark, monkeypatch):
    """Of a product of lots, shuffles carry each vector once on either side, and each query's nearest of a partition."""
    rng = np.random.default_rng(9)
    e = np.round(rng.normal(size=(900, 6)), 1)
    e[500:560] = e[3]
    rows = [(i, [float(x) for x in v], i % 3 if i % 7 else None) for i, v in enumerate(e)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    kept, keep = {}, vectors.materialise
    monkeypatch.setattr(vectors, "materialise", lambda d, name: kept.setdefault(name, keep(d, name)))
    monkeypatch.setattr(vectors, "WIDE", 200)
    got = vectors.knn(df, df, 4, block=100)
    plan = _plan(got)
    assert "CartesianProduct" in plan and "explode" not in plan and "CoGroup" not in plan
    for name, column in (("knn-corpus", "vec_id"), ("knn-queries", "q")):
        assert kept[name].agg(F.sum(F.octet_length(column))).first()[0] == 8 * 900 and kept[name].count() < 30
    sims = np.round(e @ e.T, 9)
    want = {(q, int(j), i + 1) for q in range(900) for i, j in enumerate(np.lexsort((np.arange(900), -sims[q]))[:4])}
    out = got.collect()
    assert {(r.q, r.vec_id, r["rank"]) for r in out} == want and len(out) == 3600
    assert all(r.label == (r.vec_id % 3 if r.vec_id % 7 else None) for r in out)


def test_sizes_are_computed_once_a_vector(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([],)], "v array<double>").select(vectors.l2_normalise("v").alias("u"))
    assert [r.u for r in df.collect()] == [[0.6, 0.8], [0.0, 0.0], None, []]
    # the size lies outside of the function that goes over the elements
    assert "array_repeat" in _plan(df)
