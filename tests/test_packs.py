"""Neighbourhoods by tiles, against plain loops over places that many tiles share."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from posegrid.operators import clouds, spatial

CELLS = "scene long, gx long, gy long"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _clusters(at, eps, least):
    """Places by the least core of their cluster."""
    near = {p: [(x, y) for x in range(p[0] - 3, p[0] + 4) for y in range(p[1] - 3, p[1] + 4) if (x, y) in at and (x - p[0]) ** 2 + (y - p[1]) ** 2 <= eps**2] for p in at}
    core, label = {p for p in at if len(near[p]) >= least}, {}
    for c in sorted(core):
        todo = [c] if c not in label else []
        while todo:
            d = todo.pop()
            if d not in label:
                label[d] = c
                todo += [e for e in near[d] if e in core]
    border = {p for p in at - core if any(q in core for q in near[p])}
    return {**label, **{p: min(label[q] for q in near[p] if q in core) for p in border}}


@pytest.mark.parametrize("eps,least", [(1.5, 4), (1.5, 1), (2.0, 6)])
def test_clusters_over_many_tiles(spark, eps, least):
    rng = np.random.default_rng(11)
    at = {(int(x), int(y)) for x, y in zip(rng.integers(-150, 300, 6_000), rng.integers(-4, 12, 6_000))}
    label = _clusters(at, eps, least)
    cells = spark.createDataFrame([(s, x, y) for s in (1, 2) for x, y in at], CELLS)
    got = spatial.density_parts(cells, eps, least, ["gx", "gy"]).collect()
    assert {(r.scene, r.gx, r.gy): r._head and tuple(r._head) for r in got} == {(s, *p): label.get(p) for s in (1, 2) for p in at}
    assert len(got) == 2 * len(at) and any(abs(p[0] - c[0]) > 64 * eps for p, c in label.items())


def test_clusters_make_no_rows_of_pairs(spark):
    """No join, and nothing exploded but a place to the tiles that it borders."""
    cells = spark.createDataFrame([(1, x, y) for x in range(40) for y in range(40)] + [(1, None, 3)], CELLS)
    found = spatial.density_parts(cells, 1.5, 4, ["gx", "gy"])
    assert "Join" not in _plan(found) and found.where("_head IS NULL").collect()[0].gx is None
    assert "Join" not in _plan(clouds.cell_components(cells))
    assert "Join" not in _plan(spatial.place_counts(cells, 1.5, ["gx", "gy"]))


def test_counts_over_many_tiles(spark):
    rng = np.random.default_rng(12)
    at = np.round(rng.uniform(-200, 200, (3_000, 3)) * [1, 0.02, 0.02], 2)
    rows = [("a", *map(float, p)) for p in [*at, *at[:50]]]
    shape = "scene string, x double, y double, z double"
    got = {(r.x, r.y, r.z): (r.n, r.neighbours) for r in spatial.place_counts(spark.createDataFrame([*rows, ("a", None, 0.0, 0.0)], shape), 0.7, ["x", "y", "z"]).collect()}
    p = np.array([r[1:] for r in rows])
    want = {}
    for q in {tuple(q) for q in p}:
        d = p - np.array(q)
        want[q] = (int((d == 0).all(1).sum()), int((d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2] <= 0.7 * 0.7).sum()))
    assert got == want and max(b for _, b in want.values()) > 3
    counted = spatial.radius_count(spark.createDataFrame(rows, shape), 0.7, ["x", "y", "z"])
    assert counted.count() == len(rows) and counted.agg(F.sum("neighbours")).first()[0] == sum(n * b for n, b in want.values())
