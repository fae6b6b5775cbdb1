"""Geodesics, lines of sight and nearest neighbours against plain versions."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from posegrid.operators import graphs, spatial, vectors

CELLS = "scene long, gx long, gy long"


@pytest.mark.parametrize("delta", [None, 0.7, 100.0])
def test_geodesics_equal_dijkstra(spark, delta):
    rng = random.Random(6)
    arcs = [(s, a, b, round(rng.uniform(0, 3), 3)) for s in (1, 2) for a in range(60) for b in rng.sample(range(60), 3) if a != b]
    arcs += [(1, 0, 61, 1.0), (1, 1, 61, 1.0), (1, 61, 62, 0.0), (1, 62, 61, 0.0)]
    df = spark.createDataFrame(arcs, "scene long, src long, dst long, w double")
    sources = [(1, 0, 4.0), (1, 5, 2.5), (2, 7, 6.0), (2, 999, 6.0)]
    got = graphs.geodesic(df, spark.createDataFrame(sources, "scene long, source long, most double"), "most", delta)
    want = {}
    for scene, source, most in sources:
        best, heap = {}, [(0.0, source)]
        while heap:
            d, node = heapq.heappop(heap)
            if node in best:
                continue
            best[node] = d
            for s, a, b, w in arcs:
                if s == scene and a == node and round(d + w, 9) <= most:
                    heapq.heappush(heap, (round(d + w, 9), b))
        want |= {(scene, source, n): d for n, d in best.items()}
    rows = got.collect()
    assert {(r.scene, r.source, r.node): r.dist for r in rows} == want
    for r in rows:
        before = [a for s, a, b, w in arcs if s == r.scene and b == r.node and w > 0 and abs(want.get((s, r.source, a), 1e9) + w - r.dist) < 1e-9]
        assert (r.via is None) == (r.node == r.source) and (not before or r.node == r.source or r.via == min(before))


def _sees(cells, edge, per_cell, gap):
    scene, ax, ay, bx, by = edge
    n = max(1, math.ceil(math.hypot(bx - ax, by - ay) * per_cell))
    hit = [(scene, ax + math.floor((bx - ax) * k / n + 0.5), ay + math.floor((by - ay) * k / n + 0.5)) in cells for k in range(n + 1)]
    wide = [any(hit[max(0, k - gap) : k + gap + 1]) for k in range(n + 1)]
    return all(all(wide[max(0, k - gap) : k + gap + 1]) for k in range(n + 1))


@pytest.mark.parametrize("r, per_cell, gap, cap", [(2.5, 2, 1, 64), (5.0, 2, 1, 200), (4.2, 2, 0, 20), (1.5, 3, 0, 64)])
def test_lines_of_sight_equal_the_sampled_ones(spark, r, per_cell, gap, cap):
    rng = random.Random(1)
    cells = {(s, x, y) for s in (0, 1) for x in range(-4, 12) for y in range(12) if rng.random() < 0.6}
    df = spark.createDataFrame(sorted(cells), CELLS)
    edges = spatial.radius_edges(df, r, cap)
    want = set()
    for s, x, y in cells:
        near = sorted((math.hypot(a - x, b - y), a, b) for t, a, b in cells if t == s and math.hypot(a - x, b - y) <= r)[:cap]
        want |= {(s, x, y, a, b) for _, a, b in near if (a, b) > (x, y)}
    names = ["scene", "ax", "ay", "bx", "by"]
    assert {tuple(x) for x in edges.select(names).collect()} == want
    seen = spatial.line_of_sight(edges, df, per_cell, gap)
    assert {tuple(x) for x in seen.select(names).collect()} == {e for e in want if _sees(cells, e, per_cell, gap)}
    assert "Window" not in spatial.line_of_sight(edges, df, per_cell, gap, r)._jdf.queryExecution().analyzed().toString() or cap < 40


@pytest.mark.parametrize("clustered", [False, True])
def test_neighbours_equal_brute_force(spark, clustered):
    rng = np.random.default_rng(3)
    e = rng.normal(size=(600, 12)) + (8 * rng.normal(size=(6, 12))[np.arange(600) % 6] if clustered else 0)
    e[100:160] = e[100]  # many equal vectors
    rows = [(i, [float(x) for x in np.float32(v)], i % 4) for i, v in enumerate(e)]
    df = spark.createDataFrame([*rows, (None, rows[0][1], 0), (900, None, 1)], "vec_id long, embedding array<float>, label int")
    sims = np.round(np.array([v for _, v, _ in rows]) @ np.array([v for _, v, _ in rows]).T, 9)
    for k, skip, block, cells in ((5, False, 4096, None), (7, True, 50, 20), (700, False, 64, 3)):
        got = {}
        for r in vectors.knn(df.where("vec_id % 9 = 0"), df.where("vec_id < 600 OR vec_id IS NULL"), k, skip, block, cells).collect():
            got.setdefault(r.q, {})[r.rank] = (r.vec_id, r.label, r.sim)
        for q in range(0, 600, 9):
            order = sorted(range(600), key=lambda j: (-sims[q, j], j))[int(skip) : k + int(skip)]
            assert [got[q][i + 1] for i in range(len(order))] == [(j, j % 4, pytest.approx(sims[q, j])) for j in order]
    if clustered:  # most cells are pruned
        centres = np.array([v for _, v, _ in rows[:30]])
        own = ((np.array([v for _, v, _ in rows])[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        radius = np.array([max([np.linalg.norm(np.array(rows[i][1]) - centres[c]) for i in np.flatnonzero(own == c)], default=0.0) for c in range(30)])
        asked = vectors._asked(df.where("vec_id < 60").select(F.col("vec_id").alias("q"), "embedding"), centres, np.bincount(own, minlength=30), radius, 5)
        assert asked.agg(F.avg(F.size("cells"))).first()[0] < 20
    assert vectors.knn(df, df.limit(0), 3).count() == 0
