"""Operators that SQL can't say, against plain loops over small rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from posegrid.functions import callables
from posegrid.functions import geometry as G
from posegrid.functions import text as X
from posegrid.operators import clouds, graphs, metrics, sampling, spatial, trajectories
from posegrid.sources import readers, sinks

CELLS = "scene long, gx long, gy long"
STEPS = "episode long, step long, action int, tick int, x double, y double"


def _cells(seed, share=0.4, size=14):
    rng = random.Random(seed)
    return sorted({(s, x, y) for s in (0, 1) for x in range(size) for y in range(size) if rng.random() < share})


def _parts(cells):
    """Cells by the least cell of their 8-connected part."""
    left, out = set(cells), {}
    for c in sorted(cells):
        if c not in left:
            continue
        todo, part = [c], []
        left.discard(c)
        while todo:
            s, x, y = todo.pop()
            part.append((s, x, y))
            for near in [(s, x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if near in left:
                    left.discard(near)
                    todo.append(near)
        out[c] = part
    return out


def test_despeckle_keeps_parts_of_more_than_eight_cells(spark):
    cells = _cells(3)
    want = {c for part in _parts(cells).values() if len(part) > 8 for c in part}
    got = clouds.despeckle(spark.createDataFrame([*cells, cells[0]], CELLS), 8).select("scene", "gx", "gy")
    assert {tuple(r) for r in got.collect()} == want and 0 < len(want) < len(cells)


def test_small_clusters_go(spark):
    cells = _cells(5, 0.3)
    near = {c: [d for d in cells if d[0] == c[0] and (c[1] - d[1]) ** 2 + (c[2] - d[2]) ** 2 <= 2.25] for c in cells}
    core = {c for c in cells if len(near[c]) >= 4}
    label = {}
    for c in sorted(core):
        todo = [c] if c not in label else []
        while todo:
            d = todo.pop()
            if d not in label:
                label[d] = c
                todo += [e for e in near[d] if e in core]
    for c in set(cells) - core:
        own = [label[d] for d in near[c] if d in core]
        if own:
            label[c] = min(own)
    size = {k: sum(v == k for v in label.values()) for k in set(label.values())}
    got = clouds.remove_small_clusters(spark.createDataFrame(cells, CELLS), 1.5, 4, ["gx", "gy"], 6).select("scene", "gx", "gy")
    assert {tuple(r) for r in got.collect()} == {c for c, k in label.items() if size[k] > 6}


def test_scene_quality_goes_by_voxels(spark):
    rng = random.Random(2)
    rows = [(s, rng.uniform(0, 4), rng.uniform(0, 4)) for s in (1, 2) for _ in range(4_000 if s == 1 else 40)]
    got = {r.scene: r for r in clouds.scene_quality(spark.createDataFrame(rows, "scene long, x double, y double"), 0.25, ["x", "y"], min_points=3, least_area=10.0).collect()}
    low = {s: [min(r[i] for r in rows if r[0] == s) for i in (1, 2)] for s in (1, 2)}
    voxels = {(s, math.floor((x - low[s][0]) / 0.25), math.floor((y - low[s][1]) / 0.25)) for s, x, y in rows}
    assert got[1].ok and got[1].n_points == 4_000 and abs(got[1].area - 0.0625 * sum(v[0] == 1 for v in voxels)) < 0.7
    assert not got[2].ok and got[2].n_points == 40


def test_planes_have_most_inliers_and_level_their_scene(spark):
    rng = random.Random(7)
    normal = np.array([0.2, -0.1, 1.0]) / np.linalg.norm([0.2, -0.1, 1.0])
    rows = []
    for i in range(300):
        x, y = rng.uniform(-5, 5), rng.uniform(-5, 5)
        z = (1.5 - normal[0] * x - normal[1] * y) / normal[2] + (rng.uniform(-0.01, 0.01) if i % 3 else rng.uniform(0.5, 2))
        rows.append((1, i, x, y, float(z)))
    rows += [(2, 1000, 0.0, 0.0, 4.0), (2, 1001, 1.0, 0.0, 6.0)]  # too few for a plane
    df = spark.createDataFrame(rows, "scene long, id long, x double, y double, z double")
    planes = clouds.fit_planes(df, ["id"], 0.05, tries=40)
    (p,) = planes.collect()
    assert abs(np.dot([p.a, p.b, p.c], normal)) > 0.999 and p.c > 0 and abs(p.d + 1.5) < 0.1
    assert p.inliers == sum(round(abs(p.a * x + p.b * y + p.c * z + p.d), 9) <= 0.05 for s, _, x, y, z in rows if s == 1) >= 180
    level = {r.id: r for r in clouds.level_scene(df, planes, 0.05).collect()}
    n = np.array([p.a, p.b, p.c])
    on = [n @ np.array(r[2:]) for r in rows if r[0] == 1 and abs(n @ np.array(r[2:]) + p.d) <= 0.05]
    for s, i, x, y, z in rows:
        if s == 1:
            assert abs(level[i].z - (n @ np.array([x, y, z]) - np.mean(on))) < 1e-9
            assert abs(math.sqrt(level[i].x ** 2 + level[i].y ** 2 + (level[i].z + np.mean(on)) ** 2) - math.sqrt(x * x + y * y + z * z)) < 1e-9
    assert (level[1000].z, level[1001].z) == (-1.0, 1.0)


def _walk(seed, n, episode=1):
    rng, x, y, out = random.Random(seed), 0.0, 0.0, []
    for i in range(n):
        tick = rng.randrange(24)
        out.append((episode, i, rng.choice([1, 1, 2, 3]), tick, round(x, 3), round(y, 3)))
        x, y = x + rng.uniform(-0.3, 0.5), y + rng.uniform(-0.4, 0.4)
    return out


def test_forward_match_and_waypoints(spark):
    steps, path = _walk(1, 80) + _walk(2, 40, 2), [(1, i, 0.3 * i, 0.1 * i) for i in range(60)]
    a, b = spark.createDataFrame(steps, STEPS), spark.createDataFrame(path, "episode long, i long, px double, py double")
    match = {(r.episode, r.step): r.matched for r in trajectories.forward_match(a, b, 15).collect()}
    way = {(r.episode, r.step): r.waypoint for r in trajectories.waypoint_progress(a, b, 0.6).collect()}
    at = reached = 0
    for e, s, _, _, x, y in steps:
        if e == 2:  # no path
            assert match[e, s] == 0 and way[e, s] == 0
            continue
        at = min(range(at, min(60, at + 16)), key=lambda i: (math.hypot(path[i][2] - x, path[i][3] - y), i))
        while reached < 60 and math.hypot(path[reached][2] - x, path[reached][3] - y) <= 0.6:
            reached += 1
        assert match[e, s] == at and way[e, s] == min(reached, 59)


def test_relabel_follows_its_own_path(spark):
    steps = _walk(4, 60)
    rows = {r.step: r for r in trajectories.relabel(spark.createDataFrame(steps, STEPS), far=1.0, ahead=15, goal=0.5).collect()}
    place = {s: (x, y) for _, s, _, _, x, y in steps}
    at = 0
    for _, s, _, tick, x, y in steps:
        at = min(range(at, min(60, at + 16)), key=lambda i: (math.hypot(place[i][0] - x, place[i][1] - y), i))
        sub = next((j for j in range(at + 1, 60) if round(math.dist(place[at], place[j]), 6) >= 1.0), 59)
        tx, ty = place[sub]
        turn = (round(math.degrees(math.pi / 2 - math.atan2(ty - y, tx - x)) - 15 * tick, 6) + 180) % 360 - 180
        far = math.dist((x, y), (tx, ty))
        want = 0 if math.dist((x, y), place[59]) < 0.5 else 1 if round(far, 6) < 0.05 or round(abs(turn), 6) <= 12 else 3 if turn > 0 else 2
        assert (rows[s].matched, rows[s].subgoal, rows[s].label) == (at, sub, want)


def test_jittered_samples_keep_both_ends(spark):
    steps = spark.createDataFrame(_walk(1, 50) + _walk(2, 5, 2), STEPS)
    got = {}
    for r in trajectories.sample_uniform(steps, 12, 0.4, seed=3).collect():
        got.setdefault(r.episode, []).append(r.step)
    assert sorted(got[2]) == list(range(5))
    own = sorted(got[1])
    assert len(own) == len(set(own)) == 12 and own[0] == 0 and own[-1] == 49
    stride = 49 / 11
    assert all(any(abs(s - k * stride) <= 0.4 * stride + 0.5 for k in range(12)) for s in own)
    again = [r.step for r in trajectories.sample_uniform(steps.repartition(3), 12, 0.4, seed=3).where("episode = 1").collect()]
    assert sorted(again) == own


def test_history_flush_thins_again_and_again(spark):
    rows = [(1, t) for t in range(150)] + [(2, t) for t in range(9)]
    got = trajectories.history_flush(spark.createDataFrame(rows, "conv_id long, turn long"), capacity=20, keep=12).collect()
    for conv, n in ((1, 150), (2, 9)):
        held = []
        for t in range(n):
            held.append(t)
            if len(held) >= 20:
                held = [held[j] for j in sorted({round(i * (len(held) - 1) / 11) for i in range(12)})]
        assert sorted(r.turn for r in got if r.conv_id == conv) == held


def test_rebalanced_labels_come_near_the_share(spark):
    rng = random.Random(1)
    rows = [(i, [rng.randrange(9) for _ in range(rng.randrange(1, 6))]) for i in range(4_000)]
    df = spark.createDataFrame(rows, "q long, labels array<int>")
    got = sampling.rebalance_multilabel(df, 0.3, 5).collect()
    total = sum(len(x) for _, x in rows)
    assert abs(sum(len(r.labels) for r in got) / total - 0.3) < 0.02 and len({r.q for r in got}) == len(got)
    assert sampling.rebalance_multilabel(df.limit(0), 0.3, 5).count() == 0


def test_sdtw_is_success_times_ndtw(spark):
    a, b = _walk(1, 12), _walk(9, 10)
    kind = "episode long, step long, action int, tick int, x double, y double"
    got = trajectories.ndtw(spark.createDataFrame(a + _walk(3, 4, 2), kind), spark.createDataFrame(b, kind)).collect()
    p, q = [r[4:] for r in a], [r[4:] for r in b]
    p = [v for i, v in enumerate(p) if not i or v != p[i - 1]]
    best = {}
    for i in range(len(p)):
        for j in range(len(q)):
            before = [best[k] for k in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if k in best]
            best[i, j] = math.dist(p[i], q[j]) + (min(before) if before else 0.0)
    assert {r.episode: pytest.approx(r.ndtw) for r in got} == {1: math.exp(-best[len(p) - 1, len(q) - 1] / (len(q) * 3.0)), 2: 0.0}


@pytest.mark.parametrize("band", [40, 1 << 20])
def test_ssim_in_bands_equals_the_whole(spark, band):
    rng = random.Random(2)
    rows = [(i, u, v, rng.random(), rng.random()) for i in (1, 2, 3) for u in range(17) for v in range(23) if rng.random() < (0.9 if i < 3 else 0.1)]
    rows += [(4, 5, 5, 0.3, 0.4), (1, 0, 900, 0.5, 0.5), (5, 1, 1, None, 0.2)]
    df = spark.createDataFrame(rows, "image int, u int, v int, a double, b double").repartition(3)
    got = {r.image: r.ssim for r in metrics.ssim(df, "a", "b", band=band).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    for image in got:
        own = {(u, v): (a, b) for i, u, v, a, b in rows if i == image}
        values = []
        for u, v in own:
            w = {(p, q): math.exp(-((p - u) ** 2 + (q - v) ** 2) / 4.5) for p, q in own if abs(p - u) <= 5 and abs(q - v) <= 5}
            mean = lambda f: sum(k * f(*own[at]) for at, k in w.items()) / sum(w.values())  # noqa: E731, B023
            a, b, aa, bb, ab = mean(lambda x, y: x), mean(lambda x, y: y), mean(lambda x, y: x * x), mean(lambda x, y: y * y), mean(lambda x, y: x * y)
            values.append((2 * a * b + 1e-4) * (2 * (ab - a * b) + 9e-4) / ((a * a + b * b + 1e-4) * (aa - a * a + bb - b * b + 9e-4)))
        assert abs(got[image] - sum(values) / len(values)) < 1e-9


def test_fused_metrics_scan_once(spark):
    rng = random.Random(3)
    rows = [(i, [rng.randrange(5) / 4 for _ in range(4)], rng.randrange(4)) for i in range(300)] + [(-1, [1.0, 0.0, 0.0, 0.0], 1), (999, None, 1)]
    df = spark.createDataFrame(rows, "index long, preds array<double>, target int")
    asked = {"a1": callables.accuracy(1), "a2": callables.accuracy(2, "macro"), "mrr": callables.reciprocal_rank(), "ce": callables.cross_entropy("macro"), "f1": callables.f1(), "f1m": callables.f1("micro")}
    out = callables.evaluate_fused(df, asked)
    got = {r.metric: r.value for r in out.collect()}
    used = rows[:300]
    place = [sorted(range(4), key=lambda c: (-p[c], c)).index(t) + 1 for _, p, t in used]
    by = lambda f: np.mean([np.mean([f(k) for k in range(300) if used[k][2] == c]) for c in range(4)])
    best = [min(range(4), key=lambda c: (-p[c], c)) for _, p, _ in used]
    f1 = [2 * sum(b == t == c for b, (_, _, t) in zip(best, used)) / sum((b == c) + (t == c) for b, (_, _, t) in zip(best, used)) for c in range(4)]
    want = {"a1": np.mean([p <= 1 for p in place]), "a2": by(lambda k: place[k] <= 2), "mrr": np.mean([1 / p for p in place]), "f1": np.mean(f1), "f1m": np.mean([b == t for b, (_, _, t) in zip(best, used)])}
    want["ce"] = by(lambda k: math.log(sum(map(math.exp, used[k][1]))) - used[k][1][used[k][2]])
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert {r.value for r in callables.evaluate_fused(df.limit(0), asked).collect()} == {None}


def test_depth_frames_there_and_back(spark):
    rows = [(1, 0, 0, 1.5), (1, 3, 1, 2.5), (2, 1, 1, 0.25), (2, 9, 9, 7.0), (2, 0, 1, None), (3, 0, 0, None)]
    frames = sinks.encode_depth_frames(spark.createDataFrame(rows, "image int, u int, v int, depth double"), 4, 2)
    got = {(r.path, r.u, r.v): r.depth for r in readers.explode_depth_frames(frames).collect()}
    assert len(got) == 16 and {k: v for k, v in got.items() if v} == {("1", 0, 0): 1.5, ("1", 3, 1): 2.5, ("2", 1, 1): 0.25}


def test_vocabulary_masks_and_groups(spark):
    objects = spark.createDataFrame([(1, "mug"), (1, "sofa"), (1, "ghost"), (1, None)], "scene long, cls string").withColumn("grp", F.lit("clash"))
    words = spark.createDataFrame([("mug", "manipulation"), ("mug", "other"), ("sofa", "other"), (None, "x")], "cls string, grp string")
    assert sorted((r.cls, r.grp) for r in X.with_vocabulary(objects, words).collect()) == [("mug", "manipulation"), ("sofa", "other")]
    assert X.with_vocabulary(objects, words, known_only=False).count() == 4
    seg = spark.createDataFrame([(3, 0.2), (3, 0.21), (94, 9.99), (94, 10.0), (14, 1.0), (None, 1.0), (3, None)], "cls int, d double")
    assert [r[0] for r in seg.select(G.class_mask(F.col("cls"), F.col("d"))).collect()] == [False, True, True, False, False, False, False]
    assert [r[0] for r in seg.select(G.class_mask(F.col("cls"), F.col("d"), G.DOOR_IDS)).collect()].count(True) == 1


def test_reach_goes_by_group_and_centres_are_capped(spark):
    cells = spark.createDataFrame([(1, x, 0) for x in range(8)], CELLS)
    source = spark.createDataFrame([(1, (0, 0))], "scene long, source struct<gx:long,gy:long>")
    tree = graphs.geodesic(graphs.both_ways(spatial.radius_edges(cells, 1.0), "dist"), source, 9.0)
    objects = spark.createDataFrame([(1, 10 * g + x, float(x), 0.0, "ab"[g]) for g in (0, 1) for x in range(8)], "scene long, obj long, gx double, gy double, grp string")
    got = graphs.reachable_objects(objects, cells, tree, {"a": (2.0, 4.0), "b": (0.5, 1.0)}).collect()
    assert sorted(r.obj for r in got) == [2, 3, 4, 11]
    points = spark.createDataFrame([(1, float(x)) for x in range(50)], "scene long, x double")
    centres = spark.createDataFrame([(1, float(x)) for x in range(0, 50, 10)], "scene long, x double")
    assert spatial.away_from(points, centres, 0.5, ["x"]).count() == 45
    assert spatial.away_from(points, centres, 0.5, ["x"], most=2, seed=3).count() == 48
