"""Centroids, token counts and whitening against plain versions: nulls, non-finite entries, other
lengths, ties, repeated rows, empty tables, clashing column names."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from posegrid.llm import centroids, singular, token_counts, whitening
from posegrid.llm.queries import piece_model

VEC = "vec_id long, embedding array<float>"


def _vectors(seed, n, dims):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(6, dims))
    rows = [(i, [float(x) for x in np.float32(middles[i % 6] + 0.2 * rng.normal(size=dims))]) for i in range(n)]
    odd = [None] + rows[0][1][1:], [math.nan] + rows[0][1][1:], [math.inf] + rows[0][1][1:]
    rows += [(900, None), (901, []), (902, rows[0][1][:-1]), *((903 + i, v) for i, v in enumerate(odd))]
    return rows + [(950 + i, rows[3][1]) for i in range(5)] + [rows[7], rows[7], (None, rows[8][1])]


def _kept(rows, dims, scale):
    good = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    return [(i, [math.floor(scale * x) for x in v]) for i, v in good]


def _plain_clusters(kept, k, rounds):
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    middles = [v for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(middles))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(middles)):
            members = [v for (_, v), o in zip(kept, own) if o == j]
            if members:
                middles[j] = [sum(col) // len(members) for col in zip(*members)]
    out = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    inertia = {j: sum(d for _, o, d in out if o == j) for j in range(len(middles))}
    prints = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middles]
    return sorted(((i, o, d, inertia[o], sum(inertia.values()), prints[o]) for i, o, d in out), key=str)


@pytest.mark.parametrize("k, pivots", [(7, 4), (200, 8), (3, 1)])
def test_clusters_equal_the_plain_ones(spark, k, pivots):
    rows = _vectors(5, 150, 8)
    df = spark.createDataFrame(rows, VEC).withColumn("id", F.lit("x")).withColumn("cluster", F.lit(9)).withColumn("apex", F.lit(1))
    got = centroids.cluster(df, k=k, dims=8, pivots=pivots, rounds=3)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == _plain_clusters(_kept(rows, 8, 256), k, 3)


def test_clusters_of_equal_and_of_no_vectors(spark):
    same = spark.createDataFrame([(i, [1.5] * 4) for i in range(9)], VEC)
    assert {(r.cluster, r.distance, r.inertia) for r in centroids.cluster(same, k=3, dims=4).collect()} == {(0, 0, 0)}
    none = centroids.cluster(spark.createDataFrame([(1, None)], VEC), k=3)
    assert none.count() == 0 and none.columns[0] == "vec_id"
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e9] * 64)], VEC), k=3).collect()


def test_bounds_hold_and_spare_distances():
    rng = np.random.default_rng(2)
    middles = rng.integers(-2000, 2000, (40, 64))
    x = middles[rng.integers(0, 40, 5000)] + rng.integers(-60, 60, (5000, 64))
    base = centroids.Simplex(middles)
    own, dist, done = centroids.nearest(x, base.apex(x), middles, base.apex(middles))
    every = ((x[:, None] - middles[None]) ** 2).sum(2)
    assert (own == every.argmin(1)).all() and (dist == every.min(1)).all()
    assert done < 0.1 * every.size
    line = np.outer(np.arange(12), np.ones(5, int)).astype(np.int64)  # one direction only: two pivots
    flat = centroids.Simplex(line)
    assert len(flat.pivots) == 2
    assert (centroids.nearest(line, flat.apex(line), line, flat.apex(line))[0] == np.arange(12)).all()
    half = np.array([[1, 0], [-1, 0]]), np.array([[0, 5]])  # equally near: the lower number
    tie = centroids.Simplex(half[0])
    assert centroids.nearest(half[1], tie.apex(half[1]), half[0], tie.apex(half[0]))[0].tolist() == [0]


def test_spliced_counts_equal_the_library():
    rng = random.Random(4)
    counter = token_counts.Counter(piece_model())
    assert counter.splits
    texts = ["a" * 3000, "ab" * 2000, "é" * 999, "\U0001f9ff" * 300, " " * 1500, "\x00" * 200, "<s></s>" * 90, "▁" * 500, "日本語" * 200]
    texts += ["".join(chr(rng.randrange(32, 0x3000)) for _ in range(2000)), "".join(rng.choice("ab \n") for _ in range(3000)), "x" * 700 + " y" * 300 + "z" * 700]
    texts += ["".join(rng.choice(["the ", "of", "ing ", "\t", "qu", "\U0001f600", "é"]) for _ in range(2000)) for _ in range(5)]
    for chunk, overlap in ((37, 5), (100, 1), (256, 32)):
        small = token_counts.Counter(piece_model(), chunk, overlap)
        for t in texts:
            assert small.count(t) == len(counter.library.encode(t)), (chunk, t[:20])


def test_token_counts(spark):
    texts = [None, "", " ", "one two", "one two", "x" * 30_000, "wörter " * 5_000]
    df = spark.createDataFrame([(i % 5, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).withColumn("lang", F.lit("en"))
    library = token_counts.Counter(piece_model()).library
    got = token_counts.token_counts(df, piece_model(), limit=3_800).select("doc_id", "lang", "n_bytes", "n_tokens", "over_limit")
    want = [(i % 5, "en", len((t or "").encode()), n := len(library.encode(t or "")), n > 3_800) for i, t in enumerate(texts)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert token_counts.token_counts(df.limit(0), piece_model()).count() == 0


def test_singular_directions():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((200, 24))
    lame = a.copy()
    lame[:, 3], lame[:, 5] = 0, lame[:, 7]
    apart = np.linalg.qr(rng.standard_normal((90, 24)))[0]
    spread = np.linalg.qr(rng.standard_normal((24, 24)))[0]
    cases = [a, lame, a * 10.0 ** -np.arange(0, 12, 0.5), np.eye(24) * 3, (apart * np.repeat([4, 3, 2, 1], 6)) @ spread.T, np.outer(a[:, 0], a[0])]
    for x, rank in zip(cases, [24, 22, 24, 24, 24, 1]):
        r = np.linalg.qr(x, mode="r")
        square, v = singular.right_directions(r)
        want = np.linalg.svd(r, compute_uv=False) ** 2
        assert len(square) == rank and np.allclose(square, want[:rank], rtol=1e-11)
        assert np.abs(v.T @ v - np.eye(rank)).max() < 1e-10
        assert np.linalg.norm(r.T @ (r @ v) - v * square) < 1e-10 * want[0]
    assert singular.right_directions(np.zeros((3, 3)))[1].shape == (3, 0)


@pytest.mark.parametrize("dims, far", [(8, 0.0), (30, 4000.0)])
def test_whitening_equals_the_plain_one(spark, dims, far):
    rows = [(i, v and [None if x is None else x + far for x in v]) for i, v in _vectors(6, 200, dims)]
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = whitening.whiten(spark.createDataFrame(rows, VEC).withColumn("x", F.lit(1)).withColumn("k", F.lit(2)).repartition(40))
    kept = [(i, [x + 1_000_000 for x in v]) for i, v in _kept(rows, dims, 64)]
    fit = np.array(sorted({tuple(v) for _, v in kept}), object)
    n, sums = len(fit), fit.sum(0)
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in fit], float)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    out = got.collect()
    by = {(r.vec_id, r.component): r for r in out}
    assert len(out) == len(kept) * min(16, dims)
    for i, v in kept:
        gap = [n * a - s for a, s in zip(v, sums)]
        w = np.array([g / n for g in gap]) @ u / np.sqrt(e)
        for k in range(min(16, dims)):
            r = by[i, k + 1]
            assert r.n == n and r.deviation == sum(g * g for g in gap) and r.identity_error < 1e-8
            assert abs(abs(r.whitened) - abs(w[k])) < 1e-7 and abs(r.explained / (e[k] / e.sum()) - 1) < 1e-9


def test_whitening_without_variance(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(spark.createDataFrame(rows, VEC)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], VEC)).collect()
    assert sorted((r.vec_id, r.component, round(r.whitened, 9)) for r in one) in ([(1, 1, -1.0), (2, 1, 1.0)], [(1, 1, 1.0), (2, 1, -1.0)])
