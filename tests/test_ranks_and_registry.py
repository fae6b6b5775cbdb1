"""Ranks without a global window, and the first-seen registry, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from posegrid.operators import sampling, trajectories
from posegrid.operators.ranks import numbered, numbered_within, pieces
from posegrid.operators.registry import first_seen

OBJECTS = "scene long, cls string, seq long, x double, y double, z double"


def _greedy(rows, radius):
    kept = {}
    for r in sorted(rows, key=lambda r: r[2:]):
        near = kept.setdefault(r[:2], [])
        if all(sum((a - b) ** 2 for a, b in zip(r[3:], k[3:])) > radius**2 for k in near):
            near.append(r)
    return sorted(r for rs in kept.values() for r in rs)


@pytest.mark.parametrize("along", [False, True])
def test_first_seen_is_the_greedy_choice(spark, along):
    rng = random.Random(8)
    rows = []
    for i in range(2_000):
        x = i / 200 if along else rng.uniform(0, 30)  # along: each depends on the one before
        rows.append((i % 2, "ab"[i % 3 // 2], rng.randrange(10**6) if not along else i, x, rng.uniform(0, 6), rng.uniform(0, 2)))
    rows += rows[:50] + [(0, "a", 5, 1.0, 1.0, 1.0), (0, "a", 5, 1.25, 1.0, 1.0)]
    got = first_seen(spark.createDataFrame(rows, OBJECTS).repartition(5), 1.5, ["seq"])
    assert got.columns == ["scene", "cls", "seq", "x", "y", "z"]
    assert sorted(map(tuple, got.collect())) == _greedy(set(rows), 1.5)
    assert "applyInPandas" not in got._jdf.queryExecution().toString()


def test_first_seen_of_nulls_and_of_nothing(spark):
    rows = [(1, "a", 1, None, 0.0, 0.0), (None, "a", 2, 0.0, 0.0, 0.0), (1, "a", 3, 0.0, 0.0, 0.0), (1, "a", 4, 0.0, 0.0, 0.0)]
    got = first_seen(spark.createDataFrame(rows, OBJECTS), 1.0, ["seq"])
    assert sorted(r.seq for r in got.collect()) == [1, 2, 3]
    assert first_seen(spark.createDataFrame([], OBJECTS), 1.0, ["seq"]).count() == 0


def test_places_follow_the_order(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(10**9), i) for i in range(3_000)]
    df = spark.createDataFrame(rows, "k string, v long, i long").repartition(7)
    out = numbered(df, ["v", "i"])
    assert [r.i for r in out.orderBy("place").collect()] == [i for _, _, i in sorted(rows, key=lambda r: r[1:])]
    assert sorted(r.place for r in out.collect()) == list(range(3_000))
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    own = {}
    for r in numbered_within(df, ["k"], ["v", "i"]).collect():
        own.setdefault(r.k, []).append((r.place, r.v, r.i))
    for k, seen in own.items():
        assert [(v, i) for _, v, i in sorted(seen)] == sorted((v, i) for key, v, i in rows if key == k)
        assert sorted(p for p, _, _ in seen) == list(range(len(seen)))
    assert numbered(df.limit(0), ["v"]).count() == 0


def test_pieces_carry_a_halo(spark):
    df = spark.createDataFrame([("a", i) for i in range(100)] + [("b", 1)], "k string, i long")
    got = pieces(df, ["k"], ["i"], halo=3, size=10).collect()
    for p in range(1, 10):
        assert sorted((r.i, r._halo) for r in got if r.k == "a" and r._piece == p) == [(10 * p - 3 + j, j < 3) for j in range(13)]
    assert sum(not r._halo for r in got) == 101


def test_smoothed_values_do_not_depend_on_pieces(spark):
    rng = random.Random(5)
    rows = [("a" if i % 7 else None, i, rng.uniform(-5, 5) if i % 11 else None) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, i long, v double")
    for size in (19, 64, 10_000):
        got = {r.i: r for r in trajectories.smoothed_value(df, "k", "v", ["i"], 20, size).collect()}
        assert len(got) == len(rows)
        for key in ("a", None):
            past = []
            for _, i, v in [r for r in rows if r[0] == key]:
                past.append(v)
                held = sorted(x for x in past[-20:] if x is not None)
                every = [x for x in past if x is not None]
                assert got[i].median == (held[(len(held) - 1) // 2] if held else None)
                assert got[i].most == (max(held) if held else None)
                assert (got[i].mean is None) == (not held) and (not held or abs(got[i].mean - sum(held) / len(held)) < 1e-9)
                assert (got[i].global_mean is None) == (not every) or abs(got[i].global_mean - sum(every) / len(every)) < 1e-9


def test_plans_follow_their_table(spark):
    items = spark.createDataFrame([(3 * i,) for i in range(50)], "id long")
    plan = sampling.epoch_plan(items, "id", 4, size=120, seed=2).collect()
    assert sorted(r.i for r in plan) == list(range(120)) and all(r.worker == r.i % 4 for r in plan)
    assert sorted(r["item"] for r in plan) == sorted([3 * (i % 50) for i in range(120)])
    assert sampling.epoch_plan(items, "id", 4).count() == 50
    assert [r["item"] for r in sampling.infinite_plan(items, "id", 2, 70, 3).orderBy("i").collect()] == [3 * i for i in range(20, 50)]
    shards = sampling.sharded_plan(items, "id", 2, 3, 1).collect()
    for p in (0, 1):
        for w in range(3):
            assert sorted(r.place for r in shards if r["pass"] == p and r.worker == w) == list(range(16))
    assert len({r["item"] for r in shards}) == 48
    assert sampling.shard(items.withColumn("x", F.lit(1)), ["id"], 3).where("shard = id % 9 / 3").count() == 50
