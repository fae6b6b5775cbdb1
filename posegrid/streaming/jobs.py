"""Structured Streaming operators. Each takes and returns a streaming DataFrame; the caller starts it.

Rows older than the watermark are dropped by Spark. Stateful operators fold all rows that a
micro-batch has of a key in the order of their numbers, however many Arrow batches they come in.
Column late counts the rows passed over: repeats, and numbers so low that the operator no longer
holds what was beside them. No state depends on the wall clock. `count_windows` and
`object_registry` need Spark's RocksDB state store, see `use_rocksdb`.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from posegrid.streaming.processors import CountWindows, FirstSeen

STEP = "episode long, step long, tick long, x double, y double"


def use_rocksdb(spark: SparkSession) -> None:
    """Queries started from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def first_wins(logs: DataFrame, keys: list[str], ts: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Log rows, the first of each key. With a time column the state is bounded by the watermark."""
    if ts is None:
        return logs.dropDuplicates(keys)
    return logs.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def _stateful(df: DataFrame, keys: list[str], fn, out: str, state: str) -> DataFrame:
    return df.groupBy(*keys).applyInPandasWithState(fn, out, state, "append", GroupStateTimeout.NoTimeout)


def _ordered(batches: Iterator[pd.DataFrame], by: str, columns: list[str]) -> pd.DataFrame:
    """All of a key's rows of one micro-batch, sorted: Spark cuts a group at any row."""
    frames = [*batches] or [pd.DataFrame(columns=[by, *columns])]
    return pd.concat(frames, ignore_index=True).sort_values(by, kind="stable")[columns]


def count_windows(rows: DataFrame, key: str, n: int, idle: str = "6 hours", delay: str = "0 seconds") -> DataFrame:
    """key, window, rows, total: a row every n values of a key (columns key, seq, value, ts), and one
    for a shorter window once the watermark is `idle` past its last value, so also for the last
    window when the input ends with a row that moves the watermark (any key, also null)."""
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    d = rows.select(F.col(key).cast("string").alias("key"), "seq", "value", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    return d.groupBy("key").transformWithStateInPandas(CountWindows(n, ms), "key string, window long, rows long, total double", "append", "EventTime")


def sliding_meter(rows: DataFrame, key: str, n: int = 20) -> DataFrame:
    """key, seq, median (lower), mean, most of the last n values up to seq; late: rows passed over so
    far. A row that comes after later ones is put in its place among the last n."""

    def fold(k, batches: Iterator[pd.DataFrame], state: GroupState):
        late, seqs, values = state.get if state.exists else (0, [], [])
        seqs, values, full, out = list(seqs), list(values), len(seqs) == n, []
        for s, v in _ordered(batches, "seq", ["seq", "value"]).itertuples(index=False):
            at = bisect.bisect_left(seqs, s)
            if (at < len(seqs) and seqs[at] == s) or (not at and full):
                late += 1
                continue
            seqs.insert(at, int(s))
            values.insert(at, float(v))
            held = values[max(0, at + 1 - n) : at + 1]
            out.append((k[0], int(s), sorted(held)[(len(held) - 1) // 2], sum(held) / len(held), max(held), late))
            if len(seqs) > n:
                del seqs[0], values[0]
            full = len(seqs) == n
        state.update((late, seqs, values))
        yield pd.DataFrame(out, columns=["key", "seq", "median", "mean", "most", "late"])

    return _stateful(rows.select(F.col(key).cast("string").alias("key"), "seq", "value"), ["key"], fold, "key string, seq long, median double, mean double, most double, late long", "late long, seqs array<long>, values array<double>")


def stuck_detector(steps: DataFrame, states: int = 4, reach: float = 0.1, turn: int = 1) -> DataFrame:
    """episode, step, late: the first step found at which an episode is stuck over its last states. A
    step that comes after later ones is put in its place among the last ones."""

    def fold(k, batches: Iterator[pd.DataFrame], state: GroupState):
        late, done, at, xs, ys, ts = state.get if state.exists else (0, False, [], [], [], [])
        at, xs, ys, ts, out = list(at), list(xs), list(ys), list(ts), []
        for s, t, x, y in _ordered(batches, "step", ["step", "tick", "x", "y"]).itertuples(index=False):
            i = bisect.bisect_left(at, s)
            if (i < len(at) and at[i] == s) or (not i and len(at) == states):
                late += 1
                continue
            for held, v in ((at, int(s)), (xs, float(x)), (ys, float(y)), (ts, int(t))):
                held.insert(i, v)
                del held[:-states]
            if not done and len(xs) == states and round(((xs[-1] - xs[0]) ** 2 + (ys[-1] - ys[0]) ** 2) ** 0.5, 6) <= reach and abs((ts[-1] - ts[0] + 12) % 24 - 12) <= turn:
                done = True
                out.append((int(k[0]), at[-1], late))
        state.update((late, done, at, xs, ys, ts))
        yield pd.DataFrame(out, columns=["episode", "step", "late"])

    return _stateful(steps.select("episode", "step", "tick", "x", "y"), ["episode"], fold, "episode long, step long, late long", "late long, done boolean, steps array<long>, xs array<double>, ys array<double>, ts array<long>")


def object_registry(objects: DataFrame, radius: float, ttl_ms: int | None = None) -> DataFrame:
    """scene, cls, x, y, z of objects that no earlier one of the class lies within radius of (columns
    seq, x, y, z). With ttl_ms an object is forgotten so long after it was written, by the clock."""
    rows = objects.select(F.col("scene").alias("_scene"), F.col("cls").alias("label"), "seq", "x", "y", "z").groupBy("_scene")
    return rows.transformWithStateInPandas(FirstSeen(radius, ttl_ms), "scene long, cls string, x double, y double, z double", "append", "None" if ttl_ms is None else "ProcessingTime")


def voxel_map(points: DataFrame, size: float) -> DataFrame:
    """scene, vx, vy, vz, n, sx, sy, sz: running counts and sums of voxels (update mode)."""
    v = lambda c: F.floor(F.col(c) / F.lit(size)).cast("long").alias(f"v{c}")
    return points.groupBy("scene", v("x"), v("y"), v("z")).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{c}") for c in "xyz"])


def history_folding(rounds: DataFrame, recent: int = 16) -> DataFrame:
    """conv_id, turn: rounds as they leave the last `recent` for the older list (columns conv_id, turn)."""

    def fold(k, batches: Iterator[pd.DataFrame], state: GroupState):
        late, held, gone = state.get if state.exists else (0, [], [])
        held, gone, out = list(held), list(gone), []
        known = {*held, *gone}
        for t in map(int, _ordered(batches, "turn", ["turn"])["turn"]):
            if t in known:
                late += 1
                continue
            known.add(t)
            bisect.insort(held, t)
            if len(held) > recent:
                gone.append(held.pop(0))
                out.append((int(k[0]), gone[-1], late))
        state.update((late, held, gone))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "late"])

    return _stateful(rounds.select("conv_id", "turn"), ["conv_id"], fold, "conv_id long, turn long, late long", "late long, held array<long>, gone array<long>")


def run_summary(results: DataFrame) -> DataFrame:
    """One row of means and count over all finished episodes (complete mode)."""
    return results.groupBy().agg(F.avg("success").alias("success"), F.avg("spl").alias("spl"), F.avg("ne").alias("ne"), F.count("*").alias("n"))
