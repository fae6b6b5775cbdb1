"""Stateful streaming operators on groups of several Arrow batches, in no order."""

import datetime
import random

import pandas as pd

from posegrid.operators.registry import first_seen
from posegrid.plans.streams import streamed
from posegrid.streaming import jobs


def test_groups_of_many_arrow_batches_lose_no_rows(spark):
    n, rng = 3_500, random.Random(9)
    order = rng.sample(range(n), n)
    chat = spark.createDataFrame([(1, t) for t in order], "conv_id long, turn long").coalesce(1)
    day = datetime.datetime(2024, 1, 1)
    events = spark.createDataFrame([("a", s, float(s), day) for s in order], "event_type string, seq long, value double, ts timestamp").coalesce(1)
    objects = spark.createDataFrame([(1, "c", s, s * 2.0 / 3, 0.0, 0.0) for s in order[:1_500]], "scene long, cls string, seq long, x double, y double, z double").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        history = streamed(chat, lambda s: jobs.history_folding(s, 2)).collect()
        meter = streamed(events, lambda s: jobs.sliding_meter(s, "event_type")).collect()
        windows = streamed(events, lambda s: jobs.count_windows(s, "event_type", 50)).collect()
        registry = streamed(objects, lambda s: jobs.object_registry(s, 50.0)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((r.turn, r.late) for r in history) == [(t, 0) for t in range(n - 2)]
    assert sorted((r.seq, r.most, r.median, r.late) for r in meter) == [(s, s, max(0, s - 19) + min(s, 19) // 2, 0) for s in range(n)]
    assert sorted((r.window, r.total) for r in windows) == [(w, sum(range(50 * w, 50 * w + 50))) for w in range(n // 50)]
    kept = []
    for s in sorted(order[:1_500]):
        if all(abs(s * 2.0 / 3 - x) > 50 for x in kept):
            kept.append(s * 2.0 / 3)
    assert sorted(r.x for r in registry) == kept


def test_windows_and_registry_of_several_micro_batches_equal_the_batch_twin(spark):
    rng, day = random.Random(4), datetime.datetime(2024, 1, 1)
    rows = [(rng.choice("ab"), s, float(rng.randrange(100)), day + datetime.timedelta(minutes=s)) for s in range(400)]
    schema = "event_type string, seq long, value double, ts timestamp"
    parts = [spark.createDataFrame(rows[a : a + 90], schema) for a in range(0, 400, 90)]
    end = spark.createDataFrame([(None, 0, 0.0, day + datetime.timedelta(days=9))], schema)
    got = streamed(parts[0], lambda s: jobs.count_windows(s, "event_type", 30, "1 day"), last=end, batches=parts).collect()
    want = []
    for key in "ab":
        values = [v for k, _, v, _ in rows if k == key]
        want += [(key, w, len(values[30 * w : 30 * w + 30]), sum(values[30 * w : 30 * w + 30])) for w in range(-(-len(values) // 30))]
    assert sorted(map(tuple, got)) == want and any(n < 30 for _, _, n, _ in want)
    # a gap of more than `idle` closes a window, within a batch as between two
    late = [("a", s, 1.0, day + datetime.timedelta(days=d)) for s, d in enumerate((0, 0, 5, 5, 20))]
    for cut in ([late], [late[:2], late[2:4], late[4:]]):
        parts = [spark.createDataFrame(p, schema) for p in cut]
        got = streamed(parts[0], lambda s: jobs.count_windows(s, "event_type", 30, "1 day"), last=spark.createDataFrame([(None, 0, 0.0, day + datetime.timedelta(days=90))], schema), batches=parts)
        assert sorted((r.window, r.rows) for r in got.collect()) == [(0, 2), (1, 2), (2, 1)]
    objects = [(1, rng.choice("cd"), s, rng.uniform(0, 9), rng.uniform(0, 9), rng.uniform(0, 2)) for s in range(600)]
    shape = "scene long, cls string, seq long, x double, y double, z double"
    parts = [spark.createDataFrame(objects[a : a + 250], shape) for a in range(0, 600, 250)]
    got = streamed(parts[0], lambda s: jobs.object_registry(s, 1.0), batches=parts)
    twin = first_seen(spark.createDataFrame(objects, shape), 1.0, ["seq"]).drop("seq")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, twin.collect()))


class _State(dict):
    exists, get = False, False

    def update(self, value):
        self.exists, self.get = True, value


class _Rows:
    def select(self, *_):
        return self


def _folds(job, key, batches):
    """The rows of a state function, micro-batch by micro-batch."""
    real, jobs._stateful = jobs._stateful, lambda df, keys, fn, out, state: fn
    try:
        fold = job(_Rows())
    finally:
        jobs._stateful = real
    state = _State()
    return [[tuple(r) for out in fold((key,), iter([pd.DataFrame(b)]), state) for r in out.itertuples(index=False)] for b in batches]


def test_history_takes_turns_that_come_in_a_later_micro_batch():
    seen = _folds(lambda r: jobs.history_folding(r, 2), 1, [{"turn": t} for t in ([5, 6, 7], [1, 5, 8], [1, 2])])
    assert [t for batch in seen for _, t, _ in batch] == [5, 1, 6, 2]


def test_meter_and_stuck_put_late_rows_in_their_place(spark):
    meter = _folds(lambda r: jobs.sliding_meter(r, "event_type", 3), "a", [{"seq": s, "value": v} for s, v in (([1, 2, 4], [1.0, 2.0, 4.0]), ([3, 4, 5], [3.0, 9.0, 5.0]), ([1, 6], [7.0, 6.0]))])
    assert [(s, med, most, late) for _, s, med, _, most, late in meter[1]] == [(3, 2.0, 3.0, 0), (5, 4.0, 5.0, 1)]
    assert [(s, med, late) for _, s, med, _, _, late in meter[2]] == [(6, 5.0, 2)]  # 1 is no longer among the last three
    step = lambda at: {"step": at, "tick": [0] * len(at), "x": [max(0.0, 5.0 - 2 * s) if s < 3 else 0.0 for s in at], "y": [0.0] * len(at)}
    assert _folds(jobs.stuck_detector, 7, [step([0, 1, 3, 4, 6]), step([5, 5])]) == [[], [(7, 6, 0)]]
