"""Stateful processors: an object registry in map state by grid cell, and windows of n rows that a
timer closes. Spark keeps their state in RocksDB, beyond memory, and reads what a row asks for."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def _all_rows(frames: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    """A key's rows of one micro-batch in order, however many Arrow batches they came in."""
    return pd.concat([*frames], ignore_index=True).sort_values(by, kind="stable")


#: Cells along a side of a block, the unit in which the registry's places are kept.
BLOCK = 8
_AROUND = [*product((-1, 0, 1), repeat=3)]


class FirstSeen(StatefulProcessor):
    """Objects (seq, cls, x, y, z) of a scene that none of their class kept before lies within radius of.
    State: by block of a grid of the radius, BLOCK cells a side, the classes and places kept there. A
    row reads its block and, at its border, the next ones, each once a batch; blocks that changed are
    written once a batch. So neither calls nor state entries go by class, of which a scene has many."""

    def __init__(self, radius: float, ttl_ms: int | None = None):
        self.radius, self.ttl_ms = radius, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.blocks = handle.getMapState("blocks", "a long, b long, c long", "names array<string>, xyz array<double>", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known, radius, least = self.blocks.exists(), self.radius, self.radius**2
        kept: dict[tuple, tuple[list, list[float]]] = {}
        near: dict[tuple, list[float]] = {}
        fresh, out = set(), []

        def cell(*at: float) -> tuple:
            return tuple(math.floor(v / radius) for v in at)

        def read(block: tuple) -> None:
            was = self.blocks.getValue(block) if known else None
            kept[block] = ([], []) if was is None else ([*was[0]], [float(v) for v in was[1]])
            names, flat = kept[block]
            for i, name in enumerate(names):
                near.setdefault((name, *cell(*flat[3 * i : 3 * i + 3])), []).extend(flat[3 * i : 3 * i + 3])

        for name, x, y, z in _all_rows(rows, "seq")[["label", "x", "y", "z"]].itertuples(index=False):
            name = name if isinstance(name, str) else None
            a, b, c = cell(x, y, z)
            for block in {*product(*[((v - 1) // BLOCK, (v + 1) // BLOCK) for v in (a, b, c)])} - kept.keys():
                read(block)
            free = True
            for i, j, k in _AROUND:
                flat = near.get((name, a + i, b + j, c + k))
                if flat and any((flat[i] - x) ** 2 + (flat[i + 1] - y) ** 2 + (flat[i + 2] - z) ** 2 <= least for i in range(0, len(flat), 3)):
                    free = False
                    break
            if free:
                block = (a // BLOCK, b // BLOCK, c // BLOCK)
                kept[block][0].append(name)
                kept[block][1].extend((float(x), float(y), float(z)))
                near.setdefault((name, a, b, c), []).extend((float(x), float(y), float(z)))
                fresh.add(block)
                out.append((int(key[0]), name, float(x), float(y), float(z)))
        for block in fresh:
            self.blocks.updateValue(block, kept[block])
        yield pd.DataFrame(out, columns=["scene", "cls", "x", "y", "z"])

    def close(self) -> None:
        pass


class CountWindows(StatefulProcessor):
    """A row for every n values (seq, value, ts) of a key, and for a shorter window once no value
    came for `idle` milliseconds of event time. A gap within a batch closes a window as the timer
    does between batches, so the result doesn't depend on how rows are dealt to batches."""

    def __init__(self, n: int, idle: int):
        self.n, self.idle = n, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "window long, count long, total double, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = _all_rows(rows, "seq")
        if key[0] is None:  # rows without a key only move the watermark
            return iter(())
        window, count, total, last = self.open.get() if self.open.exists() else (0, 0, 0.0, None)
        for timer in [*self.handle.listTimers()]:
            self.handle.deleteTimer(timer)
        out = []
        for value, ms in zip(frames["value"], frames["ts"].astype("datetime64[ms]").astype("int64")):
            if count and last is not None and ms - last > self.idle:
                out.append((key[0], window, count, total))
                window, count, total = window + 1, 0, 0.0
            count, total, last = count + 1, total + float(value), int(ms) if last is None else max(last, int(ms))
            if count == self.n:
                out.append((key[0], window, count, total))
                window, count, total = window + 1, 0, 0.0
        self.open.update((window, count, total, last))
        if count:
            self.handle.registerTimer(last + self.idle)
        return iter([pd.DataFrame(out, columns=["key", "window", "rows", "total"])])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        window, count, total, last = self.open.get()
        self.open.update((window + 1, 0, 0.0, last))
        yield pd.DataFrame([(key[0], window, count, total)] if count else [], columns=["key", "window", "rows", "total"])

    def close(self) -> None:
        pass
