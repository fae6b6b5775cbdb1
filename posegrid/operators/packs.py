"""Neighbourhood work on places, by tiles: one shuffle, and no row for each pair of neighbours.

Places go to the tile of their cell, and to those that they border. A task takes its tiles, sorted, in
packs of many, so that neither the shuffle nor the calls grow with pairs or with scenes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells along a side of a tile.
SIDE = 64
#: Rows of a pack (one more tile may follow), tiles of a pack, and pairs that are held at a time.
ROWS, TILES, PAIRS = 1 << 17, 1 << 12, 1 << 21


def _groups(table: pa.Table, keys: list[str]) -> np.ndarray:
    """The number of each row's group, of rows sorted by keys."""
    n, new = table.num_rows, np.zeros(table.num_rows, bool)
    for k in keys:
        c = table[k].combine_chunks()
        new[1:] |= pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, n - 1)), True).to_numpy(zero_copy_only=False)
    return np.cumsum(new)


def in_packs(rows: DataFrame, keys: list[str], order: list[str], run: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """What run makes of rows in packs of whole groups of keys, sorted by keys and order; it also gets
    the number of each row's group."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(table: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.searchsorted(group, np.arange(0, group[-1] + TILES, TILES))
            for a, b in zip(cuts, [*cuts[1:], len(group)]):
                if b > a:
                    yield from run(table.slice(a, b - a), group[a:b] - group[a]).combine_chunks().to_batches(max_chunksize=1 << 15)

        held, n, full = [], 0, ROWS
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= full:
                table = pa.Table.from_batches(held).combine_chunks()
                group = _groups(table, keys)
                last = int(np.searchsorted(group, group[-1]))
                if last:
                    yield from out(table.slice(0, last), group[:last])
                held, n = table.slice(last).to_batches(), n - last
                full = max(ROWS, 2 * n)
        if n:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from out(table, _groups(table, keys))

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(task, schema)


def dealt(places: DataFrame, size: float, dims: list[str], halo: int, keys: list[str], only: str = "true") -> tuple[DataFrame, list[str]]:
    """places with their tile (the columns named second), once for their own tile (_own) and, where
    `only` holds, for each tile within halo cells of `size`; _copied: more than one. Rows with a null
    among keys and dims (_whole is false) go to one tile. Tiles are shifted by the halo, so that places
    from 0 on do not border on one before."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, *dims]])
    names, out = [f"_t{i}" for i in range(len(dims))], places.withColumn("_whole", whole)
    at = lambda d, by: F.floor((F.floor(F.col(d) / F.lit(float(size))).cast("long") + halo + by) / SIDE).cast("long")
    own, copied, copies = F.lit(True), F.lit(False), F.col("_whole") & F.expr(only)
    for name, d in zip(names, dims):
        span = F.when(copies, F.sequence(at(d, -halo), at(d, halo))).when(F.col("_whole"), F.array(at(d, 0))).otherwise(F.array(F.lit(0).cast("long")))
        out = out.withColumn(name, F.explode(span))
        own = own & F.coalesce(F.col(name) == at(d, 0), F.lit(True))
        copied = copied | (copies & (at(d, -halo) != at(d, halo)))
    return out.withColumns({"_own": own, "_copied": F.coalesce(copied, F.lit(False))}), names


class Grid:
    """The cells of a pack's rows. Rows are named by their place in the pack."""

    def __init__(self, table: pa.Table, group: np.ndarray, size: float, dims: list[str], tiles: list[str], halo: int, among: np.ndarray | None = None):
        self.at = [table[d].to_numpy() for d in dims]
        self.halo, self.wide = halo, SIDE + 4 * halo
        self.cell = [np.floor(x / float(size)).astype(np.int64) - table[t].to_numpy() * SIDE + 2 * halo for x, t in zip(self.at, tiles)]
        key = group.astype(np.int64)
        for c in self.cell:
            key = key * self.wide + c
        self.key = key
        rows = np.arange(len(key)) if among is None else np.flatnonzero(among)
        self.order = rows[np.argsort(key[rows], kind="stable")]
        self.sorted = key[self.order]

    def within(self, by: int) -> np.ndarray:
        """Rows in the tile, or at most so many cells beside it."""
        return reduce(lambda a, b: a & b, [(c >= self.halo - by) & (c < self.halo + SIDE + by) for c in self.cell])

    def pairs(self, rows: np.ndarray, around: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, other, squared distance) of rows and all others at most so many cells away in each dimension."""
        for step in product(range(-around, around + 1), repeat=len(self.cell) - 1):
            by = reduce(lambda a, b: (a + b) * self.wide, step, 0)
            low = np.searchsorted(self.sorted, self.key[rows] + (by - around), "left")
            n = np.searchsorted(self.sorted, self.key[rows] + (by + around), "right") - low
            some = np.flatnonzero(n)
            upto, a = np.cumsum(n[some]), 0
            while a < len(some):
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
                cut = some[a:b]
                i, start = np.repeat(cut, n[cut]), np.cumsum(n[cut]) - n[cut]
                j = self.order[low[i] + np.arange(len(i)) - np.repeat(start, n[cut])]
                i = rows[i]
                yield i, j, reduce(lambda s, t: s + t, [(x[i] - x[j]) * (x[i] - x[j]) for x in self.at])
                a = b


def kinds(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
