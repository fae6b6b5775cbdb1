"""An object registry from detections: the first seen of what lies together stays."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import product
from math import dist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, StructField, StructType

from posegrid.operators import packs
from posegrid.session import discard, materialise, ship

#: What a pass says of a row: open, kept, kept and near another tile, near nothing as it has no place.
OPEN, KEPT, EDGE, LOOSE = range(4)
#: Open rows that a cell remembers; with more, all later ones around it stay open too.
MOST = 256


def _deciding(keys: list[str], tiles: list[str], dims: list[str], names: list[str], radius: float, side: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass over rows sorted by keys, tile and order, which remembers the rows it kept or left open
    in the tile it is in, by the cells they reach: of kept ones there are as many as have room."""
    wide, room = side + 4, MOST
    steps = [reduce(lambda a, b: a * wide + b, s) for s in product((-1, 0, 1), repeat=len(dims))]
    least, limit, most = radius * (1 - 1e-9), radius**2, radius * (1 + 1e-9)

    def near(p: tuple[float, ...], places: list[tuple[float, ...]]) -> bool:
        for q in places:
            gap = dist(p, q)
            if gap < least or (gap <= most and sum([(a - b) * (a - b) for a, b in zip(p, q)]) <= limit):
                return True
        return False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {}
        left: dict[int, list] = {}
        last = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            group = packs._groups(pa.Table.from_batches([batch] if last is None else [last, batch]), [*keys, *tiles])[-n:]
            last, now = batch.slice(n - 1), 0
            whole, own, copied, before = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_whole", "_own", "_copied", "_state"))
            at = [batch.column(d).cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False) for d in dims]
            cell = np.zeros(n, np.int64)
            for x, t in zip(at, tiles):
                cell = cell * wide + np.where(whole, np.floor(np.where(whole, x, 0.0) / radius).astype(np.int64) - batch.column(t).to_numpy() * side + 2, 0)
            out = np.where(whole, -1, LOOSE).astype(np.int8)
            some = np.flatnonzero(whole)
            for i, g, c, mine, done, *p in zip(some.tolist(), *[x[some].tolist() for x in (group, cell, own, before != OPEN, *at)]):
                if g != now:
                    now, kept, left = g, {}, {}
                if done:
                    seen = kept
                elif near(p, kept.get(c, ())):
                    continue
                else:
                    around = left.get(c, ())
                    seen = left if not mine or len(around) >= room or near(p, around) else kept
                    if mine:
                        out[i] = OPEN if seen is left else EDGE if copied[i] else KEPT
                for s in steps:
                    places = seen.setdefault(c + s, [])
                    if seen is kept or len(places) < room:
                        places.append(p)
            said = out >= 0
            if said.any():
                rows = batch.select(names).filter(pa.array(said))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out[said])], [*names, "_state"])

    return run


def first_seen(objects: DataFrame, radius: float, order: list[str], keys: list[str] = ["scene", "cls"], dims: list[str] = ["x", "y", "z"]) -> DataFrame:  # noqa: B006
    """Detections kept when, in the given order, later ones of the same keys within radius of a kept
    one are dropped; of rows that the order doesn't tell apart the least in all columns comes first.
    Rows with a null key or a coordinate that is null or not finite lie near nothing and stay; equal
    rows come once.

    The result is the lexicographically first maximal independent set, found tile by tile. Rows are
    shuffled once to tiles of 64 x 64 cells of the radius, those within a cell of a border also to the
    tile beyond it, and a tile's rows pass in order: one near a kept one is dropped, one that an
    earlier row of another tile may drop, or one that waits for such a row, stays open, and all others
    are kept. Only what is open, and what was kept at borders, goes into a next pass; there are about
    as many as the longest chain of rows that wait for each other crosses borders. Each pass is
    written to the shared folder. No pairs of rows are made, and nothing is broadcast.
    """
    spark, names, radius = objects.sparkSession, objects.columns, float(radius)
    ship(spark)
    rest = [c for c in names if c not in order and c not in keys]
    places = [f"_p{i}" for i in range(len(dims))]
    schema = StructType([*objects.schema.fields, StructField("_state", ByteType())])
    rows, done, gone = objects.withColumn("_state", F.lit(OPEN).cast("byte")), [], []
    while True:
        finite = {p: F.when(~F.isnan(F.col(d).cast("double")) & (F.abs(F.col(d).cast("double")) < float("inf")), F.col(d).cast("double")) for p, d in zip(places, dims)}
        near, tiles = packs.dealt(rows.withColumns(finite), radius, places, 1, keys)
        near = near.where(f"NOT (_own AND _state = {EDGE})").drop(*places)
        near = near.withColumn(tiles[0], F.when(F.col("_whole"), F.col(tiles[0])).otherwise(F.pmod(F.xxhash64(*names), F.lit(1 << 16))))
        near = near.repartition(*keys, *tiles).sortWithinPartitions(*keys, *tiles, *[c for c in order if c not in keys], *rest)
        done.append(materialise(near.mapInArrow(_deciding(keys, tiles, dims, names, radius, packs.SIDE), schema), "first-seen"))
        left, edge = (materialise(done[-1].where(F.col("_state") == state), name) for state, name in ((OPEN, "open"), (EDGE, "edge")))
        over, rows = left.isEmpty(), left.unionByName(edge)
        gone += [left, edge]
        for table in gone if over else gone[:-2]:
            discard(table)
        gone = gone[-2:]
        if over:
            break
    out = reduce(DataFrame.unionByName, done)
    return out.where(F.col("_state").isin(KEPT, EDGE)).select(*names).unionByName(done[0].where(F.col("_state") == LOOSE).select(*names).dropDuplicates())
