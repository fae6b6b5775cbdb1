"""Work on cells and what lies around them, by tiles: each cell goes to its tile and to those that it
borders, in one shuffle, and a task takes one tile with its border as a small grid."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells along a side of a tile.
SIDE = 64


def by_tiles(cells: DataFrame, halo: int, run: Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]], extra: str = "") -> DataFrame:
    """scene, gx, gy and `extra` columns of all tiles. cells: scene, gx, gy (whole numbers), kind (int).
    run gets x, y (places in a grid of SIDE + 2 halo) and kind, and gives columns x, y and the extra ones;
    of these the places in the tile itself are kept."""
    scene = cells.schema["scene"].dataType.simpleString()
    low = lambda c: F.floor((F.col(c) - halo) / SIDE).cast("long")
    high = lambda c: F.floor((F.col(c) + halo) / SIDE).cast("long")
    dealt = cells.select("scene", F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy"), "kind")
    dealt = dealt.withColumn("tx", F.explode(F.sequence(low("gx"), high("gx")))).withColumn("ty", F.explode(F.sequence(low("gy"), high("gy"))))

    def tile(key: tuple, table: pa.Table) -> pa.Table:
        name, x0, y0 = key[0].as_py(), key[1].as_py() * SIDE - halo, key[2].as_py() * SIDE - halo
        got = run(table["gx"].to_numpy() - x0, table["gy"].to_numpy() - y0, table["kind"].to_numpy())
        own = (got["x"] >= halo) & (got["x"] < halo + SIDE) & (got["y"] >= halo) & (got["y"] < halo + SIDE)
        rest = {c: pa.array(v[own]) for c, v in got.items() if c not in "xy"}
        return pa.table({"scene": pa.array([name] * int(own.sum()), table.schema.field("scene").type), "gx": pa.array(got["x"][own] + x0, pa.int64()), "gy": pa.array(got["y"][own] + y0, pa.int64()), **rest})

    return dealt.groupBy("scene", "tx", "ty").applyInArrow(tile, f"scene {scene}, gx long, gy long{extra}")


def grid(x: np.ndarray, y: np.ndarray, halo: int) -> np.ndarray:
    out = np.zeros((SIDE + 2 * halo,) * 2, bool)
    out[x, y] = True
    return out


def moved(g: np.ndarray, a: int, b: int) -> np.ndarray:
    """g moved by (a, b), empty where nothing moved to."""
    out, (n, m) = np.zeros_like(g), g.shape
    out[max(a, 0) : n + min(a, 0), max(b, 0) : m + min(b, 0)] = g[max(-a, 0) : n + min(-a, 0), max(-b, 0) : m + min(-b, 0)]
    return out
