"""Connected components of an edge table: forests of chunks, then alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posegrid.session import discard, materialise

#: Edges of which a task makes a forest at a time.
CHUNK = 1 << 18


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Large star: link each greater neighbour to the least of the neighbourhood. Small star:
    the same for the lesser neighbours and the node itself. edges: u, v."""
    if small:
        e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        e = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = e.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = e.join(low.hint("merge"), "u")
    if small:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    else:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def least_linked(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges (u, v) and the least node linked with it."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    low = np.arange(len(nodes))
    while True:
        la, lb = low[a], low[b]
        apart = la != lb
        if not apart.any():
            return nodes, nodes[low]
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(low, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(low, low[low]):
            low = low[low]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges u, v of the same components, at most one a node: each chunk's nodes with their least."""
    held, n = [], 0

    def out() -> pa.RecordBatch:
        node, low = least_linked(*[np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in "uv"])
        return pa.RecordBatch.from_pydict({"u": node[node != low], "v": low[node != low]})

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= CHUNK:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def connected_components(edges: DataFrame, max_rounds: int = 60, near: list[str] | None = None) -> DataFrame:
    """node, component (the least node of it) for every node of the edges src, dst.

    near: columns of the edges that linked nodes, which must be long, have in common. Edges are then dealt
    and sorted by these, and chunks of them first replaced by forests, which link the same nodes. Each round is two joins and two aggregations over the edges; rounds grow with the logarithm
    of the longest path that is left. The last round's table alone is in the shared folder, and nothing
    is broadcast; the driver sees one count and one checksum a round. Null ends and self-links are ignored.
    """
    kind = edges.schema["src"].dataType
    cur, table, before = edges.select(*(near or []), F.col("src").cast(kind).alias("u"), F.col("dst").cast(kind).alias("v")).where("u <> v"), None, None
    if near:
        cur = cur.repartition(*near).sortWithinPartitions(*near).select("u", "v").mapInArrow(_forest, "u long, v long")
        cur = table = materialise(cur, "components")
        before = _state(cur)
    else:
        cur = cur.distinct()
    for _ in range(max_rounds):
        cur = materialise(_star(_star(cur, small=False), small=True), "components")
        if table is not None:
            discard(table)
        now, table = _state(cur), cur
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("no fixed point within max_rounds")
    nodes = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
