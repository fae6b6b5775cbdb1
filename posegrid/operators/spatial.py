"""Radius and nearest joins on a grid key.

A distance predicate alone would make Spark compare all pairs. Here both sides get the cell
floor(coordinate / r); one side, the smaller, is exploded over the neighbouring cells; the join is
an equality of (keys, cell) and the exact distance is a filter after it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posegrid.operators import packs
from posegrid.operators.components import connected_components, least_linked
from posegrid.rand import seeded
from posegrid.session import materialise


def _cell(c: str, r: float) -> Column:
    return F.floor(F.col(c) / F.lit(r)).cast("long")


def distance2(dims: list[str], a: str = "", b: str = "b_") -> Column:
    return reduce(lambda s, d: s + d, [(F.col(a + d) - F.col(b + d)) * (F.col(a + d) - F.col(b + d)) for d in dims])


def radius_pairs(left: DataFrame, right: DataFrame, r: float, dims: list[str], keys: list[str] = ["scene"], explode: str = "right") -> DataFrame:  # noqa: B006
    """Pairs of left and right rows of equal keys within r; right columns get the prefix b_, and
    column d2 is the squared distance. explode: the side that is copied to neighbouring cells."""
    a = left.withColumns({f"_c{i}": _cell(d, r) for i, d in enumerate(dims)})
    b = right.select(*[F.col(c).alias(f"b_{c}") for c in right.columns]).withColumns({f"_d{i}": _cell(f"b_{d}", r) for i, d in enumerate(dims)})
    for i in range(len(dims)):
        around = lambda c: F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1))
        if explode == "right":
            b = b.withColumn(f"_d{i}", around(f"_d{i}"))
        else:
            a = a.withColumn(f"_c{i}", around(f"_c{i}"))
    on = [F.col(k) == F.col(f"b_{k}") for k in keys] + [F.col(f"_c{i}") == F.col(f"_d{i}") for i in range(len(dims))]
    out = a.join(b, reduce(lambda x, y: x & y, on)).withColumn("d2", distance2(dims))
    return out.where(F.col("d2") <= F.lit(r) * F.lit(r)).drop(*[f"_{x}{i}" for x in "cd" for i in range(len(dims))])


def near_reference(points: DataFrame, reference: DataFrame, r: float, dims: list[str], id_cols: list[str], keys: list[str] = ["scene"]) -> DataFrame:  # noqa: B006
    """Points with a reference point within r. Only distinct reference places are joined."""
    ref = reference.select(*keys, *dims).distinct()
    hit = radius_pairs(points.select(*keys, *dims).distinct(), ref, r, dims, keys).select(*keys, *dims).distinct()
    return points.join(hit, [*keys, *dims], "left_semi")


def away_from(points: DataFrame, obstacles: DataFrame, r: float, dims: list[str], keys: list[str] = ["scene"], most: int | None = None, seed: int = 0) -> DataFrame:  # noqa: B006
    """Points with no obstacle within r. most: only so many places of obstacles of each key, drawn in
    seeded order, are centres."""
    centres = obstacles.select(*keys, *dims).distinct()
    if most is not None:
        drawn = Window.partitionBy(*keys).orderBy(seeded(seed, *keys, *dims), *dims)
        centres = centres.withColumn("_k", F.row_number().over(drawn)).where(F.col("_k") <= most).drop("_k")
    hit = radius_pairs(points.select(*keys, *dims).distinct(), centres, r, dims, keys).select(*keys, *dims).distinct()
    return points.join(hit, [*keys, *dims], "left_anti")


def place_counts(points: DataFrame, r: float, dims: list[str], keys: list[str] = ["scene"]) -> DataFrame:  # noqa: B006
    """Distinct places with n, their rows, and neighbours, the number of rows within r, their own included.
    Equal places are counted once each and weighed, so a crowded place makes no pairs of its rows. Each
    place goes to its tile and to those that it borders; pairs are counted there and never become rows."""
    names = [*keys, *dims]
    rows, tile = packs.dealt(points.groupBy(*names).agg(F.count("*").alias("n")), r, dims, 1, keys)

    def run(table: pa.Table, group: np.ndarray) -> pa.Table:
        grid, n, own = packs.Grid(table, group, r, dims, tile, 1), table["n"].to_numpy(), table["_own"].to_numpy()
        seen = np.zeros(len(n), np.int64)
        for i, j, d2 in grid.pairs(np.flatnonzero(own)):
            near = d2 <= r * r
            seen += np.bincount(i[near], n[j[near]], len(n)).astype(np.int64)
        return table.select([*names, "n"]).append_column("neighbours", pa.array(seen)).filter(pa.array(own))

    return packs.in_packs(rows.where("_whole"), [*keys, *tile], [], run, f"{packs.kinds(points, names)}, n long, neighbours long")


def radius_count(points: DataFrame, r: float, dims: list[str], keys: list[str] = ["scene"]) -> DataFrame:  # noqa: B006
    """Points with neighbours, the number of points within r, the point itself included."""
    return points.join(place_counts(points, r, dims, keys).drop("n"), [*keys, *dims])


def denoise(points: DataFrame, r: float, least: int, dims: list[str], small: int = 0, keys: list[str] = ["scene"]) -> DataFrame:  # noqa: B006
    """Points with at least `least` neighbours besides themselves; groups of at most `small` rows stay as they are."""
    counted = radius_count(points, r, dims, keys)
    if small:
        counted = counted.withColumn("_all", F.count("*").over(Window.partitionBy(*keys))).where((F.col("neighbours") >= least + 1) | (F.col("_all") <= small)).drop("_all")
    else:
        counted = counted.where(F.col("neighbours") >= least + 1)
    return counted.select(*points.columns)


def _disc(r: float) -> list[tuple[int, int]]:
    """Offsets on the grid of at most r, itself left out."""
    n = int(r)
    return [(i, j) for i in range(-n, n + 1) for j in range(-n, n + 1) if 0 < i * i + j * j <= r * r]


def radius_edges(cells: DataFrame, r: float = 2.5, cap: int = 64) -> DataFrame:
    """scene, ax, ay, bx, by, dist of neighbouring cells (whole gx, gy, each cell once), each pair
    once (a before b). A cell keeps its `cap` nearest, itself included, by distance and then place;
    where the disc of r has no more cells than that, each is joined by half its offsets alone."""
    disc = _disc(r)
    rank = len(disc) + 1 > cap
    steps = [(i, j) for i, j in disc if rank or (i, j) > (0, 0)]
    if not steps:
        steps = [(0, 0)]
    offset = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])).alias("o")
    pairs = cells.select("scene", F.col("gx").alias("ax"), F.col("gy").alias("ay"), offset)
    pairs = pairs.select("scene", "ax", "ay", (F.col("ax") + F.col("o.i")).alias("bx"), (F.col("ay") + F.col("o.j")).alias("by"), F.sqrt((F.col("o.i") * F.col("o.i") + F.col("o.j") * F.col("o.j")).cast("double")).alias("dist"))
    near = pairs.where("dist > 0").join(cells.select("scene", F.col("gx").alias("bx"), F.col("gy").alias("by")), ["scene", "bx", "by"])
    if rank:
        w = Window.partitionBy("scene", "ax", "ay").orderBy("dist", "bx", "by")
        near = near.withColumn("_k", F.row_number().over(w)).where(F.col("_k") < cap).where("ax < bx OR (ax = bx AND ay < by)")
    return near.select("scene", "ax", "ay", "bx", "by", "dist")


def snap(queries: DataFrame, nodes: DataFrame, dims: list[str], r: float, keys: list[str] = ["scene"], explode: str = "right") -> DataFrame:  # noqa: B006
    """Queries with the nearest node (columns b_*, d2), ties to the least node; equal queries come
    once. By tiles, the radius is doubled up to 8 r for the queries that found none. For those still
    left (explode says the side that is copied) it grows fourfold until all have one: only queries whose
    scene has no node, or with a null among keys and dims, get nulls."""
    rest = [c for c in nodes.columns if c not in keys and c not in dims]
    order = F.struct("d2", *[F.col(f"b_{c}") for c in [*dims, *rest]])
    best = [F.min_by(F.col(f"b_{c}"), order).alias(f"b_{c}") for c in nodes.columns]
    same = lambda a, b: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in queries.columns])
    whole = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in [*keys, *dims]])
    nodes = nodes.where(whole)
    found = materialise(_snapped(queries.distinct(), nodes, dims, r, keys, rest), "snap")
    done, every, i = found.where("d2 IS NOT NULL"), found.where("d2 IS NULL").select(*queries.columns), 2
    if every.isEmpty():
        return done
    left, parts = every.where(whole).join(nodes.select(*keys).distinct(), keys, "left_semi"), None
    while parts is None or not left.isEmpty():
        more = radius_pairs(left, nodes, r * 4**i, dims, keys, explode).groupBy(*queries.columns).agg(*best, F.min("d2").alias("d2"))
        more = materialise(more, "snap")
        parts = more if parts is None else parts.unionByName(more)
        left, i = materialise(left.join(more, same(left, more), "left_anti").select(*queries.columns), "snap"), i + 1
    none = every.join(parts, same(every, parts), "left_anti")
    none = none.select("*", *[F.lit(None).cast(nodes.schema[c].dataType).alias(f"b_{c}") for c in nodes.columns], F.lit(None).cast(found.schema["d2"].dataType).alias("d2"))
    return done.unionByName(parts).unionByName(none)


def _snapped(queries: DataFrame, nodes: DataFrame, dims: list[str], r: float, keys: list[str], rest: list[str]) -> DataFrame:
    """queries with b_* and d2 of the nearest node within 8 r, nulls where there is none."""
    ask = queries.select(*keys, *dims, F.struct(*queries.columns).alias("_q"), F.lit(False).alias("_node"))
    be = nodes.select(*keys, *dims, F.struct(*nodes.columns).alias("_b"), F.lit(True).alias("_node"))
    # each dimension has one type on both sides
    both = ask.unionByName(be, allowMissingColumns=True)
    rows, tile = packs.dealt(both, r, dims, 8, keys, "_node")
    d2 = both.select(distance2(dims, "", "").alias("d2")).schema["d2"].dataType.simpleString()

    def run(table: pa.Table, group: np.ndarray) -> pa.Table:
        whole = table["_whole"].to_numpy()
        lost = table.filter(pa.array(~whole))["_q"].combine_chunks()
        table, group = table.filter(pa.array(whole)).combine_chunks(), group[whole]
        node = table["_node"].to_numpy()
        grid = packs.Grid(table, group, r, dims, tile, 8, among=node)
        asked = np.flatnonzero(~node)
        near, far = np.full(len(node), -1), np.zeros(len(node), grid.at[0].dtype if len(dims) == 1 else np.result_type(*grid.at))
        left = asked
        for wide in (1, 2, 4, 8):
            for i, j, gap in grid.pairs(left, wide):
                keep = np.flatnonzero(gap <= (wide * r) * (wide * r))
                # of each row the nearest, and of these the first, as nodes are sorted
                keep = keep[np.lexsort((j[keep], gap[keep], i[keep]))]
                i, j, gap = i[keep], j[keep], gap[keep]
                first = np.flatnonzero(np.diff(i, prepend=-1))
                i, j, gap = i[first], j[first], gap[first]
                less = (near[i] < 0) | (gap < far[i]) | ((gap == far[i]) & (j < near[i]))
                near[i[less]], far[i[less]] = j[less], gap[less]
            left = left[near[left] < 0]
        at = pa.array(near[asked], mask=near[asked] < 0)
        return pa.table({
            "_q": pa.chunked_array([table["_q"].combine_chunks().take(pa.array(asked)), lost]),
            "_b": pa.chunked_array([table["_b"].combine_chunks().take(at), pa.nulls(len(lost), table.schema.field("_b").type)]),
            "d2": pa.chunked_array([pa.array(far[asked], mask=near[asked] < 0), pa.nulls(len(lost), pa.from_numpy_dtype(far.dtype))]),
        })

    schema = f"_q {ask.schema['_q'].dataType.simpleString()}, _b {be.schema['_b'].dataType.simpleString()}, d2 {d2}"
    found = packs.in_packs(rows, [*keys, *tile], ["_node", *dims, *([F.col("_b")] if rest else [])], run, schema)
    return found.select(*[F.col(f"_q.{c}").alias(c) for c in queries.columns], *[F.col(f"_b.{c}").alias(f"b_{c}") for c in nodes.columns], "d2")


def floor_snap(queries: DataFrame, nodes: DataFrame, reach: float = 1.0, below: float = 1.5, above: float = 0.2, layer: float = 0.2) -> DataFrame:
    """Queries (scene, q, x, y, z) with a node: among nodes within reach in x, y and z from z - below
    to z + above, those up to `layer` over the lowest; the nearest in x, y; else, at any distance, the
    nearest in x, y. Scenes without nodes give nulls. Queries, the fewer, are copied to cells around."""
    nodes = nodes.select("scene", "x", "y", "z")
    pairs = radius_pairs(queries, nodes, reach, ["x", "y"], explode="left")
    fit = pairs.where((F.col("b_z") >= F.col("z") - below) & (F.col("b_z") <= F.col("z") + above))
    low = F.min("b_z").over(Window.partitionBy("scene", "q"))
    pick = F.min_by(F.struct("b_x", "b_y", "b_z"), F.struct("d2", "b_x", "b_y", "b_z"))
    first = materialise(fit.withColumn("_low", low).where(F.col("b_z") <= F.col("_low") + layer).groupBy("scene", "q").agg(pick.alias("n")), "floor-snap")
    other = snap(queries.join(first, ["scene", "q"], "left_anti"), nodes, ["x", "y"], reach, explode="left").select(*queries.columns, "b_x", "b_y", "b_z")
    return queries.join(first, ["scene", "q"]).select(*queries.columns, "n.b_x", "n.b_y", "n.b_z").unionByName(other)


def neighbour_support(places: DataFrame, cells: DataFrame, reach: float = 2.0) -> DataFrame:
    """Places with n_near (cells within reach), n_wide (within twice that) and the centroid of the latter."""
    pairs = radius_pairs(places, cells, 2 * reach, ["gx", "gy"])
    near = F.col("d2") <= reach * reach
    found = pairs.groupBy(*places.columns).agg(F.count(F.when(near, 1)).alias("n_near"), F.count("*").alias("n_wide"), F.avg("b_gx").alias("mean_x"), F.avg("b_gy").alias("mean_y"))
    return places.join(found, places.columns, "left").fillna(0, ["n_near", "n_wide"])


def furthest_candidates(candidates: DataFrame, history: DataFrame, k: int, seed: int | str | None = None) -> DataFrame:
    """Per scene the k candidates furthest from their nearest history place; ties, and scenes
    without history, go by the least place, or by seeded order if a seed is given. History is a
    bounded list per scene (the starts drawn so far)."""
    h = history.select("scene", F.struct("gx", "gy").alias("h")).groupBy("scene").agg(F.collect_list("h").alias("hs"))
    far = F.array_min(F.transform("hs", lambda p: (p.gx - F.col("gx")) * (p.gx - F.col("gx")) + (p.gy - F.col("gy")) * (p.gy - F.col("gy"))))
    d = candidates.join(h, "scene", "left").withColumn("d2", far).drop("hs")
    drawn = [] if seed is None else [seeded(seed, "scene", "gx", "gy")]
    w = Window.partitionBy("scene").orderBy(F.desc_nulls_last("d2"), *drawn, "gx", "gy")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _crossed(i: int, j: int, per_cell: int, gap: int) -> list[set[tuple[int, int]]]:
    """Of the line to offset (i, j): for each sample the cells of which one must be there, without
    samples that an end of the line serves. Samples lie at `per_cell` a cell, rounded half up."""
    n = max(1, math.ceil(math.sqrt(i * i + j * j) * per_cell))
    at = [(math.floor(i * k / n + 0.5), math.floor(j * k / n + 0.5)) for k in range(n + 1)]
    near = [set(at[max(0, k - gap) : k + gap + 1]) for k in range(n + 1)]
    free = [s for s in near if not s & {(0, 0), (i, j)}]
    return [s for k, s in enumerate(free) if s not in free[:k]]


def line_of_sight(edges: DataFrame, cells: DataFrame, per_cell: int = 2, gap: int = 1, reach: float | None = None) -> DataFrame:
    """Edges between cells whose straight line lies on cells: samples at `per_cell` a cell, gaps of
    up to `gap` samples between hits closed.

    What a line crosses depends on its offset alone, so it is tabulated once for all offsets within
    reach (by default the longest edge's). Offsets on which no cell but the ends matters need no
    join; for the others the crossed cells are joined by equality and counted."""
    if reach is None:
        reach = float(edges.agg(F.max("dist")).first()[0] or 0)
    table = [(i, j, k, x, y) for i, j in _disc(reach + 1e-9) for k, need in enumerate(_crossed(i, j, per_cell, gap)) for x, y in sorted(need)]
    if not table:
        return edges
    names = ["scene", "ax", "ay", "bx", "by"]
    offsets = cells.sparkSession.createDataFrame(table, "_i long, _j long, _need long, _x long, _y long")
    # a table of the disc's size, whatever the number of edges
    away = edges.select(*names, (F.col("bx") - F.col("ax")).alias("_i"), (F.col("by") - F.col("ay")).alias("_j")).join(F.broadcast(offsets), ["_i", "_j"])
    asked = away.select(*names, "_need", (F.col("ax") + F.col("_x")).alias("gx"), (F.col("ay") + F.col("_y")).alias("gy"))
    hit = asked.join(cells.select("scene", "gx", "gy", F.lit(1).alias("_hit")), ["scene", "gx", "gy"], "left")
    blind = hit.groupBy(*names, "_need").agg(F.count("_hit").alias("_n")).where("_n = 0").select(*names).distinct()
    return edges.join(blind, names, "left_anti")


def safe_edges(cells: DataFrame, r: float, cap: int, cost: Callable[[np.ndarray], np.ndarray], per_cell: int = 2, gap: int = 1) -> DataFrame:
    """scene, ax, ay, bx, by, dist, pa, pb: radius_edges (without a cap) that line_of_sight keeps, with what
    `cost` makes of the clearance (the distance to the nearest empty cell, at most cap) of either end.
    cells: whole gx, gy, each once. By tiles, each with its border as a small grid: one shuffle of cells."""
    steps = [(i, j) for i, j in _disc(r) if (i, j) > (0, 0)]
    crossed = {s: [sorted(c) for c in _crossed(*s, per_cell, gap)] for s in steps}
    rim = sorted((i * i + j * j, i, j) for i, j in _disc(cap))
    halo = int(r) + int(cap)
    rows, tile = packs.dealt(cells.select("scene", F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy")), 1.0, ["gx", "gy"], halo, ["scene"])

    def run(table: pa.Table, group: np.ndarray) -> pa.Table:
        grid, own = packs.Grid(table, group, 1.0, ["gx", "gy"], tile, halo), table["_own"].to_numpy()
        (x, y), shape = grid.cell, (group[-1] + 1, grid.wide, grid.wide)
        full, room = np.zeros(shape, bool), np.full(shape, int(cap) ** 2, np.int16)
        full[group, x, y] = True
        left = np.flatnonzero(grid.within(int(r)))
        for d2, i, j in rim:
            empty = ~full[group[left], x[left] + i, y[left] + j]
            at = left[empty]
            room[group[at], x[at], y[at]] = d2
            left = left[~empty]
        worth, out = cost(np.minimum(np.sqrt(np.arange(int(cap) ** 2 + 1)), cap)), []
        for i, j in steps:
            at = np.flatnonzero(own)
            at = at[full[group[at], x[at] + i, y[at] + j]]
            for need in crossed[i, j]:
                at = at[np.logical_or.reduce([full[group[at], x[at] + a, y[at] + b] for a, b in need])]
            out.append((at, np.full(len(at), i), np.full(len(at), j)))
        at, i, j = (np.concatenate(c) for c in zip(*out))
        gx, gy = (grid.at[k][at] for k in (0, 1))
        pa_, pb = worth[room[group[at], x[at], y[at]]], worth[room[group[at], x[at] + i, y[at] + j]]
        return pa.table({"scene": table["scene"].combine_chunks().take(pa.array(at)), "ax": gx, "ay": gy, "bx": gx + i, "by": gy + j, "dist": np.sqrt((i * i + j * j).astype(float)), "pa": pa_, "pb": pb})

    return packs.in_packs(rows.where("_whole"), ["scene", *tile], [], run, f"{packs.kinds(cells, ['scene'])}, ax long, ay long, bx long, by long, dist double, pa double, pb double")


def dbscan(points: DataFrame, eps: float, min_points: int, dims: list[str], keys: list[str] = ["scene"]) -> DataFrame:  # noqa: B006
    """Distinct places with n, their rows, and cluster: the least place of their density cluster, null for noise.

    A place with at least min_points points within eps, itself included, is core; cores within eps
    are linked; a border place joins the least cluster in reach.
    """
    names = [*keys, *dims]
    found = density_parts(points, eps, min_points, dims, keys)
    label = F.concat_ws("|", *[F.col(c).cast("string") for c in keys], *[F.col(f"_head.{d}").cast("string") for d in dims])
    return found.select(*names, "n", F.when(F.col("_head").isNotNull(), label).alias("cluster"))


def density_parts(points: DataFrame, eps: float, min_points: int, dims: list[str], keys: list[str] = ["scene"]) -> DataFrame:  # noqa: B006
    """Distinct places with n and _head, the dims of the least place of their density cluster (see dbscan).

    By tiles with what lies within two eps: there the places up to eps beside a tile are known to be core
    or not, so a tile's part of each cluster is linked at once and named by its least place. Only cores
    that more than one tile holds tie these names together, by connected_components; nothing is broadcast."""
    names, head = [*keys, *dims], "struct<" + ", ".join(f"`{d}`: {points.schema[d].dataType.simpleString()}" for d in dims) + ">"
    rows, tile = packs.dealt(points.groupBy(*names).agg(F.count("*").alias("n")), eps, dims, 2, keys)

    def run(table: pa.Table, group: np.ndarray) -> pa.Table:
        whole = table["_whole"].to_numpy()
        lost = table.filter(pa.array(~whole))
        table, group = table.filter(pa.array(whole)).combine_chunks(), group[whole]
        grid, n, own, copied = packs.Grid(table, group, eps, dims, tile, 2), table["n"].to_numpy(), table["_own"].to_numpy(), table["_copied"].to_numpy()
        around, zone = np.zeros(len(n), np.int64), np.flatnonzero(grid.within(1))
        for i, j, d2 in grid.pairs(zone):
            near = d2 <= eps * eps
            around += np.bincount(i[near], n[j[near]], len(n)).astype(np.int64)
        core = around >= min_points
        # links of cores become a forest as they come; rows are sorted, so the least row is the least place
        low, pending, size = np.arange(len(n)), [], 0
        for i, j, d2 in grid.pairs(np.flatnonzero(core)):
            link = (i > j) & core[j] & (d2 <= eps * eps)
            pending.append((low[i[link]], low[j[link]]))
            size += int(link.sum())
            if size > packs.PAIRS:
                low, pending, size = _linked(low, pending), [], 0
        low = _linked(low, pending)
        of, to = [np.flatnonzero(core & (own | copied))], []
        to.append(low[of[0]])
        for i, j, d2 in grid.pairs(np.flatnonzero(own & ~core)):
            near = core[j] & (d2 <= eps * eps)
            of.append(i[near])
            to.append(low[j[near]])
        both = np.unique(np.concatenate(of).astype(np.int64) * max(1, len(n)) + np.concatenate(to))
        of, to = both // max(1, len(n)), both % max(1, len(n))
        kept = np.flatnonzero(own | (core & copied))
        ends = np.searchsorted(of, kept, "right")
        heads = pa.StructArray.from_arrays([table[d].combine_chunks().take(pa.array(to)) for d in dims], names=dims)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), heads)
        out = table.select([*names, "n"]).take(pa.array(kept))
        out = out.append_column("_own", pa.array(own[kept])).append_column("_tie", pa.array(core[kept] & copied[kept])).append_column("_heads", lists)
        none = lost.select([*names, "n"]).append_column("_own", pa.array([True] * len(lost), pa.bool_())).append_column("_tie", pa.array([False] * len(lost), pa.bool_())).append_column("_heads", pa.array([[]] * len(lost), lists.type))
        return pa.concat_tables([out, none])

    schema = f"{packs.kinds(points, names)}, n long, _own boolean, _tie boolean, _heads array<{head}>"
    found = materialise(packs.in_packs(rows, [*keys, *tile], dims, run, schema), "density-parts")
    own, ties = found.where("_own").drop("_own", "_tie"), found.where("_tie")
    least = F.array_min("_heads").alias("_head")
    if ties.isEmpty():
        return own.select(*names, "n", least)
    place = lambda of: F.struct(*[F.col(k) for k in keys], *[F.col(f"{of}{d}").alias(d) for d in dims])
    part = connected_components(ties.select(*names, F.explode("_heads").alias("_h")).select(place("").alias("src"), place("_h.").alias("dst")))
    each = own.select(*names, "n", F.explode_outer("_heads").alias("_h")).withColumn("node", place("_h."))
    named = each.join(part.hint("merge"), "node", "left").withColumn("_h", F.coalesce(F.when(F.col("component").isNotNull(), F.struct(*[F.col(f"component.{d}").alias(d) for d in dims])), "_h"))
    return named.groupBy(*names, "n").agg(F.min("_h").alias("_head"))


def _linked(low: np.ndarray, pending: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Rows' least linked row, after more links between such."""
    if not sum(len(u) for u, _ in pending):
        return low
    node, least = least_linked(*[np.concatenate(c) for c in zip(*pending)])
    to = np.arange(len(low))
    to[node] = least
    return to[low]
