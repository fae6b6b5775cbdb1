"""Walkable-graph operators: clearance, costs, bounded geodesics, least-cost paths, episode draws.

Solvers are rounds of joins over frontiers for all scenes and sources at once. Each round is
written to the shared folder, so lineage does not grow; the driver sees one count a round.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posegrid.functions.text import episode_id, style_prompt
from posegrid.operators import tiles
from posegrid.operators.sampling import STYLE_SCALES, bucket_draw, idf_choice
from posegrid.operators.spatial import furthest_candidates, safe_edges, snap
from posegrid.rand import seeded
from posegrid.session import discard, materialise, remove, shared_dir

NODE = ["gx", "gy"]


def clearance(cells: DataFrame, cap: int) -> DataFrame:
    """Cells with clearance: distance in cells to the nearest empty cell, at most `cap`. By tiles."""
    n = int(cap)
    discs = sorted((a * a + b * b, a, b) for a in range(-n, n + 1) for b in range(-n, n + 1) if 0 < a * a + b * b <= cap * cap)
    d2, da, db = (np.array(c) for c in zip(*discs))

    def run(x: np.ndarray, y: np.ndarray, kind: np.ndarray) -> dict[str, np.ndarray]:
        full = tiles.grid(x, y, n)
        own = (x >= n) & (x < n + tiles.SIDE) & (y >= n) & (y < n + tiles.SIDE)
        x, y = x[own], y[own]
        around = full[x[:, None] + da, y[:, None] + db]
        return {"x": x, "y": y, "clearance": np.where(around.all(axis=1), float(cap), np.sqrt(d2[around.argmin(axis=1)]))}

    clear = tiles.by_tiles(cells.select("scene", *NODE, F.lit(0).alias("kind")), n, run, ", clearance double")
    if {*cells.columns} == {"scene", *NODE}:
        return clear
    return cells.join(clear.distinct(), ["scene", *NODE], "left").withColumn("clearance", F.coalesce("clearance", F.lit(float(cap))))


def edge_costs(edges: DataFrame, clear: DataFrame, radius: float, cell: float, weight: float, margin: float) -> DataFrame:
    """Edges with cost_ij, cost_ji: the length and, for the cell entered, the squared invasion of
    the margin and the penetration of the agent's radius, both weighed."""
    c = F.greatest(F.col("clearance") * cell, F.lit(0.01))
    pen = clear.select("scene", *NODE, (weight * F.pow(F.greatest(F.lit(0.0), (margin - c) / margin), 2) + weight * F.greatest(F.lit(0.0), radius - c) / radius).alias("p"))
    a, b = pen.select("scene", F.col("gx").alias("ax"), F.col("gy").alias("ay"), F.col("p").alias("pa")), pen.select("scene", F.col("gx").alias("bx"), F.col("gy").alias("by"), F.col("p").alias("pb"))
    d = F.col("dist") * cell
    return edges.join(a, ["scene", "ax", "ay"]).join(b, ["scene", "bx", "by"]).select("scene", "ax", "ay", "bx", "by", "dist", (d * (1.0 + F.col("pb"))).alias("cost_ij"), (d * (1.0 + F.col("pa"))).alias("cost_ji"))


def safe_edge_costs(cells: DataFrame, r: float, cap: int, radius: float, cell: float, weight: float, margin: float) -> DataFrame:
    """edge_costs of the radius_edges in line of sight, with clearances up to cap, in one pass of tiles."""

    def pen(clear: np.ndarray) -> np.ndarray:
        c = np.maximum(clear * cell, 0.01)
        return weight * np.maximum(0.0, (margin - c) / margin) ** 2 + weight * np.maximum(0.0, radius - c) / radius

    d = F.col("dist") * cell
    return safe_edges(cells, r, cap, pen).select("scene", "ax", "ay", "bx", "by", "dist", (d * (1.0 + F.col("pb"))).alias("cost_ij"), (d * (1.0 + F.col("pa"))).alias("cost_ji"))


def both_ways(edges: DataFrame, cost: str) -> DataFrame:
    """scene, src, dst, w: every edge in both directions; src and dst are structs of the place."""
    s, t = F.struct(F.col("ax").alias("gx"), F.col("ay").alias("gy")), F.struct(F.col("bx").alias("gx"), F.col("by").alias("gy"))
    one = edges.select("scene", s.alias("src"), t.alias("dst"), F.col(cost).alias("w"))
    return one.unionByName(edges.select("scene", t.alias("src"), s.alias("dst"), F.col(cost).alias("w")))


def geodesic(arcs: DataFrame, sources: DataFrame, limit: float | str, delta: float | None = None, max_rounds: int = 10_000) -> DataFrame:
    """scene, source, node, dist, via: least distance within `limit` (a number, or a column of
    sources) from every source (scene, source), and the node before on a least path (null at the
    source), ties to the least node. Weights are at least 0.

    Delta-stepping: distances are settled bucket by bucket, each `delta` wide (four mean weights by
    default). Within a bucket, what improved in a round is extended in the next; nodes beyond wait
    for their bucket, by when most of them have their final distance. A round writes improvements
    only, each once; what is settled is read, never written again."""
    spark, on = arcs.sparkSession, ["scene", "source", "node"]
    arcs = materialise(arcs, "arcs")
    if delta is None:
        delta = 4 * float(arcs.agg(F.avg("w")).first()[0] or 0) or 1.0
    none = F.lit(None).cast(arcs.schema["src"].dataType)
    most = F.col(limit) if isinstance(limit, str) else F.lit(float(limit))
    root, wrote = f"{shared_dir(spark)}/geodesic-{uuid.uuid4().hex}", []
    start = sources.select("scene", "source", most.alias("most"), F.col("source").alias("node"), F.lit(0.0).alias("dist"), none.alias("via"), F.lit(True).alias("nearer")).distinct()

    def log(rows: DataFrame) -> DataFrame:
        """The improvements that were written now."""
        wrote.append(f"{root}/{len(wrote)}")
        rows.write.parquet(wrote[-1])
        return spark.read.schema(start.schema).parquet(wrote[-1])

    def best() -> DataFrame:
        every = spark.read.schema(start.schema).parquet(*wrote)
        return every.groupBy(*on).agg(F.min(F.struct("dist", "via", "most")).alias("m")).select(*on, "m.dist", "m.via", "m.most")

    front, high = log(start), delta
    for _ in range(max_rounds):
        if front.isEmpty():
            beyond = best().where(F.col("dist") >= high)
            least = beyond.agg(F.min("dist")).first()[0]
            if least is None:
                tree = materialise(best().select(*on, "dist", "via"), "geodesics")
                for path in wrote:
                    remove(spark, path)
                discard(arcs)
                return tree
            low, high = high, (least // delta + 1) * delta
            front = beyond.where((F.col("dist") >= low) & (F.col("dist") < high))
        step = front.select("scene", "source", "most", F.col("node").alias("src"), F.col("dist").alias("d0")).join(arcs, ["scene", "src"])
        # an arc of weight 0 gives no tie, or two nodes could be each other's via
        step = step.select("scene", "source", "most", F.col("dst").alias("node"), F.round(F.col("d0") + F.col("w"), 9).alias("dist"), F.col("src").alias("via"), (F.col("w") > 0).alias("_ties")).where("dist <= most")
        step = step.groupBy(*on).agg(F.min(F.struct("dist", "via", "most", "_ties")).alias("m")).select(*on, "m.*")
        known = best().select(*on, F.col("dist").alias("_dist"), F.col("via").alias("_via"))
        step = step.join(known, on, "left").withColumn("nearer", F.col("_dist").isNull() | (F.col("dist") < F.col("_dist")))
        step = step.where(F.col("nearer") | (F.col("_ties") & (F.col("dist") == F.col("_dist")) & (F.col("via") < F.col("_via"))))
        front = log(step.select(*start.columns)).where(F.col("nearer") & (F.col("dist") < high))
    raise RuntimeError("no fixed point within max_rounds")


def within(places: DataFrame, sources: DataFrame, reach: float | str, margin: float = 1.0) -> DataFrame:
    """Places (scene, gx, gy) at most reach + margin, in a straight line, from a source of their scene.
    reach: a number, a column of sources, or one of places. Where no arc is shorter than the straight
    line, paths up to reach never leave them, so what lies beyond has no part in a bounded search."""
    most = F.lit(float(reach)) if not isinstance(reach, str) else F.col("_far") if reach in sources.columns else F.col(reach)
    far = [F.col(reach).alias("_far")] if isinstance(reach, str) and reach in sources.columns else []
    s = sources.select(F.col("scene").alias("_scene"), F.col("source.gx").alias("_sx"), F.col("source.gy").alias("_sy"), *far).distinct().hint("merge")
    gap = (F.col("gx") - F.col("_sx")) * (F.col("gx") - F.col("_sx")) + (F.col("gy") - F.col("_sy")) * (F.col("gy") - F.col("_sy"))
    return places.join(s, (F.col("scene") == F.col("_scene")) & (gap <= (most + margin) * (most + margin)), "left_semi")


#: Arcs, or a function that makes them of cells. Such a function's arcs join cells it was given, depend
#: on no others, and are not shorter than the straight line; it is given the cells within reach alone.
Arcs = DataFrame | Callable[[DataFrame], DataFrame]


def _search(arcs: Arcs, cells: DataFrame, sources: DataFrame, limit: float | str) -> DataFrame:
    return geodesic(arcs(within(cells, sources, limit)) if callable(arcs) else arcs, sources, limit)


def trace_paths(tree: DataFrame, goals: DataFrame) -> DataFrame:
    """scene, source, goal, i, node: nodes from each goal back to its source (i from 0 at the goal),
    of goals (scene, source, goal) that the tree reaches; others have no rows.

    Pointers are doubled: round k knows every node's ancestor 2^k steps back, and each path of so
    many nodes is continued by as many again, so a path of n nodes takes log2(n) rounds."""
    on = ["scene", "source", "node"]
    tree = materialise(tree.select(*on, "via"), "tree")
    rows = materialise(goals.select("scene", "source", "goal", F.col("goal").alias("node")).join(tree, on, "left_semi").select("scene", "source", "goal", F.lit(0).alias("i"), "node"), "trace")
    jump, step = tree.where("via IS NOT NULL").withColumnRenamed("via", "to"), 1
    while True:
        more = materialise(rows.join(jump, on).select("scene", "source", "goal", (F.col("i") + step).alias("i"), F.col("to").alias("node")), "trace")
        if more.isEmpty():
            return rows
        rows = rows.unionByName(more)
        onward = jump.select("scene", "source", F.col("node").alias("to"), F.col("to").alias("far"))
        jump, step = materialise(jump.join(onward, ["scene", "source", "to"]).select(*on, F.col("far").alias("to")), "jump"), 2 * step


def draw_starts(tree: DataFrame, low: float, high: float, k: int, seed: int) -> DataFrame:
    """k nodes a source with a distance in [low, high]."""
    w = Window.partitionBy("scene", "source").orderBy(seeded(seed, "scene", F.col("source.gx"), F.col("source.gy"), F.col("node.gx"), F.col("node.gy")), "node")
    return tree.where((F.col("dist") >= low) & (F.col("dist") <= high)).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


#: Least and most distance in metres of a goal to an object, by its class's group.
REACH = {"manipulation": (0.5, 1.5), "other": (0.3, 3.0)}


def reachable_objects(objects: DataFrame, cells: DataFrame, tree: DataFrame, near: float | dict[str, tuple[float, float]], ratio: float = 1.5, cell: float = 1.0) -> DataFrame:
    """scene, source, obj, euclid, dist: objects (scene, obj, gx, gy) within `near` of a source and
    with a geodesic to their nearest cell of at most ratio times the straight distance. near may be
    ranges (least, most) by group, as REACH: objects then have a column grp, and those of no group
    that is named are out of reach."""
    if isinstance(near, dict):
        low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
        for name, (least, most) in near.items():
            low, high = F.when(F.col("grp") == name, least).otherwise(low), F.when(F.col("grp") == name, most).otherwise(high)
        objects = objects.select("scene", "obj", "gx", "gy", low.alias("_low"), high.alias("_high"))
    else:
        objects = objects.select("scene", "obj", "gx", "gy", F.lit(0.0).alias("_low"), F.lit(float(near)).alias("_high"))
    objects = within(objects.withColumn("_reach", F.col("_high") / cell), tree.select("scene", "source"), "_reach")
    at = snap(objects, cells, NODE, 2.0, explode="left").where("b_gx IS NOT NULL").select("scene", "obj", F.struct(F.col("b_gx").alias("gx"), F.col("b_gy").alias("gy")).alias("node"), "gx", "gy", "_low", "_high")
    d = tree.join(at, ["scene", "node"])
    euclid = F.sqrt((F.col("source.gx") - F.col("gx")) * (F.col("source.gx") - F.col("gx")) + (F.col("source.gy") - F.col("gy")) * (F.col("source.gy") - F.col("gy"))) * cell
    return d.withColumn("euclid", euclid).where((F.col("euclid") >= F.col("_low")) & (F.col("euclid") <= F.col("_high")) & (F.col("dist") <= ratio * F.greatest("euclid", F.lit(cell)))).select("scene", "source", "obj", "euclid", "dist")


def _one(rows: DataFrame, seed: str, *key: Column | str) -> DataFrame:
    """One row a scene, the first in seeded order."""
    w = Window.partitionBy("scene").orderBy(seeded(seed, "scene", *key), *key)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def _attempt(drawn: DataFrame, cells: DataFrame, arcs: Arcs, starts: DataFrame, ends: DataFrame, seed: str, candidates: int) -> DataFrame:
    """drawn with start, goal and dist, for the scenes where a goal lies in [low, high]."""
    w = Window.partitionBy("scene").orderBy(seeded(seed, "scene", *NODE), *NODE)
    some = cells.join(drawn.select("scene"), "scene", "left_semi").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= candidates)
    start = _one(furthest_candidates(some.select("scene", *NODE), starts, 5, f"{seed}:far"), f"{seed}:start", *NODE)
    at = materialise(drawn.join(start.select("scene", F.struct(*NODE).alias("source")), "scene"), "starts")
    tree = _search(arcs, cells, at.select("scene", "source", "high"), "high").join(at.select("scene", "low"), "scene").where("dist >= low")
    goals = tree.select("scene", "node.gx", "node.gy", "dist")
    goal = _one(furthest_candidates(goals, ends, 3, f"{seed}:end"), f"{seed}:goal", *NODE)
    return at.join(goal.select("scene", F.struct(*NODE).alias("goal"), "dist"), "scene").withColumnRenamed("source", "start")


def draw_tasks(cells: DataFrame, arcs: Arcs, rounds: int, seed: int, candidates: int = 100, trials: int = 20, least: float = 1.5, most: float = 10.0) -> DataFrame:
    """scene, round, style, low, high, start, goal, dist: one task a scene and round, for all scenes
    at once. Arcs are weighed in metres.

    A style is drawn, and a length bucket scaled by it. The start is one of the 5 of `candidates`
    seeded cells that are furthest from the starts before; the goal one of the 3 cells with a
    geodesic in the bucket that are furthest from the goals before. Scenes without such a goal try
    again, up to `trials` times; then any start is paired with any goal between `least` and `most`
    away, which is not remembered. Scenes where that fails too have no row in that round."""
    cells = materialise(cells, "task-cells")
    scenes = materialise(cells.select("scene").distinct(), "scenes")
    places = lambda c: tasks.where("not fallback").select("scene", f"{c}.gx", f"{c}.gy")
    tasks, starts, ends = None, cells.limit(0), cells.limit(0)
    for r in range(rounds):
        style = F.element_at(F.array(*map(F.lit, STYLE_SCALES)), (seeded(f"{seed}:style", "scene", "round") % len(STYLE_SCALES) + 1).cast("int"))
        left = materialise(bucket_draw(scenes.withColumn("round", F.lit(r)).withColumn("style", style), ["scene", "round"], seed, "style"), "drawn")
        for t in range(trials + 1):
            if t < trials:
                got = _attempt(left, cells, arcs, starts, ends, f"{seed}:{r}:{t}", candidates)
            else:
                start = _one(cells.join(left.select("scene"), "scene", "left_semi"), f"{seed}:{r}:any", *NODE)
                at = materialise(left.join(start.select("scene", F.struct(*NODE).alias("start")), "scene"), "starts")
                tree = _search(arcs, cells, at.select("scene", F.col("start").alias("source")), most).where(F.col("dist") >= least)
                goal = _one(tree.select("scene", "node.gx", "node.gy", "dist"), f"{seed}:{r}:goal", *NODE)
                got = at.join(goal.select("scene", F.struct(*NODE).alias("goal"), "dist"), "scene")
            got = materialise(got.select(*left.columns, "start", "goal", "dist", F.lit(t == trials).alias("fallback")), "tasks")
            tasks = got if tasks is None else tasks.unionByName(got)
            left = materialise(left.join(got.select("scene"), "scene", "left_anti"), "drawn")
            if left.isEmpty():
                break
        starts, ends = places("start"), places("goal")
    return tasks.drop("fallback")


def episode_plan(tasks: DataFrame, cells: DataFrame, arcs: Arcs, objects: DataFrame, seed: int, near: float = 3.0) -> DataFrame:
    """Tasks with path (the nodes from start to goal), target (a class among the objects (scene, obj,
    cls, gx, gy) reachable near the goal, rarer draws first; null if there is none), phrase and
    episode_id. Rounds follow each other, as a draw counts the draws before."""
    tasks = materialise(tasks, "plan")
    cells = materialise(cells, "plan-cells")
    tree = _search(arcs, cells, tasks.groupBy("scene", F.col("start").alias("source")).agg(F.max("dist").alias("reach")), "reach")
    steps = trace_paths(tree, tasks.select("scene", F.col("start").alias("source"), "goal").distinct())
    path = steps.groupBy("scene", F.col("source").alias("start"), "goal").agg(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("i", "node")))), lambda s: s.node).alias("path"))
    around = _search(arcs, cells, tasks.select("scene", F.col("goal").alias("source")).distinct(), 1.5 * max(near, 1.0))
    seen = materialise(reachable_objects(objects, cells, around, near).join(objects.select("scene", "obj", "cls"), ["scene", "obj"]).select("scene", F.col("source").alias("goal"), "cls", F.col("euclid").alias("d")), "seen")
    chosen = None
    for r in sorted(x["round"] for x in tasks.select("round").distinct().collect()):
        here = seen.join(tasks.where(F.col("round") == r).select("scene", "goal"), ["scene", "goal"], "left_semi")
        counts = seen.limit(0).select("cls") if chosen is None else chosen.select("cls")
        pick = idf_choice(here, counts.groupBy("cls").agg(F.count("*").alias("n")), seed + r).select("scene", F.lit(r).alias("round"), "cls")
        pick = materialise(pick, "targets")
        chosen = pick if chosen is None else chosen.unionByName(pick)
    targets = tasks.select("scene", "round").limit(0).withColumn("target", F.lit("")) if chosen is None else chosen.withColumnRenamed("cls", "target")
    name = episode_id(F.concat(F.lit("scene/"), F.col("scene").cast("string")), F.col("style"), F.col("round"))
    out = tasks.join(path, ["scene", "start", "goal"]).join(targets, ["scene", "round"], "left")
    return out.withColumn("phrase", style_prompt(seed, F.concat_ws("|", "scene", "round"))).withColumn("episode_id", name)
