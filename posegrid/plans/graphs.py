"""Queries over the walkable graph (view cells)."""

from __future__ import annotations

from pyspark.sql import functions as F

from posegrid.operators import components, graphs as G
from posegrid.operators import spatial as S
from posegrid.operators.clouds import cell_components
from posegrid.plans.register import Registry
from posegrid.plans.space import _EDGES, _SAMPLES
from posegrid.rand import sql_seeded
from posegrid.session import materialise

R = Registry()
_CLEAR = """rim AS (SELECT DISTINCT scene, gx + i AS gx, gy + j AS gy FROM {cells}, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)),
hole AS (SELECT * FROM rim r WHERE NOT EXISTS (SELECT 1 FROM {cells} c WHERE c.scene = r.scene AND c.gx = r.gx AND c.gy = r.gy)),
m AS (SELECT h.scene, h.gx - i AS gx, h.gy - j AS gy, min(i * i + j * j) AS d2 FROM hole h, (SELECT unnest(generate_series(-4, 4)) AS i), (SELECT unnest(generate_series(-4, 4)) AS j) WHERE i * i + j * j <= 16 GROUP BY ALL),
clear AS (SELECT c.scene, c.gx, c.gy, coalesce(sqrt(d2), 4.0) AS clearance FROM {cells} c LEFT JOIN m ON c.scene = m.scene AND c.gx = m.gx AND c.gy = m.gy)"""


@R.query("cells", sql=f"WITH {_CLEAR} SELECT scene, gx, gy, round(clearance, 6) AS clearance FROM clear")
def clearances(cells):
    return G.clearance(cells, 4).withColumn("clearance", F.round("clearance", 6))


_COST = "pen AS (SELECT scene, gx, gy, 5 * pow(greatest(0.0, (0.2 - c) / 0.2), 2) + 5 * greatest(0.0, 0.15 - c) / 0.15 AS p FROM (SELECT scene, gx, gy, greatest(clearance * 0.05, 0.01) AS c FROM clear))"


@R.query("cells", sql=f"""
WITH {_EDGES}, {_SAMPLES}, {_CLEAR}, {_COST} SELECT s.scene, ax, ay, bx, by_ AS by, round(dist * 0.05 * (1 + b.p) + 1e-10, 6) AS cost_ij, round(dist * 0.05 * (1 + a.p) + 1e-10, 6) AS cost_ji
FROM sight s JOIN pen a ON s.scene = a.scene AND ax = a.gx AND ay = a.gy JOIN pen b ON s.scene = b.scene AND bx = b.gx AND by_ = b.gy""")
def safety_costs(cells):
    c = G.safe_edge_costs(cells, 2.5, 4, 0.15, 0.05, 5.0, 0.2)
    return c.select("scene", "ax", "ay", "bx", "by", *[F.round(F.col(k) + 1e-10, 6).alias(k) for k in ("cost_ij", "cost_ji")])


def _arcs(cells):
    return G.both_ways(S.radius_edges(cells).withColumn("dist", F.round("dist", 9)), "dist")


def _sources(cells):
    """The least cell of every scene."""
    return cells.groupBy("scene").agg(F.min(F.struct("gx", "gy")).alias("source"))


def _bounded(cells, limit: float):
    """Geodesics from the sources; edges are made of the cells within reach only."""
    sources = materialise(_sources(cells), "sources")
    return G.geodesic(_arcs(materialise(G.within(cells, sources, limit), "near-cells")), sources, limit)


def _walk(limit: float) -> str:
    """Leading CTEs: t, the least distance from each source to the nodes within limit."""
    return f"""WITH RECURSIVE {_EDGES}, arcs AS (SELECT scene, ax, ay, bx, by_, round(dist, 9) AS w FROM edges UNION ALL SELECT scene, bx, by_, ax, ay, round(dist, 9) FROM edges),
walk(scene, sx, sy, x, y, d) AS (SELECT scene, gx, gy, gx, gy, 0.0::DOUBLE FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY gx, gy) AS k FROM {{cells}}) WHERE k = 1
  UNION SELECT k.scene, sx, sy, bx, by_, round(d + w, 9) FROM walk k JOIN arcs a ON k.scene = a.scene AND x = ax AND y = ay WHERE d + w <= {limit}),
t AS (SELECT scene, sx, sy, x, y, min(d) AS d FROM walk GROUP BY scene, sx, sy, x, y)"""


@R.query("cells", sql=f"{_walk(4.0)} SELECT scene, sx, sy, x, y, round(d, 6) AS dist FROM t")
def bounded_geodesics(cells):
    t = _bounded(cells, 4.0)
    return t.select("scene", F.col("source.gx").alias("sx"), F.col("source.gy").alias("sy"), F.col("node.gx").alias("x"), F.col("node.gy").alias("y"), F.round("dist", 6).alias("dist"))


@R.query("cells")
def least_cost_paths(cells):
    """Paths up to 0.6 m, which is 12 cells; 8 more, so that clearances up to 4 are those of all cells."""
    sources = materialise(_sources(cells), "sources")
    cells = materialise(G.within(cells, sources, 12.0, margin=8.0), "near-cells")
    edges = S.line_of_sight(S.radius_edges(cells), cells, reach=2.5)
    c = G.edge_costs(edges, G.clearance(cells, 4), 0.15, 0.05, 5.0, 0.2).withColumn("cost", F.round(F.least("cost_ij", "cost_ji"), 9))
    tree = G.geodesic(G.both_ways(c, "cost"), sources, 0.6)
    far = tree.groupBy("scene", "source").agg(F.max(F.struct("dist", "node")).alias("m")).select("scene", "source", F.col("m.node").alias("goal"))
    p = G.trace_paths(tree, far)
    return p.groupBy("scene", F.col("source.gx").alias("sx"), F.col("source.gy").alias("sy")).agg(F.count("*").alias("nodes"))


@R.query("cells", sql=f"""{_walk(6.0)} SELECT scene, sy, x, y, round(d, 6) AS dist FROM (
  SELECT *, row_number() OVER (PARTITION BY scene, sx, sy ORDER BY {sql_seeded(3, 'scene', 'sx', 'sy', 'x', 'y')}, x, y) AS k FROM t WHERE d >= 4.0) WHERE k <= 2""")
def starts_in_band(cells):
    t = _bounded(cells, 6.0)
    d = G.draw_starts(t, 4.0, 6.0, 2, 3)
    return d.select("scene", F.col("source.gy").alias("sy"), F.col("node.gx").alias("x"), F.col("node.gy").alias("y"), F.round("dist", 6).alias("dist"))


@R.query("cells", sql=f"""{_walk(9.0)}, e AS (SELECT *, sqrt((sx - x) * (sx - x) + (sy - y) * (sy - y)) AS euclid FROM t)
SELECT scene, sy, x * 100 + y AS obj, round(euclid, 6) AS euclid, round(d, 6) AS dist FROM e WHERE (CASE WHEN (x + y) % 3 = 0 THEN euclid BETWEEN 1.0 AND 3.0 ELSE euclid BETWEEN 0.6 AND 6.0 END) AND d <= 1.5 * greatest(euclid, 1.0)""")
def reachable_objects(cells):
    """One object on every cell; the search goes as far as the longest geodesic that the furthest object may have."""
    ratio, reach = 1.5, {name: (2 * low, 2 * high) for name, (low, high) in G.REACH.items()}
    t = _bounded(cells, ratio * max(1.0, *(high for _, high in reach.values())))
    grp = F.when((F.col("gx") + F.col("gy")) % 3 == 0, "manipulation").otherwise("other")
    objects = cells.select("scene", (F.col("gx") * 100 + F.col("gy")).alias("obj"), "gx", "gy", grp.alias("grp"))
    out = G.reachable_objects(objects, cells, t, reach, ratio)
    return out.select("scene", F.col("source.gy").alias("sy"), "obj", F.round("euclid", 6).alias("euclid"), F.round("dist", 6).alias("dist"))


@R.query("cells")
def connected_cells(cells):
    return cell_components(cells)


@R.query("orders")
def linked_customers(orders):
    """Customers linked by orders of one day and priority: components of a bipartite graph."""
    key = F.xxhash64(F.to_date("o_orderdate").cast("string"), "o_orderpriority")
    edges = orders.select(F.col("o_custkey").alias("src"), (F.abs(key) + 10**9).alias("dst"))
    return components.connected_components(edges).where("node < 1000000000").select(F.col("node").alias("c_custkey"), "component")


def _places(*names):
    return [F.col(f"{c}.{k}").alias(f"{c}_{k}") for c in names for k in ("gx", "gy")]


@R.query("cells")
def drawn_tasks(cells):
    t = G.draw_tasks(cells, _arcs, 2, 5, trials=2)
    return t.select("scene", "round", "style", "low", "high", *_places("start", "goal"), F.round("dist", 6).alias("dist"))


@R.query("cells", "objects")
def episode_plan(cells, objects):
    things = objects.select("scene", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("obj"), "cls", (F.col("x_cm") / 5).alias("gx"), (F.col("y_cm") / 5).alias("gy"))
    p = G.episode_plan(G.draw_tasks(cells, _arcs, 1, 6, trials=2), cells, _arcs, things, 7)
    nodes = F.array_join(F.transform("path", lambda n: F.concat_ws(":", n.gx, n.gy)), " ").alias("path")
    return p.select("scene", "round", "style", "low", "high", *_places("start", "goal"), F.round("dist", 6).alias("dist"), nodes, "target", "phrase", "episode_id")


QUERIES, SQL = R.queries, R.sql
