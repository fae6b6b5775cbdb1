"""Queries of sampling, splits and training plans (views vecs, sources, objects, preds, cloud)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from posegrid.operators import sampling as S
from posegrid.plans.register import Registry
from posegrid.rand import sql_seeded
from posegrid.sources.manifests import first_source

R = Registry()


def _u(seed, *key):
    return f"{sql_seeded(seed, *key)} / 4294967296.0"


@R.query("vecs", sql=f"""
WITH t AS (SELECT try, vec_id, label FROM {{vecs}}, (SELECT unnest([0, 1, 2]) AS try))
SELECT try, vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY try, label ORDER BY {sql_seeded('few', 'try', 'vec_id')}, vec_id) AS k FROM t) WHERE k <= 3""")
def few_shot_counts(vecs):
    return S.few_shot(vecs.select("vec_id", "label"), 3, 3).select("try", "vec_id", "label")


@R.query("vecs", sql=f"""
WITH t AS (SELECT try, vec_id, label, count(*) OVER (PARTITION BY try, label) AS n FROM {{vecs}}, (SELECT unnest([0, 1]) AS try))
SELECT try, vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY try, label ORDER BY {sql_seeded('few', 'try', 'vec_id')}, vec_id) AS k FROM t) WHERE k <= greatest(1, floor(n * 0.1))""")
def few_shot_shares(vecs):
    return S.few_shot(vecs.select("vec_id", "label"), 0.1, 2).select("try", "vec_id", "label")


@R.query("vecs", sql=f"""
SELECT vec_id, label, n > 1 AND k <= greatest(1, floor(n * 0.2)) AS val FROM (SELECT vec_id, label, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY {sql_seeded(3, 'vec_id')}, vec_id) AS k FROM {{vecs}})""")
def stratified_split(vecs):
    return S.stratified_split(vecs.select("vec_id", "label"), 0.2, 3)


@R.query("vecs", sql="SELECT vec_id, label FROM {vecs} WHERE vec_id % 5 <> 0 UNION ALL SELECT vec_id, label FROM {vecs} WHERE vec_id % 5 = 0")
def train_and_validation(vecs):
    v = vecs.select("vec_id", "label")
    return v.where("vec_id % 5 <> 0").unionByName(v.where("vec_id % 5 = 0"))


@R.query("vecs", sql="SELECT count(*) AS n, CAST(max(label) + 1 AS INTEGER) AS classes FROM {vecs}")
def row_contract(vecs):
    out = vecs.agg(F.count("*").alias("n"), (F.max("label") + 1).cast("int").alias("classes"))
    return out.where(F.assert_true(F.col("n") > 0).isNull())


@R.query("preds")
def rebalanced_labels(preds):
    labels = preds.groupBy("q").agg(F.max("label").alias("label")).withColumn("labels", F.array("label", ((F.col("label") + F.col("q") % 3) % 10).cast("int")))
    return S.rebalance_multilabel(labels, 0.3, 5).select("q", "label")


_PLACES = "p AS (SELECT vec_id AS item, row_number() OVER (ORDER BY vec_id) - 1 AS p, count(*) OVER () AS n FROM {vecs})"


@R.query("vecs", sql=f"""
WITH {_PLACES}, t AS (SELECT t * n + p AS i, item FROM p, (SELECT unnest([0, 1]) AS t) WHERE t * n + p < n + n // 2)
SELECT row_number() OVER (ORDER BY {sql_seeded(7, 'i')}, i) - 1 AS i, item, (row_number() OVER (ORDER BY {sql_seeded(7, 'i')}, i) - 1) % 4 AS worker FROM t""")
def epoch_plan(vecs):
    """One and a half times the table."""
    n = vecs.count()
    return S.epoch_plan(vecs, "vec_id", 4, n + n // 2, 7)


@R.query("vecs", sql=f"WITH {_PLACES} SELECT t * n + p AS i, item, (t * n + p) % 4 AS worker FROM p, (SELECT unnest([0, 1, 2]) AS t) WHERE t * n + p >= 300")
def infinite_plan(vecs):
    """Three passes but for the 300 items that a run before took."""
    return S.infinite_plan(vecs, "vec_id", 3, 300, 4)


@R.query("vecs", sql=f"""
WITH n AS (SELECT count(*) AS n FROM {{vecs}}), d AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {sql_seeded(9, 'vec_id')}, vec_id) - 1 AS k FROM {{vecs}}), e AS (SELECT id, k % 3 AS worker, pass FROM d, n, (SELECT unnest([0, 1]) AS pass) WHERE k < n // 3 * 3)
SELECT pass, worker, row_number() OVER (PARTITION BY pass, worker ORDER BY {sql_seeded(9, 'pass * 16777216', 'id')}, id) - 1 AS place, id AS item FROM e""")
def sharded_plan(vecs):
    return S.sharded_plan(vecs, "vec_id", 2, 3, 9)


_FILES = "f AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY episode) - 1 AS k, episode AS item FROM {sources}), z AS (SELECT source, count(*) AS n FROM {sources} GROUP BY source)"
_WEIGHTS = [("AUTOMOBILE", 0.2), ("BUILDING", 0.3), ("FURNITURE", 0.1), ("HOUSEHOLD", 0.25), ("MACHINERY", 0.15)]


def _source(seed):
    u, low, parts = _u(seed, "i"), 0.0, []
    total = sum(w for _, w in _WEIGHTS)
    for s, w in _WEIGHTS[:-1]:
        low += w
        parts.append(f"WHEN {u} < {low / total!r} THEN '{s}'")
    return f"CASE {' '.join(parts)} ELSE '{_WEIGHTS[-1][0]}' END"


def _numbered(sources):
    return sources.select("source", (F.row_number().over(Window.partitionBy("source").orderBy("episode")) - 1).alias("k"), F.col("episode").alias("item"))


@R.query("sources", sql=f"WITH {_FILES}, d AS (SELECT i, {_source(21)} AS source FROM (SELECT row_number() OVER (ORDER BY episode) - 1 AS i FROM {{sources}})) SELECT i, d.source, item FROM d JOIN z ON d.source = z.source JOIN f ON f.source = d.source AND f.k = {sql_seeded('21b', 'i')} % n")
def weighted_draw(sources):
    return S.weighted_draw(sources.sparkSession, _WEIGHTS, _numbered(sources), sources.count(), 21)


@R.query("sources", sql=f"WITH {_FILES}, d AS (SELECT i, CASE i % 5 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'FURNITURE' WHEN 3 THEN 'HOUSEHOLD' ELSE 'MACHINERY' END AS source FROM (SELECT row_number() OVER (ORDER BY episode) - 1 AS i FROM {{sources}})) SELECT i, d.source, item FROM d JOIN z ON d.source = z.source JOIN f ON f.source = d.source AND f.k = {sql_seeded(8, 'i')} % n")
def cyclic_plan(sources):
    return S.cyclic_plan(sources.sparkSession, [s for s, _ in _WEIGHTS], _numbered(sources), sources.count(), 8)


@R.query("sources", sql=f"""
WITH {_FILES}, d AS (SELECT i, {_source(31)} AS source FROM (SELECT row_number() OVER (ORDER BY episode) - 1 AS i FROM {{sources}} CROSS JOIN (SELECT unnest([0, 1]) AS twice))), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY i) - 1 AS k FROM d),
m AS (SELECT k.i, k.source, f.item FROM k LEFT JOIN f ON k.source = f.source AND k.k = f.k), s AS (SELECT min(CASE WHEN item IS NULL THEN i END) AS stop FROM m)
SELECT i, source, item FROM m, s WHERE stop IS NULL OR i < stop""")
def mixed_sources(sources):
    return S.mix_sources(sources.sparkSession, _WEIGHTS, _numbered(sources), 2 * sources.count(), 31)


@R.query("sources", sql="SELECT s.scene, count(*) AS n, min(CASE s.source WHEN 'BUILDING' THEN 'b' ELSE 'm' END) AS first FROM {sources} s WHERE s.source IN ('BUILDING', 'MACHINERY') GROUP BY s.scene")
def scenes_to_sources(sources):
    reg = sources.where("source IN ('BUILDING', 'MACHINERY')").select("scene", F.col("source").alias("src"), F.when(F.col("source") == "BUILDING", 0).otherwise(1).alias("ord")).distinct()
    first = first_source(sources.select("scene").distinct(), reg).select("scene", F.when(F.col("src") == "BUILDING", "b").otherwise("m").alias("first"))
    n = sources.where("source IN ('BUILDING', 'MACHINERY')").groupBy("scene").agg(F.count("*").alias("n"))
    return n.join(first, "scene")


@R.query("sources", sql="SELECT s AS source, count(q.scene) AS n FROM (SELECT unnest(['BUILDING', 'MACHINERY', 'NOWHERE']) AS s) x LEFT JOIN (SELECT DISTINCT source, scene FROM {sources}) q ON q.source = x.s GROUP BY s")
def scenes_per_source(sources):
    names = sources.sparkSession.createDataFrame([("BUILDING",), ("MACHINERY",), ("NOWHERE",)], "source string")
    return names.join(sources.select("source", "scene").distinct(), "source", "left").groupBy("source").agg(F.count("scene").alias("n"))


_BLOCKS = f"""k AS (SELECT scene, episode, row_number() OVER (PARTITION BY scene ORDER BY {sql_seeded(4, 'episode')}, episode) - 1 AS k FROM {{sources}}),
d AS (SELECT scene, k // 4 AS block, k % 4 AS slot, episode FROM k), s AS (SELECT scene, block, count(*) AS n FROM d GROUP BY ALL HAVING count(*) < 4),
p AS (SELECT scene, block, slot, n FROM s, (SELECT unnest([0, 1, 2, 3]) AS slot) WHERE slot >= n),
blocks AS (SELECT * FROM d UNION ALL SELECT p.scene, p.block, p.slot, d.episode FROM p JOIN d ON p.scene = d.scene AND p.block = d.block AND d.slot = {sql_seeded(4, 'p.scene', 'p.block', 'p.slot')} % p.n)"""


@R.query("sources", sql=f"WITH {_BLOCKS} SELECT scene, block, slot, episode FROM blocks")
def scene_blocks(sources):
    return S.scene_blocks(sources.select("scene", "episode"), 4, 4)


@R.query("sources", sql=f"""
WITH {_BLOCKS}, e AS (SELECT scene, block, row_number() OVER (ORDER BY block, scene) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT scene, block FROM blocks)),
a AS (SELECT scene, block, place, n FROM e UNION ALL SELECT scene, block, place + n, n FROM e WHERE place < (7 - n % 7) % 7)
SELECT place, place // greatest(1, (n + (7 - n % 7) % 7) // 7) AS worker, slot // 2 AS batch, a.scene, a.block, slot, episode FROM a JOIN blocks b ON a.scene = b.scene AND a.block = b.block""")
def worker_batches(sources):
    out = S.assign_workers(S.scene_blocks(sources.select("scene", "episode"), 4, 4), 7, 2)
    return out.select("place", "worker", "batch", "scene", "block", "slot", "episode")


@R.query("sources", sql=f"SELECT episode, CASE WHEN {_u(12, 'episode')} < 0.2 THEN 3.0 WHEN {_u(12, 'episode')} < 0.5 THEN 6.0 ELSE 10.0 END AS low, CASE WHEN {_u(12, 'episode')} < 0.2 THEN 6.0 WHEN {_u(12, 'episode')} < 0.5 THEN 10.0 ELSE 15.0 END AS high FROM {{sources}}")
def bucket_draws(sources):
    return S.bucket_draw(sources.select("episode"), "episode", 12)


@R.query("sources", sql=f"""
WITH s AS (SELECT episode, CASE episode % 3 WHEN 0 THEN 'r2r' WHEN 1 THEN 'reverie' ELSE 'demand' END AS style, {_u(12, 'episode')} AS u FROM {{sources}}), k AS (SELECT *, CASE WHEN style = 'r2r' THEN 1.0 ELSE 0.5 END AS k FROM s)
SELECT episode, style, (CASE WHEN u < 0.2 THEN 3.0 WHEN u < 0.5 THEN 6.0 ELSE 10.0 END * k)::DOUBLE AS low, (CASE WHEN u < 0.2 THEN 6.0 WHEN u < 0.5 THEN 10.0 ELSE 15.0 END * k)::DOUBLE AS high FROM k""")
def scaled_bucket_draws(sources):
    style = F.element_at(F.array(*map(F.lit, S.STYLE_SCALES)), (F.col("episode") % 3 + 1).cast("int"))
    return S.bucket_draw(sources.select("episode", style.alias("style")), "episode", 12, "style")


@R.query("objects", sql=f"""
WITH c AS (SELECT cls, count(*) AS n FROM {{objects}} GROUP BY cls), near AS (SELECT scene, cls, min(x_cm + y_cm) AS d FROM {{objects}} WHERE cls <> 'PROMO' GROUP BY ALL),
w AS (SELECT near.*, 1.0 / (coalesce(n, 0) + 1.0) AS w FROM near LEFT JOIN c ON near.cls = c.cls), t AS (SELECT *, sum(w) OVER (PARTITION BY scene ORDER BY cls ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(w) OVER (PARTITION BY scene) AS up FROM w)
SELECT scene, cls, d FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY up, cls) AS k FROM t WHERE round(up, 9) > {_u(2, 'scene')}) WHERE k = 1""")
def chosen_targets(objects):
    counts = objects.groupBy("cls").agg(F.count("*").alias("n"))
    return S.idf_choice(objects.withColumn("d", F.col("x_cm") + F.col("y_cm")), counts, 2, ("PROMO",))


@R.query("cloud", sql=f"SELECT scene, x_cm, y_cm FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY {sql_seeded(1, 'x_cm', 'y_cm')}, x_cm, y_cm) AS k FROM (SELECT DISTINCT scene, x_cm, y_cm FROM {{cloud}})) WHERE k <= 100")
def capped_centres(cloud):
    """At most 100 seeded places of every scene."""
    return S.sample_per_group(cloud.select("scene", "x_cm", "y_cm").distinct(), ["scene"], 100, 1, ["x_cm", "y_cm"])


@R.query("objects", sql="SELECT cls, count(DISTINCT scene) AS scenes, count(*) AS n FROM {objects} GROUP BY cls")
def category_counts(objects):
    return objects.groupBy("cls").agg(F.countDistinct("scene").alias("scenes"), F.count("*").alias("n"))


QUERIES, SQL = R.queries, R.sql
