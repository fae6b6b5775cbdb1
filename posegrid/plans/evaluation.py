"""Queries of evaluation metrics, embeddings and run logs (views preds, vecs, pixels, seg, evals, objects, boxes)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from posegrid.functions import callables
from posegrid.operators import metrics as M
from posegrid.operators import vectors as V
from posegrid.operators.registry import first_seen
from posegrid.plans.register import Registry

R = Registry()


def _r(df, *names, places: int = 6):
    return df.select(*[F.round(F.col(c) + 1e-10, places).alias(c) if c in names else F.col(c) for c in df.columns])


def _labels(preds):
    return preds.withColumn("labels", F.array("label", ((F.col("label") + F.col("q") % 3) % 10).cast("int")))


_RANK = "ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, cls) AS rank FROM {preds})"
_AT = "hits AS (SELECT q, label, coalesce(min(CASE WHEN cls = label THEN rank END), 1000000000) AS a FROM ranked GROUP BY q, label), each AS (SELECT *, CASE WHEN a <= k THEN 1.0 ELSE 0.0 END AS ok FROM hits, (SELECT unnest([1, 3, 5]) AS k))"


@R.query("preds", sql=f"WITH {_RANK}, {_AT} SELECT k, round(avg(ok) + 1e-10, 6) AS accuracy FROM each GROUP BY k")
def topk_accuracy_micro(preds):
    return _r(M.topk_accuracy(preds, [1, 3, 5]), "accuracy")


@R.query("preds", sql=f"WITH {_RANK}, {_AT}, p AS (SELECT k, label, avg(ok) AS x FROM each GROUP BY ALL) SELECT k, round(avg(x) + 1e-10, 6) AS accuracy FROM p GROUP BY k")
def topk_accuracy_macro(preds):
    return _r(M.topk_accuracy(preds, [1, 3, 5], "macro"), "accuracy")


@R.query("preds", sql=f"WITH {_RANK}, {_AT} SELECT k, label, round(avg(ok) + 1e-10, 6) AS accuracy FROM each GROUP BY ALL")
def topk_recall_per_class(preds):
    return _r(M.topk_accuracy(preds, [1, 3, 5], "none"), "accuracy")


_TP = "top AS (SELECT cls, label FROM ranked WHERE rank = 1), c AS (SELECT cls AS c, CASE WHEN cls = label THEN 1 ELSE 0 END AS tp, CASE WHEN cls <> label THEN 1 ELSE 0 END AS fp, 0 AS fn FROM top UNION ALL SELECT label, 0, 0, 1 FROM top WHERE cls <> label)"


@R.query("preds", sql=f"WITH {_RANK}, {_TP}, f AS (SELECT c, 2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS f FROM c GROUP BY c) SELECT round(avg(f) + 1e-10, 6) AS f1 FROM f")
def f1_macro(preds):
    return _r(M.f1(preds), "f1")


_MULTI = "m AS (SELECT q, cls, CASE WHEN score > 0.1 THEN 1 ELSE 0 END AS p, CASE WHEN list_contains([label, (label + q % 3) % 10], cls) THEN 1 ELSE 0 END AS t FROM {preds})"


@R.query("preds", sql=f"WITH {_MULTI}, f AS (SELECT cls, coalesce(2.0 * sum(p * t) / nullif(sum(p + t), 0), 0.0) AS f FROM m GROUP BY cls) SELECT round(avg(f) + 1e-10, 6) AS f1 FROM f")
def f1_multilabel_macro(preds):
    return _r(M.f1_multilabel(_labels(preds), threshold=0.1), "f1")


@R.query("preds", sql=f"WITH {_MULTI} SELECT round(2.0 * sum(p * t) / sum(p + t) + 1e-10, 6) AS f1 FROM m")
def f1_multilabel_micro(preds):
    return _r(M.f1_multilabel(_labels(preds), "micro", 0.1), "f1")


@R.query("preds", sql=f"WITH {_RANK}, {_TP} SELECT round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) + 1e-10, 6) AS f1 FROM c")
def f1_micro(preds):
    return _r(M.f1(preds, "micro"), "f1")


@R.query("preds", sql="""
WITH g AS (SELECT cls, round(score, 9) AS s, count(*) AS n, count(CASE WHEN cls = label THEN 1 END) AS p FROM {preds} GROUP BY ALL),
r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY cls ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS r FROM g),
a AS (SELECT cls, sum(p * r) AS rs, sum(p) AS p, sum(n) AS n FROM r GROUP BY cls)
SELECT cls, round((rs - p * (p + 1) / 2.0) / nullif(p * (n - p), 0) + 1e-10, 6) AS auroc FROM a""")
def auroc(preds):
    return _r(M.auroc(preds), "auroc")


_CURVE = """g AS (SELECT cls, round(score, 9) AS s, count(*) AS n, count(CASE WHEN list_contains([label, (label + q % 3) % 10], cls) THEN 1 END) AS p FROM {preds} GROUP BY ALL),
c AS (SELECT cls, s, p, sum(p) OVER w AS tp, sum(n) OVER w AS seen, sum(p) OVER (PARTITION BY cls) AS al FROM g WINDOW w AS (PARTITION BY cls ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
curve AS (SELECT cls, tp::DOUBLE / seen AS pr, tp::DOUBLE / al AS rc, p::DOUBLE / al AS gain FROM c WHERE al > 0)"""


@R.query("preds", sql=f"WITH {_CURVE} SELECT cls, round(sum(gain * pr) + 1e-10, 6) AS ap FROM curve GROUP BY cls")
def average_precision(preds):
    return _r(M.average_precision(_labels(preds)), "ap")


@R.query("preds", sql=f"WITH {_CURVE}, t AS (SELECT cls, t, coalesce(max(CASE WHEN round(rc, 9) >= round(t / 10.0, 9) THEN pr END), 0.0) AS p FROM curve, (SELECT unnest(generate_series(0, 10)) AS t) GROUP BY cls, t) SELECT cls, round(avg(p) + 1e-10, 6) AS ap FROM t GROUP BY cls")
def map_11pt(preds):
    return _r(M.map_11pt(_labels(preds)), "ap")


_ANY = f"{_RANK}, m AS (SELECT q, q % 2 AS half, q % 3 AS third, max(CASE WHEN rank <= 2 AND list_contains([label, (label + q % 3) % 10], cls) THEN 1 ELSE 0 END) AS ok FROM ranked GROUP BY q)"


@R.query("preds", sql=f"WITH {_ANY} SELECT round(avg(ok) + 1e-10, 6) AS accuracy FROM m")
def any_match(preds):
    return _r(M.any_match(_labels(preds), 2), "accuracy")


@R.query("preds", sql=f"WITH {_ANY} SELECT 'all' AS name, '' AS value, round(avg(ok) + 1e-10, 6) AS accuracy FROM m UNION ALL SELECT 'half', CAST(half AS VARCHAR), round(avg(ok) + 1e-10, 6) FROM m GROUP BY half UNION ALL SELECT 'third', CAST(third AS VARCHAR), round(avg(ok) + 1e-10, 6) FROM m GROUP BY third")
def any_match_by(preds):
    p = _labels(preds).withColumn("half", F.col("q") % 2).withColumn("third", F.col("q") % 3)
    return _r(M.any_match(p, 2, ["half", "third"]), "accuracy")


@R.query("preds", sql=f"""WITH {_ANY}, g AS (SELECT DISTINCT q, 'parity' AS variable, CASE WHEN q % 2 = 0 THEN 'even' ELSE 'odd' END AS value FROM {{preds}} UNION ALL SELECT DISTINCT q, 'third', CAST(q % 3 AS VARCHAR) FROM {{preds}})
SELECT variable, value, round(avg(ok) + 1e-10, 6) AS accuracy FROM m JOIN g USING (q) GROUP BY ALL""")
def any_match_groups(preds):
    q = preds.select("q").distinct()
    groups = q.select("q", F.lit("parity").alias("variable"), F.when(F.col("q") % 2 == 0, "even").otherwise("odd").alias("value"))
    groups = groups.unionByName(q.select("q", F.lit("third").alias("variable"), (F.col("q") % 3).cast("string").alias("value")))
    return _r(M.any_match_groups(_labels(preds), groups, 2), "accuracy")


@R.query("preds", sql="""
WITH t AS (SELECT q, score AS t FROM {preds} WHERE cls = label), r AS (SELECT p.q, label, count(CASE WHEN score >= t THEN 1 END) AS r FROM {preds} p JOIN t ON p.q = t.q GROUP BY ALL),
m AS (SELECT label, sum(1.0 / r) / (count(*) + 1e-6) AS m FROM r GROUP BY label) SELECT round(sum(m) / 12.0 + 1e-10, 6) AS mrr FROM m""")
def macro_mrr(preds):
    return _r(M.macro_mrr(preds, 12), "mrr")


@R.query("preds", sql=f"WITH {_RANK} SELECT q, cls AS view, cls * 2 AS turns FROM ranked WHERE rank = 1")
def best_view(preds):
    return M.ranked(preds).where("rank = 1").select("q", F.col("cls").alias("view"), (F.col("cls") * 2).alias("turns"))


@R.query("preds", sql="SELECT q, cls // 2 AS mapped, round(max(score), 6) AS score FROM {preds} GROUP BY q, cls // 2")
def mapped_scores(preds):
    scores = preds.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("cls", "score"))), lambda s: s.score).alias("s"))
    out = scores.select("q", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.greatest(F.get("s", i * 2), F.get("s", i * 2 + 1)))).alias("mapped", "score"))
    return out.select("q", F.col("mapped").cast("long").alias("mapped"), F.round("score", 6).alias("score"))


@R.query("preds", sql="SELECT q AS idx, count(*) AS scores, max(label) AS target FROM {preds} WHERE q >= 10 GROUP BY q")
def aligned_predictions(preds):
    p = preds.withColumn("idx", F.when(F.col("q") < 10, -1).otherwise(F.col("q")))
    targets = preds.groupBy(F.col("q").alias("idx")).agg(F.max("label").alias("target"))
    return p.where("idx >= 0").join(targets, "idx").groupBy("idx").agg(F.count("*").alias("scores"), F.max("target").alias("target"))


_REF = "ref AS (SELECT * FROM (VALUES ('A', 0.5), ('N', 0.6), ('R', 0.4)) AS r(corruption, error))"


@R.query("evals", sql=f"WITH {_REF}, e AS (SELECT corruption, lvl, 1.0 - avg(success) AS e FROM {{evals}} GROUP BY ALL) SELECT e.corruption, round(avg(e) / avg(error) + 1e-10, 6) AS ce FROM e JOIN ref ON e.corruption = ref.corruption GROUP BY e.corruption")
def corruption_errors(evals):
    ref = evals.select("corruption", "lvl").distinct().withColumn("error", F.when(F.col("corruption") == "A", 0.5).when(F.col("corruption") == "N", 0.6).otherwise(0.4))
    return _r(M.mean_corruption_error(evals, ref), "ce")


@R.query("evals", sql="WITH t AS (SELECT rk, scene, avg(ne) AS ne FROM {evals} GROUP BY ALL) SELECT scene, round(avg(ne) + 1e-10, 6) AS ne_mean, round(stddev_samp(ne) + 1e-10, 6) AS ne_std FROM t GROUP BY scene")
def averaged_tries(evals):
    t = evals.groupBy("rk", "scene").agg(F.avg("ne").alias("ne"))
    return _r(M.average_tries(t, ["scene"], ["rk"]), "ne_mean", "ne_std")


@R.query("evals", sql="SELECT scene, round(sum(ne * lvl) / sum(lvl) + 1e-10, 6) AS meter, round(sum(ne * lvl) / (sum(lvl) + 1e-5) + 1e-10, 6) AS reduced FROM {evals} GROUP BY scene")
def running_meters(evals):
    return _r(evals.groupBy("scene").agg(M.running_average(evals, "ne", "lvl").alias("meter"), M.running_average(evals, "ne", "lvl", True).alias("reduced")), "meter", "reduced")


@R.query("evals", sql="WITH g AS (SELECT scene, round(avg(spl), 6) AS spl FROM {evals} GROUP BY scene) SELECT scene, spl FROM g ORDER BY spl DESC, scene LIMIT 1")
def best_config(evals):
    return M.best_config(evals.groupBy("scene").agg(F.round(F.avg("spl"), 6).alias("spl")), "spl", "scene")


@R.query("evals", sql="SELECT rk, round(avg(ne) + 1e-10, 6) AS ne, round(avg(spl) + 1e-10, 6) AS spl FROM {evals} GROUP BY rk")
def reduced_means(evals):
    return _r(evals.groupBy("rk").agg(F.avg("ne").alias("ne"), F.avg("spl").alias("spl")), "ne", "spl")


@R.query("evals", sql="SELECT scene, count(*) AS n, round(avg(x) + 1e-10, 6) AS x FROM (SELECT scene, CASE WHEN line = 3 THEN NULL ELSE ne / lvl END AS x FROM {evals}) WHERE x IS NOT NULL GROUP BY scene")
def finite_rows(evals):
    x = F.when(F.col("line") == 3, F.lit(float("nan"))).otherwise(F.col("ne") / F.col("lvl"))
    return _r(M.finite_only(evals.withColumn("x", x), ["x"]).groupBy("scene").agg(F.count("*").alias("n"), F.avg("x").alias("x")), "x")


_TIE = "concat_ws('|', l_partkey, l_suppkey, price)"


@R.query("evals", sql=f"SELECT scene, episode, rk, line, success FROM (SELECT *, row_number() OVER (PARTITION BY scene, episode ORDER BY rk, line, lpad(CAST(l_partkey AS VARCHAR), 12, '0'), lpad(CAST(l_suppkey AS VARCHAR), 12, '0'), price) AS k FROM {{evals}}) WHERE k = 1")
def merged_logs(evals):
    tie = F.struct(F.lpad(F.col("l_partkey").cast("string"), 12, "0").alias("a"), F.lpad(F.col("l_suppkey").cast("string"), 12, "0").alias("b"), "price")
    return M.merge_logs(evals.withColumn("tie", tie)).select("scene", "episode", "rk", "line", "success")


@R.query("evals", sql="SELECT DISTINCT scene, episode FROM {evals} e WHERE rk >= 4 AND NOT EXISTS (SELECT 1 FROM {evals} d WHERE d.rk < 4 AND d.scene = e.scene AND d.episode = e.episode)")
def resumed(evals):
    done = evals.where("rk < 4").select("scene", "episode")
    return evals.where("rk >= 4").select("scene", "episode").distinct().join(done, ["scene", "episode"], "left_anti")


@R.query("evals", sql="WITH p AS (SELECT DISTINCT CAST(episode AS BIGINT) AS id FROM {evals} WHERE rk = 0) SELECT e.episode, count(*) AS n FROM {evals} e JOIN p ON e.episode = CAST(p.id AS VARCHAR) GROUP BY e.episode")
def ground_truth_lookup(evals):
    paths = evals.where("rk = 0").select(F.col("episode").cast("long").alias("id")).distinct()
    return evals.join(paths, evals["episode"] == paths["id"].cast("string")).groupBy("episode").agg(F.count("*").alias("n"))


@R.query("pixels", sql="SELECT image, round(regr_slope(gt, pred), 5) AS scale, round(regr_intercept(gt, pred), 5) AS shift FROM {pixels} GROUP BY image")
def aligned_depth(pixels):
    a = M.align_affine(pixels)
    return a.select("image", F.round("scale", 5).alias("scale"), F.round("shift", 5).alias("shift"))


_D = ["a1", "a2", "a3", "abs_rel", "sq_rel", "rmse", "rmse_log", "silog", "log10", "mae"]


@R.query("pixels", sql="""
WITH d AS (SELECT image, gt, pred, greatest(gt / pred, pred / gt) AS r, gt - pred AS e, ln(pred) - ln(gt) AS le FROM {pixels} WHERE gt > 0 AND pred > 0)
SELECT image, round(avg(CASE WHEN r < 1.25 THEN 1.0 ELSE 0.0 END) + 1e-9, 5) AS a1, round(avg(CASE WHEN r < 1.5625 THEN 1.0 ELSE 0.0 END) + 1e-9, 5) AS a2, round(avg(CASE WHEN r < 1.953125 THEN 1.0 ELSE 0.0 END) + 1e-9, 5) AS a3, round(avg(abs(e) / gt) + 1e-9, 5) AS abs_rel, round(avg(e * e / gt) + 1e-9, 5) AS sq_rel,
  round(sqrt(avg(e * e)) + 1e-9, 5) AS rmse, round(sqrt(avg(le * le)) + 1e-9, 5) AS rmse_log, round(100 * sqrt(greatest(0.0, avg(le * le) - avg(le) * avg(le))) + 1e-9, 5) AS silog, round(avg(abs(log10(pred) - log10(gt))) + 1e-9, 5) AS log10, round(avg(abs(e)) + 1e-9, 5) AS mae FROM d GROUP BY image""")  # fmt: skip
def depth_metrics(pixels):
    return M.depth_metrics(pixels).select("image", *[F.round(F.col(c) + 1e-9, 5).alias(c) for c in _D])


@R.query("pixels", sql="""
WITH n AS (SELECT p.image, l.g + r.g + u.g + d.g - 4 * p.g AS lap FROM {pixels} p JOIN {pixels} l ON p.image = l.image AND p.v = l.v AND p.u = l.u + 1 JOIN {pixels} r ON p.image = r.image AND p.v = r.v AND p.u = r.u - 1
  JOIN {pixels} u ON p.image = u.image AND p.u = u.u AND p.v = u.v + 1 JOIN {pixels} d ON p.image = d.image AND p.u = d.u AND p.v = d.v - 1)
SELECT image, round(var_pop(lap), 5) AS sharpness, count(*) AS n FROM n GROUP BY image""")
def frame_sharpness(pixels):
    return M.frame_sharpness(pixels).where("n > 0").select("image", F.round("sharpness", 5).alias("sharpness"), "n")


@R.query("pixels", sql="SELECT image, round(-10 * log10(greatest(avg((gt - pred) * (gt - pred)), 1e-12)), 5) AS psnr FROM {pixels} GROUP BY image")
def psnr(pixels):
    return M.psnr(pixels, "gt", "pred").select("image", F.round("psnr", 5).alias("psnr"))


@R.query("pixels", sql="""
WITH n AS (SELECT p.image, l.g + r.g + u.g + d.g - 4 * p.g AS lap FROM {pixels} p JOIN {pixels} l ON p.image = l.image AND p.v = l.v AND p.u = l.u + 1 JOIN {pixels} r ON p.image = r.image AND p.v = r.v AND p.u = r.u - 1
  JOIN {pixels} u ON p.image = u.image AND p.u = u.u AND p.v = u.v + 1 JOIN {pixels} d ON p.image = d.image AND p.u = d.u AND p.v = d.v - 1),
k AS (SELECT image, CASE image % 3 WHEN 0 THEN 'scannet_perspective' WHEN 1 THEN '3rscan_perspective' ELSE 'arkitscenes_perspective' END AS kind, var_pop(lap * 10) AS s FROM n GROUP BY image)
SELECT image, kind, round(s + 1e-9, 5) AS sharpness FROM k WHERE s >= CASE kind WHEN 'scannet_perspective' THEN 120.0 WHEN '3rscan_perspective' THEN 100.0 ELSE 80.0 END""")
def sharp_frames(pixels):
    kinds = pixels.select("image").distinct().withColumn("kind", F.element_at(F.array(*map(F.lit, M.SHARP)), (F.col("image") % 3 + 1).cast("int")))
    return M.sharp_frames(pixels.withColumn("g", F.col("g") * 10), kinds).select("image", "kind", F.round(F.col("sharpness") + 1e-9, 5).alias("sharpness"))


@R.query("pixels", sql="""
WITH o AS (SELECT i, exp(-(i * i) / 4.5) AS g FROM (SELECT unnest(generate_series(-5, 5)) AS i)), k AS (SELECT a.i AS i, b.i AS j, a.g * b.g AS g FROM o a, o b),
s AS (SELECT p.image, p.u, p.v, sum(k.g * q.r) / sum(k.g) AS a, sum(k.g * q.g_) / sum(k.g) AS b, sum(k.g * q.r * q.r) / sum(k.g) AS aa, sum(k.g * q.g_ * q.g_) / sum(k.g) AS bb, sum(k.g * q.r * q.g_) / sum(k.g) AS ab
      FROM {pixels} p CROSS JOIN k JOIN (SELECT image, u, v, r, g AS g_ FROM {pixels}) q ON q.image = p.image AND q.u = p.u + k.i AND q.v = p.v + k.j GROUP BY p.image, p.u, p.v)
SELECT image, round(avg((2 * a * b + 0.0001) * (2 * (ab - a * b) + 0.0009) / ((a * a + b * b + 0.0001) * ((aa - a * a) + (bb - b * b) + 0.0009))), 6) AS ssim FROM s GROUP BY image""")
def ssim(pixels):
    return M.ssim(pixels, "r", "g").select("image", F.round("ssim", 6).alias("ssim"))


@R.query("pixels", sql="""
WITH g AS (SELECT image, u, v FROM (SELECT DISTINCT image FROM {pixels}), (SELECT unnest(generate_series(0, 31)) AS u), (SELECT unnest(generate_series(0, 23)) AS v)),
d AS (SELECT g.*, p.gt AS x FROM g LEFT JOIN {pixels} p ON g.image = p.image AND g.u = p.u AND g.v = p.v),
e AS (SELECT a.image, a.u, a.v, coalesce(any_value(a.x), avg(b.x)) AS x FROM d a JOIN d b ON a.image = b.image AND abs(a.u - b.u) <= 1 AND abs(a.v - b.v) <= 1 GROUP BY a.image, a.u, a.v)
SELECT image, u, v, round(x + 1e-9, 5) AS gt FROM e""")
def filled_depth(pixels):
    return M.fill_depth(pixels, 32, 24, rounds=1).select("image", "u", "v", F.round(F.col("gt") + 1e-9, 5).alias("gt"))


_AREAS = """d AS (SELECT * FROM {seg} WHERE label <> 255), p AS (SELECT pred AS cls, count(*) AS predicted, count(CASE WHEN pred = label THEN 1 END) AS i FROM d GROUP BY pred), t AS (SELECT label AS cls, count(*) AS labelled FROM d GROUP BY label),
a AS (SELECT coalesce(p.cls, t.cls) AS cls, coalesce(i, 0) AS i, coalesce(predicted, 0) AS predicted, coalesce(labelled, 0) AS labelled FROM p FULL JOIN t ON p.cls = t.cls)"""


@R.query("seg", sql=f'WITH {_AREAS} SELECT cls, i AS "intersect", predicted, labelled, predicted + labelled - i AS "union" FROM a')
def seg_areas(seg):
    return M.seg_areas(seg)


@R.query("seg", sql=f"""
WITH {_AREAS}, q AS (SELECT i, labelled, i::DOUBLE / nullif(predicted + labelled - i, 0) AS iou, i::DOUBLE / nullif(labelled, 0) AS rc, i::DOUBLE / nullif(predicted, 0) AS pr, 2.0 * i / nullif(predicted + labelled, 0) AS dice FROM a)
SELECT round(avg(iou) + 1e-10, 6) AS miou, round(avg(rc) + 1e-10, 6) AS acc, round(sum(i)::DOUBLE / sum(labelled) + 1e-10, 6) AS aacc, round(avg(dice) + 1e-10, 6) AS dice, round(avg(pr) + 1e-10, 6) AS precision, round(avg(rc) + 1e-10, 6) AS recall, round(avg(2 * pr * rc / nullif(pr + rc, 0)) + 1e-10, 6) AS fscore FROM q""")
def seg_scores(seg):
    s = M.seg_scores(M.seg_areas(seg))
    return _r(s, *s.columns)


@R.query("objects", sql="SELECT cls, count(*) AS n FROM {objects} GROUP BY cls")
def object_summary(objects):
    return objects.groupBy("cls").agg(F.count("*").alias("n"))


@R.query("objects")
def first_seen_objects(objects):
    o = objects.select("scene", "cls", F.col("x_cm").alias("x"), F.col("y_cm").alias("y"), F.col("z_cm").alias("z"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "price")
    return first_seen(o, 50.0, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "price"]).select("scene", "cls", "x", "y", "z")


@R.query("boxes", sql="SELECT image, cx, cy, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY round(score, 6) DESC, cx, cy, l_partkey, l_suppkey, l_linenumber, price) AS rank FROM (SELECT *, round(score, 6) AS s FROM {boxes})) WHERE rank <= 3".replace("score, rank FROM (", "s AS score, rank FROM ("))
def topk_detections(boxes):
    w = Window.partitionBy("image").orderBy(F.desc("score"), "cx", "cy", "l_partkey", "l_suppkey", "l_linenumber", "price")
    return boxes.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("image", "cx", "cy", "score", "rank")


_SIMS = """e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(generate_series(1, len(embedding))) AS i FROM {vecs}),
sims AS (SELECT a.vec_id AS q, b.vec_id, any_value(b.label) AS label, round(sum(a.x * b.x), 6) AS sim FROM e a JOIN e b ON a.i = b.i WHERE a.vec_id % 50 = 0 GROUP BY a.vec_id, b.vec_id),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, vec_id) AS rank FROM sims) WHERE rank <= 20)"""


def _neighbours(vecs, k=20):
    n = V.knn(vecs.where("vec_id % 50 = 0"), vecs, k)
    return n.withColumn("sim", F.round("sim", 6))


@R.query("vecs", sql=f"WITH {_SIMS} SELECT q, vec_id, label, sim FROM knn WHERE rank <= 5")
def knn(vecs):
    return _neighbours(vecs, 5).select("q", "vec_id", "label", "sim")


@R.query("vecs", sql=f"WITH {_SIMS}, p AS (SELECT q, rank, label, exp((sim - max(sim) OVER (PARTITION BY q)) / 0.07) AS e FROM knn), n AS (SELECT *, e / sum(e) OVER (PARTITION BY q) AS p FROM p) SELECT q, k, label, round(sum(p), 5) AS score FROM n, (SELECT unnest([5, 10, 20]) AS k) WHERE rank <= k GROUP BY q, k, label")
def knn_vote(vecs):
    return V.knn_vote(_neighbours(vecs), [5, 10, 20]).select("q", "k", "label", F.round("score", 5).alias("score"))


@R.query("vecs", sql=f"""WITH u AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) AS size FROM {{vecs}}), e AS (SELECT vec_id, unnest(embedding)::DOUBLE / size AS x, unnest(generate_series(1, len(embedding))) AS i FROM u),
sims AS (SELECT a.vec_id AS q, max(s) AS sim FROM (SELECT a.vec_id, b.vec_id AS o, round(sum(a.x * b.x), 9) AS s FROM e a JOIN e b ON a.i = b.i WHERE a.vec_id <> b.vec_id GROUP BY a.vec_id, b.vec_id) a GROUP BY a.vec_id)
SELECT round(-avg(ln(sqrt(greatest(0.0, 2.0 - 2.0 * sim)) + 1e-8)), 5) AS koleo FROM sims""")
def koleo(vecs):
    """Every unit vector with its nearest other one."""
    unit = vecs.withColumn("embedding", V.l2_normalise("embedding"))
    near = V.knn(unit, unit, 2).where("q <> vec_id").withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("rank"))).where("rank = 1")
    return V.koleo(near, 1).select(F.round("koleo", 5).alias("koleo"))


_GRAM = "e AS (SELECT vec_id, vec_id // 10 AS clip, unnest(embedding)::DOUBLE AS x, unnest(generate_series(1, len(embedding))) AS i FROM {vecs}), gram AS (SELECT a.clip, a.vec_id AS a, b.vec_id AS b, sum(a.x * b.x) AS s FROM e a JOIN e b ON a.clip = b.clip AND a.i = b.i AND a.vec_id <= b.vec_id GROUP BY ALL)"


def _clips(vecs):
    return vecs.withColumn("clip", F.floor(F.col("vec_id") / 10))


@R.query("vecs", sql=f"WITH {_GRAM} SELECT clip, a, b, round(greatest(s, 0.0), 5) AS s FROM gram")
def gram_table(vecs):
    return V.gram(_clips(vecs), "clip", True).select("clip", "a", "b", F.round("s", 5).alias("s"))


@R.query("vecs", sql=f"WITH {_GRAM} SELECT clip, round(avg(pow(s - greatest(s, 0.0), 2)), 6) AS mse FROM gram GROUP BY clip")
def gram_mse(vecs):
    g = _clips(vecs)
    return V.gram_mse(V.gram(g, "clip"), V.gram(g, "clip", True), "clip").select("clip", F.round("mse", 6).alias("mse"))


@R.query("vecs", sql="""
WITH u AS (SELECT vec_id, i, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(generate_series(1, len(embedding))) AS i FROM {vecs})),
l AS (SELECT a.vec_id AS image, b.vec_id AS text, round(sum(a.x * b.x) * exp(1.0), 6) AS logit FROM u a JOIN u b ON a.i = b.i WHERE a.vec_id >= 20 AND b.vec_id < 20 GROUP BY ALL)
SELECT image, text, round(logit, 5) AS logit FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY logit DESC, text) AS k FROM l) WHERE k = 1""")
def best_text(vecs):
    return V.best_text(vecs.where("vec_id >= 20"), vecs.where("vec_id < 20"), 1.0).select("image", "text", F.round("logit", 5).alias("logit"))


@R.query("vecs", sql="SELECT label, count(*) AS n, min(vec_id) AS first, max(vec_id) AS last FROM {vecs} GROUP BY label")
def class_stats(vecs):
    return V.class_stats(vecs)


@R.query("vecs", sql="WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(generate_series(1, len(embedding))) AS i FROM {vecs}) SELECT label, i - 1 AS i, round(avg(x), 6) AS x FROM e GROUP BY label, i")
def mean_vectors(vecs):
    return V.mean_patches(vecs, "label").select("label", F.posexplode("embedding").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


@R.query("vecs", sql="WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM {vecs}) SELECT vec_id, round(sqrt(sum(x * x)), 5) AS norm FROM e GROUP BY vec_id")
def vector_norms(vecs):
    return vecs.select("vec_id", F.round(F.sqrt(V.dot("embedding", "embedding")), 5).alias("norm"))


_ROUND = "b{0} AS (SELECT sample, prototype, p / sum(p) OVER (PARTITION BY prototype) / 10 AS p FROM a{0}), a{1} AS (SELECT sample, prototype, p / sum(p) OVER (PARTITION BY sample) / n AS p FROM b{0}, n)"


@R.query("preds", sql=f"""
WITH n AS (SELECT count(DISTINCT q)::DOUBLE AS n FROM {{preds}}), a0 AS (SELECT q AS sample, cls AS prototype, exp((score - max(score) OVER ()) / 0.1) AS p FROM {{preds}}),
{", ".join(_ROUND.format(i, i + 1) for i in range(3))} SELECT sample, prototype, round(p * n, 6) AS p FROM a3, n""")
def sinkhorn(preds):
    return V.sinkhorn(preds.select(F.col("q").alias("sample"), F.col("cls").alias("prototype"), "score")).select("sample", "prototype", F.round("p", 6).alias("p"))


@R.query("vecs", sql="""
WITH e AS (SELECT vec_id // 10 AS clip, vec_id % 10 AS layer, unnest(embedding)::DOUBLE AS x, unnest(generate_series(1, len(embedding))) AS i, max(vec_id % 10) OVER (PARTITION BY vec_id // 10) AS top FROM {vecs}),
m AS (SELECT clip, count(DISTINCT layer) AS n, max(i) AS d FROM e GROUP BY clip)
SELECT clip, ((layer - top + least(n, 4) - 1) * d + i - 1)::BIGINT AS i, round(x, 6) AS x FROM e JOIN m USING (clip) WHERE layer > top - least(n, 4) UNION ALL SELECT clip, (least(n, 4) * d + i - 1)::BIGINT, round(avg(x), 6) FROM e JOIN m USING (clip) GROUP BY clip, i, n, d""")
def composed_embeddings(vecs):
    d = _clips(vecs).withColumn("layer", F.col("vec_id") % 10)
    return V.compose_embedding(d, d, "clip", "layer", 4).select("clip", F.posexplode("embedding").alias("i", "x")).select("clip", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def _folds(vecs):
    """Fold 0 tests, fold 1 validates, the others train."""
    return [vecs.where(c) for c in ("vec_id % 5 > 1", "vec_id % 5 = 1", "vec_id % 5 = 0")]


@R.query("vecs")
def logreg_sweep(vecs):
    return V.logreg_sweep(*_folds(vecs)[:2])


@R.query("vecs")
def logreg_refit(vecs):
    train, val, test = _folds(vecs)
    return V.logreg_refit(train, val, test, V.logreg_sweep(train, val)).select("vec_id", "label", "predicted")


_SAMPLES = """best AS (SELECT q, any_value(label) AS label, arg_max(cls, score - cls * 1e-9) AS best, min(CASE WHEN cls = label THEN rank END) AS place FROM ranked GROUP BY q),
f AS (SELECT cls, sum(n) AS n, sum(g) AS g, sum(h) AS h FROM (SELECT label AS cls, 1 AS n, 0 AS g, CASE WHEN best = label THEN 1 ELSE 0 END AS h FROM best UNION ALL SELECT best, 0, 1, 0 FROM best) GROUP BY cls),
c AS (SELECT label, avg(CASE WHEN place <= 3 THEN 1.0 ELSE 0.0 END) AS top3, avg(1.0 / place) AS mrr FROM best GROUP BY label)"""


@R.query("preds", sql=f"""WITH {_RANK}, {_SAMPLES}
SELECT 'top1' AS metric, round(avg(CASE WHEN place <= 1 THEN 1.0 ELSE 0.0 END), 6) AS value FROM best UNION ALL SELECT 'top3_macro', round(avg(top3), 6) FROM c
UNION ALL SELECT 'mrr_macro', round(avg(mrr), 6) FROM c UNION ALL SELECT 'f1_macro', round(avg(2.0 * h / (n + g)), 6) FROM f UNION ALL SELECT 'f1_micro', round(2.0 * sum(h) / sum(n + g), 6) FROM f""")
def evaluated_metrics(preds):
    """Five metrics of all predictions in one pass."""
    scores = F.transform(F.array_sort(F.collect_list(F.struct("cls", "score"))), lambda s: s.score)
    samples = preds.groupBy(F.col("q").alias("index")).agg(scores.alias("preds"), F.max("label").alias("target"))
    asked = {"top1": callables.accuracy(1), "top3_macro": callables.accuracy(3, "macro"), "mrr_macro": callables.reciprocal_rank("macro"), "f1_macro": callables.f1(), "f1_micro": callables.f1("micro")}
    return callables.evaluate_fused(samples, asked).withColumn("value", F.round("value", 6))


@R.query("vecs", sql="SELECT vec_id, round(sqrt(label::DOUBLE), 6) AS value, round(ln(1 + label::DOUBLE), 6) AS other FROM {vecs}")
def named_callables(vecs):
    """Functions of a user's module, named by their paths, over a column of the whole table."""
    spark = vecs.sparkSession
    callables.register_vectorised(spark, "posegrid_root", "numpy:sqrt", "double")
    callables.register_vectorised(spark, "posegrid_log1p", "numpy:log1p", "double")
    return vecs.selectExpr("vec_id", "round(posegrid_root(cast(label AS double)), 6) AS value", "round(posegrid_log1p(cast(label AS double)), 6) AS other")


QUERIES, SQL = R.queries, R.sql
