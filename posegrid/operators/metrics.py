"""Evaluation metrics: classification, depth, segmentation, image quality, run logs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def ranked(preds: DataFrame) -> DataFrame:
    """preds (q, cls, score, label) with rank by score, ties by class."""
    return preds.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cls")))


def topk_accuracy(preds: DataFrame, ks: list[int], average: str = "micro") -> DataFrame:
    """k and accuracy (micro or macro), or k, label and accuracy for average 'none'. Top-k recall
    of single labels is the same number."""
    hit = ranked(preds).groupBy("q", "label").agg(F.min(F.when(F.col("cls") == F.col("label"), F.col("rank"))).alias("at"))
    each = hit.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).withColumn("ok", (F.coalesce("at", F.lit(10**9)) <= F.col("k")).cast("double"))
    if average == "micro":
        return each.groupBy("k").agg(F.avg("ok").alias("accuracy"))
    per = each.groupBy("k", "label").agg(F.avg("ok").alias("accuracy"))
    return per if average == "none" else per.groupBy("k").agg(F.avg("accuracy").alias("accuracy"))


def f1(preds: DataFrame, average: str = "macro") -> DataFrame:
    """One row, f1 of top-1 predictions. Macro is over classes met as label or prediction."""
    top = ranked(preds).where("rank = 1").select("cls", "label")
    each = top.select(F.col("cls").alias("c"), (F.col("cls") == F.col("label")).cast("int").alias("tp"), (F.col("cls") != F.col("label")).cast("int").alias("fp"), F.lit(0).alias("fn"))
    each = each.unionByName(top.where("cls <> label").select(F.col("label").alias("c"), F.lit(0).alias("tp"), F.lit(0).alias("fp"), F.lit(1).alias("fn")))
    score = 2.0 * F.sum("tp") / F.nullif(2.0 * F.sum("tp") + F.sum("fp") + F.sum("fn"), F.lit(0.0))
    if average == "micro":
        return each.agg(score.alias("f1"))
    return each.groupBy("c").agg(score.alias("f")).agg(F.avg("f").alias("f1"))


def f1_multilabel(preds: DataFrame, average: str = "macro", threshold: float = 0.5) -> DataFrame:
    """One row, f1 of scores above the threshold against label sets (`labels`). Macro is over all
    classes scored; a class never predicted nor true counts 0."""
    said, true = (F.col("score") > threshold).cast("int"), F.array_contains("labels", F.col("cls")).cast("int")
    d = preds.select("cls", said.alias("p"), true.alias("t"))
    score = F.coalesce(2.0 * F.sum(F.col("p") * F.col("t")) / F.nullif(F.sum(F.col("p") + F.col("t")).cast("double"), F.lit(0.0)), F.lit(0.0))
    return d.agg(score.alias("f1")) if average == "micro" else d.groupBy("cls").agg(score.alias("f")).agg(F.avg("f").alias("f1"))


def auroc(preds: DataFrame) -> DataFrame:
    """cls, auroc: one against rest by average ranks (Mann-Whitney), exact with ties."""
    s = F.round("score", 9)
    groups = preds.groupBy("cls", s.alias("s")).agg(F.count("*").alias("n"), F.count(F.when(F.col("cls") == F.col("label"), 1)).alias("p"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy("cls").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = groups.withColumn("r", below + (F.col("n") + 1) / 2.0)
    a = r.groupBy("cls").agg(F.sum(F.col("p") * F.col("r")).alias("rs"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return a.select("cls", ((F.col("rs") - F.col("p") * (F.col("p") + 1) / 2.0) / F.nullif(F.col("p") * (F.col("n") - F.col("p")), F.lit(0))).alias("auroc"))


def pr_curve(preds: DataFrame) -> DataFrame:
    """cls, s, precision, recall, gain (of recall) at every distinct score, ties together. Relevant
    is whether cls is in labels."""
    s = F.round("score", 9)
    g = preds.groupBy("cls", s.alias("s")).agg(F.count("*").alias("n"), F.count(F.when(F.array_contains("labels", F.col("cls")), 1)).alias("p"))
    w = Window.partitionBy("cls").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    c = g.withColumn("tp", F.sum("p").over(w)).withColumn("seen", F.sum("n").over(w)).withColumn("all", F.sum("p").over(Window.partitionBy("cls"))).where(F.col("all") > 0)
    return c.select("cls", "s", (F.col("tp") / F.col("seen")).alias("precision"), (F.col("tp") / F.col("all")).alias("recall"), (F.col("p") / F.col("all")).alias("gain"))


def average_precision(preds: DataFrame) -> DataFrame:
    return pr_curve(preds).groupBy("cls").agg(F.sum(F.col("gain") * F.col("precision")).alias("ap"))


def map_11pt(preds: DataFrame) -> DataFrame:
    """cls, ap: mean over recalls 0, 0.1 .. 1 of the greatest precision at that recall or more."""
    t = pr_curve(preds).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(10))))
    at = t.groupBy("cls", "t").agg(F.coalesce(F.max(F.when(F.round(F.col("recall"), 9) >= F.round(F.col("t") / 10.0, 9), F.col("precision"))), F.lit(0.0)).alias("p"))
    return at.groupBy("cls").agg(F.avg("p").alias("ap"))


def any_match(preds: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """Share of samples with any of the top k in their label set; samples without labels don't count.
    by: also for each value of each of these columns (grouping sets of one column, and of none)."""
    cols = by or []
    top = ranked(preds).where(F.size("labels") > 0).groupBy("q", *cols).agg(F.max((F.array_contains("labels", F.col("cls")) & (F.col("rank") <= k)).cast("int")).alias("ok"))
    if not cols:
        return top.agg(F.avg("ok").alias("accuracy"))
    named = [F.lit(c) for c in cols]
    each = top.select("ok", F.explode(F.array(F.struct(F.lit("all").alias("name"), F.lit("").alias("value")), *[F.struct(n.alias("name"), F.col(c).cast("string").alias("value")) for n, c in zip(named, cols)])).alias("g"))
    return each.groupBy("g.name", "g.value").agg(F.avg("ok").alias("accuracy"))


def any_match_groups(preds: DataFrame, groups: DataFrame, k: int = 1) -> DataFrame:
    """variable, value, accuracy: any_match by a table of labels (q, variable, value). A sample
    counts in each group it is listed in; samples not listed are left out."""
    top = ranked(preds).where(F.size("labels") > 0).groupBy("q").agg(F.max((F.array_contains("labels", F.col("cls")) & (F.col("rank") <= k)).cast("int")).alias("ok"))
    return top.join(groups, "q").groupBy("variable", "value").agg(F.avg("ok").alias("accuracy"))


def macro_mrr(preds: DataFrame, classes: int) -> DataFrame:
    """One row: rank is the number of scores at least the target's; a class's sum / (n + 1e-6), mean
    over all `classes`."""
    target = preds.where("cls = label").select("q", F.col("score").alias("_t"))
    rank = preds.join(target, "q").groupBy("q", "label").agg(F.count(F.when(F.col("score") >= F.col("_t"), 1)).alias("r"))
    per = rank.groupBy("label").agg((F.sum(1.0 / F.col("r")) / (F.count("*") + 1e-6)).alias("m"))
    return per.agg((F.sum("m") / F.lit(float(classes))).alias("mrr"))


def mean_corruption_error(evals: DataFrame, reference: DataFrame) -> DataFrame:
    """corruption, ce: mean error over the mean reference error (corruption, lvl, error)."""
    per = evals.groupBy("corruption", "lvl").agg((1.0 - F.avg("success")).alias("e"))
    return per.join(F.broadcast(reference), ["corruption", "lvl"]).groupBy("corruption").agg((F.avg("e") / F.avg("error")).alias("ce"))


def average_tries(rows: DataFrame, keys: list[str], ignore: list[str] = []) -> DataFrame:  # noqa: B006
    cols = [c for c in rows.columns if c not in keys and c not in ignore]
    return rows.groupBy(*keys).agg(*[f(c).alias(f"{c}_{n}") for c in cols for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


def running_average(rows: DataFrame, value: str, weight: str, reduced: bool = False) -> Column:
    v, n = F.sum(F.col(value) * F.col(weight)), F.sum(weight)
    return v / (n + 1e-5) if reduced else v / F.nullif(n, F.lit(0))


def best_config(grid: DataFrame, metric: str, order: str) -> DataFrame:
    """The first row of the greatest metric."""
    return grid.orderBy(F.desc(metric), order).limit(1)


def align_affine(pixels: DataFrame) -> DataFrame:
    """image, scale, shift of the least-squares line from pred to gt; nulls on constant predictions."""
    return pixels.groupBy("image").agg(F.regr_slope("gt", "pred").alias("scale"), F.regr_intercept("gt", "pred").alias("shift"))


def depth_metrics(pixels: DataFrame) -> DataFrame:
    """Per-image depth metrics over pixels with gt > 0 and pred > 0."""
    d = pixels.where("gt > 0 AND pred > 0")
    ratio = F.greatest(F.col("gt") / F.col("pred"), F.col("pred") / F.col("gt"))
    e, le = F.col("gt") - F.col("pred"), F.log("pred") - F.log("gt")
    cols = [F.avg((ratio < 1.25**k).cast("double")).alias(f"a{k}") for k in (1, 2, 3)]
    cols += [F.avg(F.abs(e) / F.col("gt")).alias("abs_rel"), F.avg(e * e / F.col("gt")).alias("sq_rel"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sqrt(F.avg(le * le)).alias("rmse_log")]
    cols += [(100.0 * F.sqrt(F.greatest(F.lit(0.0), F.avg(le * le) - F.avg(le) * F.avg(le)))).alias("silog"), F.avg(F.abs(F.log10("pred") - F.log10("gt"))).alias("log10"), F.avg(F.abs(e)).alias("mae")]
    return d.groupBy("image").agg(*cols)


def frame_sharpness(pixels: DataFrame, value: str = "g") -> DataFrame:
    """image, sharpness: population variance of the 4-neighbour Laplacian where all four exist."""
    row, col = Window.partitionBy("image", "v").orderBy("u"), Window.partitionBy("image", "u").orderBy("v")
    at = lambda w, c, k: F.when(F.lag(c, k).over(w) == F.col(c) - k, F.lag(value, k).over(w))
    lap = at(row, "u", 1) + at(row, "u", -1) + at(col, "v", 1) + at(col, "v", -1) - 4 * F.col(value)
    return pixels.withColumn("_l", lap).groupBy("image").agg(F.var_pop("_l").alias("sharpness"), F.count("_l").alias("n"))


#: Least sharpness of a frame by its kind.
SHARP = {"scannet_perspective": 120.0, "3rscan_perspective": 100.0, "arkitscenes_perspective": 80.0}


def sharp_frames(pixels: DataFrame, kinds: DataFrame, value: str = "g", least: dict[str, float] | None = None) -> DataFrame:
    """image, kind, sharpness of frames (image, kind) at least as sharp as their kind asks for; kinds
    without a threshold, and frames without a Laplacian, are dropped."""
    asked = F.lit(None).cast("double")
    for kind, t in (SHARP if least is None else least).items():
        asked = F.when(F.col("kind") == kind, t).otherwise(asked)
    return frame_sharpness(pixels, value).join(kinds.select("image", "kind"), "image").where(F.col("sharpness") >= asked).select("image", "kind", "sharpness")


def seg_areas(seg: DataFrame, ignore: int = 255) -> DataFrame:
    """cls with intersect, predicted, label and union areas, without ignored pixels."""
    d = seg.where(F.col("label") != ignore)
    p = d.groupBy(F.col("pred").alias("cls")).agg(F.count("*").alias("predicted"), F.count(F.when(F.col("pred") == F.col("label"), 1)).alias("intersect"))
    t = d.groupBy(F.col("label").alias("cls")).agg(F.count("*").alias("labelled"))
    z = [F.coalesce(c, F.lit(0)).alias(c) for c in ("intersect", "predicted", "labelled")]
    return p.join(t, "cls", "full").select("cls", *z).withColumn("union", F.col("predicted") + F.col("labelled") - F.col("intersect"))


def seg_scores(areas: DataFrame, beta: float = 1.0) -> DataFrame:
    """One row: mIoU, mean accuracy, all-pixel accuracy, dice, precision, recall, F-beta; 0/0 is left out."""
    q = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    pr, rc = q("intersect", "predicted"), q("intersect", "labelled")
    f = (1 + beta * beta) * pr * rc / F.nullif(beta * beta * pr + rc, F.lit(0.0))
    dice = 2.0 * F.col("intersect") / F.nullif(F.col("predicted") + F.col("labelled"), F.lit(0))
    return areas.agg(F.avg(q("intersect", "union")).alias("miou"), F.avg(rc).alias("acc"), (F.sum("intersect") / F.sum("labelled")).alias("aacc"), F.avg(dice).alias("dice"), F.avg(pr).alias("precision"), F.avg(rc).alias("recall"), F.avg(f).alias("fscore"))


def psnr(pixels: DataFrame, a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    return pixels.groupBy("image").agg((-10.0 * F.log10(F.greatest(F.avg(d * d), F.lit(1e-12)))).alias("psnr"))


#: Pixels of an image that a task holds at once, beside the rows that the window reaches around them.
BAND = 1 << 20


def _smooth(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Sums weighed by the kernel along both axes; nothing lies beyond the borders."""
    reach = len(kernel) // 2
    for axis in (0, 1):
        wide = np.pad(x, [(reach, reach) if i == axis else (0, 0) for i in range(2)])
        n = x.shape[axis]
        x = sum(k * (wide[i : i + n] if axis == 0 else wide[:, i : i + n]) for i, k in enumerate(kernel))
    return x


def _ssim_sum(v: np.ndarray, u: np.ndarray, a: np.ndarray, b: np.ndarray, kernel: np.ndarray, low: int, high: int) -> tuple[float, int]:
    """Sum and number of the values of the pixels given in rows low to high - 1, which those of the
    rows around them are given for as well."""
    own = (v >= low) & (v < high)
    if not own.any():
        return 0.0, 0
    top, left = int(v.min()), int(u.min())
    shape = int(v.max()) - top + 1, int(u.max()) - left + 1
    grids = []
    for x in (np.ones(len(a)), a, b, a * a, b * b, a * b):
        grid = np.zeros(shape)
        grid[v - top, u - left] = x
        grids.append(_smooth(grid, kernel)[v[own] - top, u[own] - left])
    w, ma, mb, aa, bb, ab = grids
    ma, mb, aa, bb, ab = (x / w for x in (ma, mb, aa, bb, ab))
    c1, c2 = 0.01**2, 0.03**2
    s = (2 * ma * mb + c1) * (2 * (ab - ma * mb) + c2) / ((ma * ma + mb * mb + c1) * ((aa - ma * ma) + (bb - mb * mb) + c2))
    return float(s.sum()), int(own.sum())


def ssim(pixels: DataFrame, a: str, b: str, sigma: float = 1.5, reach: int = 5, band: int = BAND) -> DataFrame:
    """image, ssim with a Gaussian window; absent pixels, and those with a null value, are left out
    and the weights renormalised. Each place of an image has one pixel.

    The table is shuffled once, to images sorted by rows of pixels. A task takes an image in bands
    of rows of about `band` pixels, with `reach` rows before and after, and sends sum and number."""
    kernel = np.array([math.exp(-(o * o) / (2 * sigma * sigma)) for o in range(-reach, reach + 1)])
    d = pixels.select("image", F.col("v").cast("long").alias("v"), F.col("u").cast("long").alias("u"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    d = d.where("image IS NOT NULL AND u IS NOT NULL AND v IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL").repartition("image").sortWithinPartitions("image", "v", "u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
        image, low = None, None
        out: list[tuple] = []

        def done(high: int) -> None:
            nonlocal low, held
            total, n = _ssim_sum(*held, kernel, low, high)
            if n:
                out.append((image, total, n))
            keep = held[0] >= high - reach
            low, held = high, [x[keep] for x in held]

        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column("image").to_pylist()
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("v", "u", "a", "b")]
            cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if names[i] != image:
                    if len(held[0]):
                        done(int(held[0][-1]) + 1)
                    image, held = names[i], [x[:0] for x in held]
                    low = int(cols[0][i])
                held = [np.concatenate([x, c[i:j]]) for x, c in zip(held, cols)]
                if (held[0] >= low).sum() > band and held[0][-1] - reach > low:
                    done(int(held[0][-1]) - reach)  # the last row may go on in the next batch
            yield pa.RecordBatch.from_pylist([{"image": i, "total": t, "n": n} for i, t, n in out], schema) if out else pa.RecordBatch.from_pylist([], schema)
            out.clear()
        if len(held[0]):
            done(int(held[0][-1]) + 1)
        yield pa.RecordBatch.from_pylist([{"image": i, "total": t, "n": n} for i, t, n in out], schema)

    kind = d.schema["image"].dataType
    schema = pa.schema([("image", to_arrow_type(kind)), ("total", pa.float64()), ("n", pa.int64())])
    sums = d.mapInArrow(run, f"image {kind.simpleString()}, total double, n long")
    return sums.groupBy("image").agg((F.sum("total") / F.sum("n")).alias("ssim"))


def fill_depth(pixels: DataFrame, width: int, height: int, reach: int = 1, rounds: int = 2, value: str = "gt") -> DataFrame:
    """image, u, v, value, filled: missing pixels of each image's grid get the mean of present ones
    in a box, in rounds; given ones stay. Boxes are clipped at the border."""
    grid = pixels.select("image").distinct().select("image", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("u")).select("image", "u", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("v"))
    d = grid.join(pixels.select("image", F.col("u").cast("int").alias("u"), F.col("v").cast("int").alias("v"), F.col(value).alias("x")), ["image", "u", "v"], "left").withColumn("given", F.col("x").isNotNull())
    for _ in range(rounds):
        wu, wv = Window.partitionBy("image", "v").orderBy("u").rangeBetween(-reach, reach), Window.partitionBy("image", "u").orderBy("v").rangeBetween(-reach, reach)
        d = d.withColumn("_s", F.sum("x").over(wu)).withColumn("_n", F.count("x").over(wu))
        d = d.withColumn("_s2", F.sum("_s").over(wv)).withColumn("_n2", F.sum("_n").over(wv))
        d = d.withColumn("x", F.coalesce("x", F.col("_s2") / F.nullif(F.col("_n2"), F.lit(0)))).drop("_s", "_n", "_s2", "_n2")
    return d.select("image", "u", "v", F.col("x").alias(value), (~F.col("given") & F.col("x").isNotNull()).alias("filled"))


def merge_logs(rows: DataFrame) -> DataFrame:
    """First row of each (scene, episode) by rank, line and `tie`; rows without keys dropped."""
    w = Window.partitionBy("scene", "episode").orderBy("rk", "line", "tie")
    return rows.where("scene IS NOT NULL AND episode IS NOT NULL").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def finite_only(rows: DataFrame, cols: list[str]) -> DataFrame:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    return rows.where(cond)
