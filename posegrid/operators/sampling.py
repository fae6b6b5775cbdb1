"""Seeded sampling, splits, plans and batches. Order is by md5 of seed and key, so a draw is the
same on any cluster. Plans are ranked by ranges of their order, whatever the number of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from posegrid.operators.ranks import numbered, numbered_within
from posegrid.rand import seeded, uniform


def sample_per_group(rows: DataFrame, group: list[str], k: int, seed: int, key: list[str], tie: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(seeded(seed, *key), *(tie or key))
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def shard(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """Rows with shard: their place in order modulo n."""
    return numbered(rows, order, "shard").withColumn("shard", (F.col("shard") % n).cast("int"))


def few_shot(rows: DataFrame, n_or_p: float, tries: int, label: str = "label", key: str = "vec_id") -> DataFrame:
    """try, rows: n of each class (n_or_p >= 1) or max(1, floor(p * size)), one subset a try."""
    t = rows.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    size = F.count("*").over(Window.partitionBy("try", label))
    k = F.lit(int(n_or_p)) if n_or_p >= 1 else F.greatest(F.lit(1), F.floor(size * n_or_p))
    w = Window.partitionBy("try", label).orderBy(seeded("few", "try", key), key)
    return t.withColumn("_k", F.row_number().over(w)).withColumn("_n", k).where("_k <= _n").drop("_k", "_n")


def stratified_split(rows: DataFrame, p: float, seed: int, label: str = "label", key: str = "vec_id") -> DataFrame:
    """Rows with val: max(1, floor(p * size)) of each class; classes of one row stay in train."""
    w = Window.partitionBy(label)
    n, k = F.count("*").over(w), F.row_number().over(w.orderBy(seeded(seed, key), key))
    return rows.withColumn("val", (n > 1) & (k <= F.greatest(F.lit(1), F.floor(n * p))))


def rebalance_multilabel(rows: DataFrame, p: float, seed: int, key: str = "q", labels: str = "labels") -> DataFrame:
    """A draw of a share p of rows whose labels come near p of all labels: the share is rescaled once
    by wanted over drawn labels."""
    u = rows.withColumn("_u", uniform(seed, key))
    total = u.agg(F.sum(F.size(labels)).alias("all"), F.sum(F.when(F.col("_u") < p, F.size(labels))).alias("got")).first()
    scale = p * total["all"] / max(1, total["got"] or 0) if total["all"] else 1.0
    return u.where(F.col("_u") < F.lit(p * scale)).drop("_u")


def epoch_plan(items: DataFrame, key: str, workers: int, size: int | None = None, seed: int | None = None) -> DataFrame:
    """i, item, worker: the items, in the order of their key, tiled to size (as many as there are by
    default), permuted if seeded, dealt in strides."""
    first = numbered(items.select(F.col(key).alias("item")), ["item"], "_p")
    n = first.count()
    size = n if size is None else size
    tiles = F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-size // max(1, n)) - 1))))
    d = first.withColumn("_t", tiles).select((F.col("_t").cast("long") * n + F.col("_p")).alias("i"), "item").where(F.col("i") < size)
    if seed is not None:
        d = numbered(d, [seeded(seed, "i"), "i"]).select(F.col("place").alias("i"), "item")
    return d.withColumn("worker", F.col("i") % workers)


def infinite_plan(items: DataFrame, key: str, passes: int, advance: int, workers: int) -> DataFrame:
    """Of an endless strided plan over the items, in the order of their key, the part from `advance`
    on to the end of the given number of passes: i, item, worker."""
    first = numbered(items.select(F.col(key).alias("item")), ["item"], "_p")
    d = first.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).select((F.col("_t").cast("long") * first.count() + F.col("_p")).alias("i"), "item")
    return d.where(F.col("i") >= advance).withColumn("worker", F.col("i") % workers)


def sharded_plan(items: DataFrame, key: str, passes: int, workers: int, seed: int) -> DataFrame:
    """pass, worker, place, item: items permuted once and dealt to workers, the remainder dropped,
    and each worker's share permuted anew each pass."""
    dealt = numbered(items.select(F.col(key).alias("item")), [seeded(seed, "item"), "item"], "_k")
    dealt = dealt.where(F.col("_k") < dealt.count() // workers * workers).withColumn("worker", F.col("_k") % workers)
    each = dealt.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).select("pass", "worker", "item")
    return numbered_within(each, ["pass", "worker"], [seeded(seed, F.shiftleft(F.col("pass"), 24), F.col("item")), "item"]).select("pass", "worker", "place", "item")


def weighted_draw(spark: SparkSession, weights: list[tuple[str, float]], files: DataFrame, n: int, seed: int) -> DataFrame:
    """i, source, item: n draws with replacement, a source by weight, then a file (source, k from 0,
    n) evenly."""
    total, low, bounds = sum(w for _, w in weights), 0.0, []
    for s, w in weights:
        bounds.append((s, low / total, (low + w) / total))
        low += w
    pick: Column | None = None
    for s, _, hi in bounds[:-1]:
        pick = F.when(F.col("u") < hi, s) if pick is None else pick.when(F.col("u") < hi, s)
    last = F.lit(bounds[-1][0])
    draws = spark.range(n).select(F.col("id").alias("i"), uniform(seed, "id").alias("u")).withColumn("source", last if pick is None else pick.otherwise(last))
    sizes = files.groupBy("source").agg(F.count("*").alias("_n"))
    second = draws.join(sizes, "source").withColumn("k", seeded(f"{seed}b", "i") % F.col("_n"))
    return second.join(files, ["source", "k"]).select("i", "source", "item")


def cyclic_plan(spark: SparkSession, sources: list[str], files: DataFrame, n: int, seed: int) -> DataFrame:
    """i, source, item: sources in turn, an item of the source at random."""
    at = F.element_at(F.array(*map(F.lit, sources)), (F.col("id") % len(sources) + 1).cast("int"))
    d = spark.range(n).select(F.col("id").alias("i"), at.alias("source"))
    sizes = files.groupBy("source").agg(F.count("*").alias("_n"))
    return d.join(sizes, "source").withColumn("k", seeded(seed, "i") % F.col("_n")).join(files, ["source", "k"]).select("i", "source", "item")


def mix_sources(spark: SparkSession, weights: list[tuple[str, float]], files: DataFrame, n: int, seed: int) -> DataFrame:
    """i, source, item: draws of sources by probability; each source gives its items in order; the
    plan ends before the first draw from an empty source."""
    low, pick = 0.0, None
    for s, w in weights[:-1]:
        low += w
        pick = F.when(F.col("u") < low, s) if pick is None else pick.when(F.col("u") < low, s)
    last = F.lit(weights[-1][0])
    d = spark.range(n).select(F.col("id").alias("i"), uniform(seed, "id").alias("u")).withColumn("source", last if pick is None else pick.otherwise(last))
    d = d.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("i")) - 1)
    met = d.join(files, ["source", "k"], "left")
    stop = met.agg(F.min(F.when(F.col("item").isNull(), F.col("i"))).alias("stop"))
    return met.crossJoin(F.broadcast(stop)).where(F.col("stop").isNull() | (F.col("i") < F.col("stop"))).select("i", "source", "item")


def scene_blocks(eps: DataFrame, size: int, seed: int) -> DataFrame:
    """scene, block, slot, episode: fixed blocks of `size` a scene; the last is padded by seeded
    draws from itself."""
    w = Window.partitionBy("scene")
    d = eps.withColumn("k", F.row_number().over(w.orderBy(seeded(seed, "episode"), "episode")) - 1).withColumn("block", F.floor(F.col("k") / size)).withColumn("slot", F.col("k") % size)
    own = d.withColumn("_n", F.count("*").over(Window.partitionBy("scene", "block")))
    short = own.where(F.col("_n") < size).select("scene", "block", "_n").distinct()
    pads = short.withColumn("slot", F.explode(F.sequence(F.col("_n"), F.lit(size - 1)))).withColumn("_from", seeded(seed, "scene", "block", "slot") % F.col("_n"))
    filled = pads.join(own.select("scene", "block", F.col("slot").alias("_from"), "episode"), ["scene", "block", "_from"])
    return d.select("scene", "block", "slot", "episode").unionByName(filled.select("scene", "block", "slot", "episode"))


def assign_workers(blocks: DataFrame, workers: int, batch: int) -> DataFrame:
    """place, worker, batch with the rows of blocks: blocks in round-robin order over scenes, the
    list padded from its head to a multiple of workers, contiguous ranges for workers."""
    each = numbered(blocks.select("scene", "block").distinct(), ["block", "scene"])
    n = each.count()
    pad = (-n) % workers
    padded = each.unionByName(each.where(F.col("place") < pad).withColumn("place", F.col("place") + n))
    share = max(1, (n + pad) // workers)
    return padded.withColumn("worker", F.floor(F.col("place") / share)).join(blocks, ["scene", "block"]).withColumn("batch", F.floor(F.col("slot") / batch))


#: Shares of path lengths 3-6, 6-10 and 10-15 m.
BUCKETS = ((3.0, 6.0, 0.2), (6.0, 10.0, 0.3), (10.0, 15.0, 0.5))


#: Styles of instructions and what they do to path lengths.
STYLE_SCALES = {"r2r": 1.0, "reverie": 0.5, "demand": 0.5}


def style_scale(style: Column) -> Column:
    """Scale of path lengths by style; 1 for other styles and null."""
    scale = F.lit(1.0)
    for name, x in STYLE_SCALES.items():
        scale = F.when(style == name, x).otherwise(scale)
    return scale


def bucket_draw(rows: DataFrame, key: str | list[str], seed: int, style: str | None = None) -> DataFrame:
    """Rows with low, high: a length bucket by the fixed shares, scaled by the column `style` if named."""
    if style is not None:
        scale = style_scale(F.col(style))
        return bucket_draw(rows, key, seed).withColumn("low", F.col("low") * scale).withColumn("high", F.col("high") * scale)
    u = uniform(seed, *([key] if isinstance(key, str) else key))
    first, second = BUCKETS[0][2], BUCKETS[0][2] + BUCKETS[1][2]
    three = lambda i: F.when(u < first, BUCKETS[0][i]).when(u < second, BUCKETS[1][i]).otherwise(BUCKETS[2][i])
    return rows.withColumn("low", three(0)).withColumn("high", three(1))


def idf_choice(candidates: DataFrame, counts: DataFrame, seed: int, excluded: tuple[str, ...] = ()) -> DataFrame:
    """scene, cls, d: of each scene's candidate classes (nearest instance each) one is drawn with
    weight 1 / (count + 1); counts are those of the round before."""
    near = candidates.where(~F.col("cls").isin(*excluded) if excluded else F.lit(True)).groupBy("scene", "cls").agg(F.min("d").alias("d"))
    weighted = near.join(counts, "cls", "left").withColumn("w", 1.0 / (F.coalesce("n", F.lit(0)) + 1.0))
    w = Window.partitionBy("scene")
    upto = F.sum("w").over(w.orderBy("cls").rowsBetween(Window.unboundedPreceding, 0))
    d = weighted.withColumn("_to", upto / F.sum("w").over(w)).where(F.round("_to", 9) > uniform(seed, "scene"))
    return d.withColumn("_k", F.row_number().over(w.orderBy("_to", "cls"))).where("_k = 1").select("scene", "cls", "d")
