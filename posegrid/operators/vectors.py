"""Embedding operators: nearest neighbours, votes, spread, Gram tables, probes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posegrid.session import discard, materialise, ship

#: Vectors of a lot, and those that a lot is multiplied with at a time.
BLOCK, COLUMNS = 4096, 512


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: str | Column, eps: float = 1e-12) -> Column:
    # the size is repeated, as within a function of the elements it would be computed for each of them
    size = F.array_repeat(F.greatest(F.sqrt(dot(v, v)), F.lit(eps)), F.size(v))
    return F.zip_with(v, size, lambda x, s: x.cast("double") / s)


def softmax(v: str | Column, temperature: float = 1.0) -> Column:
    e = F.transform(v, lambda x: F.exp((x - F.array_max(v)) / temperature))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column as rows; all have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _dealt(corpus: DataFrame, centres: np.ndarray) -> DataFrame:
    """corpus with cell, the nearest centre, and its distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (centres**2).sum(1) / 2
        for batch in batches:
            if batch.num_rows:
                e = _matrix(batch.column("embedding"))
                cell = (half - e @ centres.T).argmin(1)
                far = np.sqrt(((e - centres[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far)], [*batch.schema.names, "cell", "far"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in corpus.schema)
    return corpus.mapInArrow(run, f"{kinds}, cell int, far double")


def _span(e: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A floor under the products of each of e with all vectors of each cell, and a ceiling over them."""
    mid, norm = e @ centres.T, np.sqrt((e**2).sum(1))[:, None]
    slack = norm * radius + 1e-6 * (1 + norm * (radius + np.sqrt((centres**2).sum(1))))
    return mid - slack, mid + slack


def _asked(queries: DataFrame, centres: np.ndarray, size: np.ndarray, radius: np.ndarray, want: int) -> DataFrame:
    """queries (q, embedding) with cells, those that may hold one of the `want` nearest, and bound,
    which none of the nearest lies under.

    For x in a cell of centre c and radius r, |q.x - q.c| <= |q| r. So each cell gives a floor under
    the products of all its vectors and a ceiling over them; the highest floor that `want` vectors
    reach is a bound, and cells whose ceiling lies under it hold none of the nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            e = _matrix(batch.column("embedding"))
            low, high = _span(e, centres, radius)
            order = np.argsort(-low, axis=1, kind="stable")
            reached = np.cumsum(size[order], axis=1) >= want
            at = np.where(reached.any(1), reached.argmax(1), size.size - 1)
            bound = np.where(reached.any(1), np.take_along_axis(low, order, 1)[np.arange(len(e)), at], -np.inf)
            keep = (high >= bound[:, None]) & (size > 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(keep.sum(1)))), pa.int32()), pa.array(np.nonzero(keep)[1], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("embedding"), lists, pa.array(bound)], ["q", "embedding", "cells", "bound"])

    kind = queries.schema["embedding"].dataType.simpleString()
    return queries.mapInArrow(run, f"q long, embedding {kind}, cells array<int>, bound double")


def best(products: np.ndarray, ids: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values, rounded to 9 places, of the `want` greatest products of each row, ties by
    id. Only what comes within rounding of the want-th greatest is rounded and sorted."""
    n = products.shape[1]
    if n > want:
        least = np.partition(products, n - want, axis=1)[:, n - want]
        row, col = np.nonzero(products >= least[:, None] - 2e-9)
    else:
        row, col = (x.ravel() for x in np.indices(products.shape))
    sims = np.round(products[row, col], 9)
    order = np.lexsort((ids[col], -sims, row))
    row, col, sims = row[order], col[order], sims[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < want
    return row[kept], col[kept], sims[kept]


def _packed(rows: DataFrame, block: int) -> DataFrame:
    """rows in their order, up to `block` of them as one: each column as the bytes of its numbers (vectors
    as doubles), and lot, which tells them apart once they are written."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def pack(table: pa.Table) -> pa.RecordBatch:
            columns = [table[c].combine_chunks() for c in names]
            return pa.RecordBatch.from_arrays([pa.array([(_matrix(c) if pa.types.is_list(c.type) else c.to_numpy()).tobytes()], pa.binary()) for c in columns], names)

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= block:
                table = pa.Table.from_batches(held)
                yield from (pack(table.slice(at, block)) for at in range(0, n - block + 1, block))
                held, n = table.slice(n - n % block).to_batches(), n % block
        if n:
            yield pack(pa.Table.from_batches(held))

    return rows.mapInArrow(run, ", ".join(f"{c} binary" for c in names)).withColumn("lot", F.monotonically_increasing_id())


class _Nearest:
    """The `want` nearest that a lot of queries has met so far, best first."""

    def __init__(self, q: np.ndarray, e: np.ndarray, bound: np.ndarray, want: int):
        self.q, self.e, self.bound, self.want = q, e, bound, want
        self.brief, self.norm = e.astype(np.float32), np.sqrt((e**2).sum(1))
        self.room = np.empty(len(q) * COLUMNS, np.float32)
        self.sim = np.full((len(q), want), -np.inf)
        self.other = {"vec_id": np.full((len(q), want), np.iinfo(np.int64).max), "label": np.zeros((len(q), want), np.int64), "known": np.zeros((len(q), want), bool)}

    def least(self) -> np.ndarray:
        """What is smaller is none of the nearest."""
        return np.maximum(self.sim[:, -1], self.bound) - 2e-9

    def meet(self, e: np.ndarray, cell: np.ndarray, other: dict[str, np.ndarray], centres: np.ndarray, radius: np.ndarray) -> None:
        """Vectors sorted by cell. Cells that may hold a neighbour of a query are multiplied with it."""
        starts = np.flatnonzero(np.diff(cell, prepend=-1))
        ends = np.append(starts[1:], len(cell))
        need = _span(self.e, centres[cell[starts]], radius[cell[starts]])[1] >= self.least()[:, None]
        if need.mean() > 0.25:
            need, starts, ends = need.any(1)[:, None], starts[:1], ends[-1:]
        for i, (start, end) in enumerate(zip(starts.tolist(), ends.tolist())):
            rows = np.flatnonzero(need[:, i])
            for at in range(start, end, COLUMNS) if len(rows) else ():
                cut = slice(at, min(at + COLUMNS, end))
                self._multiply(rows, e[cut], {c: v[cut] for c, v in other.items()})

    def _multiply(self, rows: np.ndarray, e: np.ndarray, other: dict[str, np.ndarray]) -> None:
        """Single precision tells, but for its error, which rows have something near enough; these are
        multiplied again."""
        most = float(np.sqrt((e**2).sum(1).max()))
        least, brief = self.least()[rows], self.brief[rows] if len(rows) < len(self.q) else self.brief
        if max(most, self.norm.max()) < 1e15:
            least = least - (e.shape[1] + 8) * 2.0**-23 * self.norm[rows] * most
            near = np.matmul(brief, e.astype(np.float32).T, out=self.room[: len(rows) * len(e)].reshape(len(rows), len(e)))
            rows = rows[near.max(1) >= least]
        if not len(rows):
            return
        products = self.e[rows] @ e.T
        full = self.sim[rows, -1] > -np.inf
        if not full.all():
            one, col, sims = best(products[~full], other["vec_id"], self.want)
            self._merge(rows[~full][one], col, sims, other)
            rows, products = rows[full], products[full]
        one, col = np.nonzero(products >= self.least()[rows, None])
        self._merge(rows[one], col, np.round(products[one, col], 9), other)

    def _merge(self, row: np.ndarray, col: np.ndarray, sims: np.ndarray, other: dict[str, np.ndarray]) -> None:
        last = self.sim[row, -1]
        nearer = (sims > last) | ((sims == last) & (other["vec_id"][col] < self.other["vec_id"][row, -1]))
        row, col, sims = row[nearer], col[nearer], sims[nearer]
        own = np.unique(row)
        every, sim = np.concatenate([np.repeat(own, self.want), row]), np.concatenate([self.sim[own].ravel(), sims])
        rest = {c: np.concatenate([v[own].ravel(), other[c][col]]) for c, v in self.other.items()}
        order = np.lexsort((rest["vec_id"], -sim, every))
        order = order[np.arange(len(order)) - np.searchsorted(every[order], every[order]) < self.want].reshape(len(own), self.want)
        self.sim[own] = sim[order]
        for c, v in self.other.items():
            v[own] = rest[c][order]

    def rows(self) -> pa.RecordBatch:
        row, col = np.nonzero(self.sim > -np.inf)
        label = pa.array(self.other["label"][row, col], mask=~self.other["known"][row, col])
        return pa.RecordBatch.from_arrays([pa.array(self.q[row]), pa.array(self.other["vec_id"][row, col]), label, pa.array(self.sim[row, col])], ["q", "vec_id", "label", "sim"])


#: Partitions of either side of the products, and the vectors of one that may make them more.
SIDES, WIDE = 12, 1 << 17


def knn(queries: DataFrame, corpus: DataFrame, k: int, skip_first: bool = False, block: int = BLOCK, cells: int | None = None) -> DataFrame:
    """q, vec_id, label, sim, rank: the k corpus vectors of greatest inner product, ties by id.
    skip_first drops the first neighbour (a query that is in the corpus). All vectors have one
    length, and ids tell them apart; rows with a null id or vector are left out.

    An exact index: corpus vectors are dealt to the cells of `cells` of them (by default the square
    root of their number, 1,024 at most), and a query is multiplied only with cells that may hold a
    neighbour (see `_asked`). Both sides are written once, in lots of at most `block` vectors. Every
    lot of queries meets every lot of the corpus in a product of the partitions, which reads them anew
    and writes nothing; of each partition a query keeps its nearest alone. So the disk grows with the
    vectors, the time with their square where cells spare nothing. The driver holds centres, sizes
    and radii."""
    want = k + int(skip_first)
    ship(queries.sparkSession)
    own = corpus.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    if cells is None:
        cells = int(min(1024, max(1, own.count() ** 0.5)))
    first = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(cells).select("embedding").collect()
    if not first:
        return queries.sparkSession.createDataFrame([], "q long, vec_id long, label long, sim double, rank int")
    centres = np.array([r.embedding for r in first], np.float64)
    dealt = materialise(_dealt(own, centres), "knn-cells")
    size, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():
        size[r.cell], radius[r.cell] = r.n, r.far
    near = dealt.repartition("cell").sortWithinPartitions("cell", "vec_id")
    near = near.select(F.col("cell").cast("long"), F.col("vec_id").cast("long"), F.coalesce("label", F.lit(0).cast("long")).alias("label"), F.col("label").isNotNull().cast("long").alias("known"), "embedding")
    right = materialise(_packed(near, block), "knn-corpus")
    discard(dealt)
    asked = _asked(queries.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("q"), "embedding"), centres, size, radius, want)
    left = materialise(_packed(asked.select("q", "bound", F.col("embedding").alias("e")), block), "knn-queries")

    def sides(lots: DataFrame) -> DataFrame:
        n = lots.count()
        return lots.repartition(max(1, min(n, max(SIDES, n * block // WIDE))))

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot = nearest = None
        for batch in batches:
            for i, at in enumerate(batch.column("lot").to_pylist()):
                read = lambda c, kind: np.frombuffer(batch.column(c)[i].as_buffer(), kind)  # noqa: B023, E731
                if at != lot:
                    if nearest is not None:
                        yield nearest.rows()
                    lot, nearest = at, _Nearest(read("q", np.int64), read("e", np.float64).reshape(-1, centres.shape[1]), read("bound", np.float64), want)
                other = {"vec_id": read("vec_id", np.int64), "label": read("label", np.int64), "known": read("known", np.int64) > 0}
                nearest.meet(read("embedding", np.float64).reshape(-1, centres.shape[1]), read("cell", np.int64), other, centres, radius)
        if nearest is not None:
            yield nearest.rows()

    pairs = sides(left).crossJoin(sides(right.drop("lot")).hint("shuffle_replicate_nl"))
    found = pairs.mapInArrow(top, "q long, vec_id long, label long, sim double")
    w = Window.partitionBy("q").orderBy(F.desc("sim"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= want)
    return ranked.where("rank > 1").withColumn("rank", F.col("rank") - 1) if skip_first else ranked


def knn_vote(neighbours: DataFrame, ks: list[int], temperature: float = 0.07) -> DataFrame:
    """q, k, label, score: per k the class sums of softmax(sim / T) over all neighbours given (so
    sums for smaller k are under 1)."""
    w = Window.partitionBy("q")
    e = F.exp((F.col("sim") - F.max("sim").over(w)) / temperature)
    p = neighbours.withColumn("_e", e).withColumn("p", F.col("_e") / F.sum("_e").over(w))
    each = p.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where(F.col("rank") <= F.col("k"))
    return each.groupBy("q", "k", "label").agg(F.sum("p").alias("score"))


def koleo(neighbours: DataFrame, k: int = 1, eps: float = 1e-8) -> DataFrame:
    """One row: minus the mean log distance to the k nearest others, of unit vectors."""
    d = F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * F.col("sim")))
    return neighbours.where(F.col("rank") <= k).agg((-F.avg(F.log(d + eps))).alias("koleo"))


def gram(vectors: DataFrame, group: str, zero_negative: bool = False) -> DataFrame:
    """group, a, b, s: pairwise similarities within a group (a <= b). Groups are images or clips of
    bounded size; pairs within them are what is asked for."""
    b = vectors.select(group, F.col("vec_id").alias("b"), F.col("embedding").alias("_e"))
    out = vectors.select(group, F.col("vec_id").alias("a"), "embedding").join(b, group).where("a <= b").select(group, "a", "b", dot("embedding", "_e").alias("s"))
    return out.withColumn("s", F.greatest("s", F.lit(0.0))) if zero_negative else out


def gram_mse(left: DataFrame, right: DataFrame, group: str) -> DataFrame:
    d = F.col("s") - F.col("t")
    return left.join(right.withColumnRenamed("s", "t"), [group, "a", "b"]).groupBy(group).agg(F.avg(d * d).alias("mse"))


def best_text(images: DataFrame, texts: DataFrame, scale: float) -> DataFrame:
    """image, text, logit: for each image the text of greatest exp(scale) * inner product of unit
    vectors. Texts are a class list, checked to be small before they are sent to every task."""
    if texts.count() > 10_000:
        raise ValueError("more than 10,000 texts: use knn")
    i = images.select(F.col("vec_id").alias("image"), l2_normalise("embedding").alias("_a"))
    t = F.broadcast(texts.select(F.col("vec_id").alias("text"), l2_normalise("embedding").alias("_b")))
    logit = F.round(dot("_a", "_b") * float(np.exp(scale)), 6)
    return i.crossJoin(t).select("image", "text", logit.alias("logit")).groupBy("image").agg(F.max_by("text", F.struct("logit", -F.col("text"))).alias("text"), F.max("logit").alias("logit"))


def class_stats(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last"))


def sinkhorn(scores: DataFrame, temperature: float = 0.1, rounds: int = 3) -> DataFrame:
    """sample, prototype, p: balanced soft assignment, rows and columns scaled in turns."""
    n = F.lit(float(scores.select("sample").distinct().count()))
    top = scores.agg(F.max("score").alias("_m"))
    out = scores.crossJoin(F.broadcast(top)).select("sample", "prototype", F.exp((F.col("score") - F.col("_m")) / temperature).alias("p"))
    protos = F.lit(float(scores.select("prototype").distinct().count()))
    for _ in range(rounds):
        by_p = out.groupBy("prototype").agg(F.sum("p").alias("_t"))
        out = out.join(by_p, "prototype").select("sample", "prototype", (F.col("p") / F.col("_t") / protos).alias("p"))
        out = out.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("sample")) / n)
    return out.withColumn("p", F.col("p") * n)


def mean_patches(patches: DataFrame, group: str) -> DataFrame:
    """group, embedding: the mean vector of each group."""
    each = patches.select(group, F.posexplode("embedding").alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("x"))
    return each.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("embedding"))


def compose_embedding(blocks: DataFrame, patches: DataFrame, group: str, layer: str, last: int) -> DataFrame:
    """group, embedding: the class vectors of the last layers of blocks, in order, and after them the
    mean of the group's patch vectors. Groups without patches are dropped."""
    w = Window.partitionBy(group).orderBy(F.desc(layer))
    ends = blocks.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= last)
    tokens = ends.groupBy(group).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(layer, F.col("embedding").alias("e")))), lambda s: s.e)).alias("_c"))
    means = mean_patches(patches, group).withColumnRenamed("embedding", "_m")
    return tokens.join(means, group).select(group, F.concat(F.col("_c").cast("array<double>"), F.col("_m")).alias("embedding"))


#: 45 powers of ten from -6 to 5, evenly spaced.
POWERS = tuple(-6 + 11 * i / 44 for i in range(45))


def _points(d: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return d.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>"))).withColumn("_y", F.col("label").cast("double"))


def _logreg(points: DataFrame, n: int, c: float, iterations: int):
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(labelCol="_y", regParam=1.0 / (c * n), standardization=False, maxIter=iterations).fit(points)


def logreg_sweep(train: DataFrame, val: DataFrame, cs: list[float] | None = None, iterations: int = 60) -> DataFrame:
    """c, accuracy, best: logistic regression for every C (45 of 10^-6 to 10^5 by default; regParam
    1 / (C n), no scaling of features), scored on val; the first best is marked."""
    cs = [10.0**p for p in POWERS] if cs is None else cs
    t, v, n = _points(train).select("features", "_y").cache(), _points(val).select("features", "_y").cache(), train.count()
    rows = [(c, float(_logreg(t, n, c, iterations).transform(v).agg(F.avg((F.col("prediction") == F.col("_y")).cast("double"))).first()[0])) for c in cs]
    t.unpersist()
    v.unpersist()
    best = max(range(len(rows)), key=lambda i: (rows[i][1], -i))
    return train.sparkSession.createDataFrame([(c, a, i == best) for i, (c, a) in enumerate(rows)], "c double, accuracy double, best boolean")


def logreg_refit(train: DataFrame, val: DataFrame, test: DataFrame, sweep: DataFrame, iterations: int = 60) -> DataFrame:
    """test with predicted: by a regression fitted to train and val together with the sweep's best C."""
    both = train.select("embedding", "label").unionByName(val.select("embedding", "label"))
    model = _logreg(_points(both), both.count(), sweep.where("best").first()["c"], iterations)
    out = model.setPredictionCol("predicted").setRawPredictionCol("").setProbabilityCol("").transform(_points(test))
    return out.select(*test.columns, F.col("predicted").cast("int").alias("predicted"))
