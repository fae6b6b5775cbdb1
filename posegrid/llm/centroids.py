"""Exact k-means on integer vectors, where an n-simplex projection spares most comparisons.

A few pivots, affinely independent vectors among the first centroids, span a simplex. A vector's
distances to them, measured once and kept, fix the apex of a simplex on that base: its coordinates
in the span of the pivots and its height above it. For two apexes the Euclidean distance, with the
heights on one side or on opposite sides of the base, is a lower and an upper bound of the distance
of the vectors. Centroids whose lower bound lies over the least upper bound (and a margin far over
rounding) can't be nearest, nor can those whose lower bound lies over the distance to the centroid
of the least lower bound; all others are compared in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posegrid.llm.vector_blocks import block, is_finite, lists
from posegrid.session import discard, materialise, ship

#: Most pivots; floats of a coordinate to one step of an integer; rounds of k-means.
PIVOTS, SCALE, ROUNDS = 16, 256, 5
#: Integer components lie within this bound: squared distances then fit a long for up to 127 dimensions.
BOUND = 1 << 27
#: Bounds must differ by this part of the largest distance at hand before a centroid is passed over.
MARGIN = 1e-6


class Simplex:
    """The base of pivots, in coordinates of their own span."""

    def __init__(self, candidates: np.ndarray, most: int = PIVOTS):
        """Of the candidates (integers, one a row), takes the first, then each time the one farthest
        from the span of those taken, as long as that is well away from it."""
        x = candidates.astype(np.float64)
        rest = x - x[0]
        taken, scale = [0], np.sqrt((rest**2).sum(1).max(initial=0.0))
        while len(taken) < min(most, len(x)):
            height = np.sqrt((rest**2).sum(1))
            far = int(height.argmax())
            if height[far] <= 1e-3 * scale or not scale:
                break
            unit = rest[far] / height[far]
            rest = rest - np.outer(rest @ unit, unit)
            rest -= np.outer(rest @ unit, unit)
            taken.append(far)
        self.pivots = candidates[taken].astype(np.int64)
        edges = (self.pivots[1:] - self.pivots[0]).astype(np.float64)
        self.base = np.linalg.qr(edges.T)[1].T if len(edges) else np.zeros((0, 0))  # lower triangular: one row a pivot but the first
        self.square = (self.base**2).sum(1)

    def apex(self, x: np.ndarray) -> np.ndarray:
        """For each integer vector its coordinates over the base, then its height."""
        near = np.stack([_squares(x - p) for p in self.pivots], 1).astype(np.float64)
        y = np.linalg.solve(self.base, ((near[:, :1] - near[:, 1:] + self.square) / 2).T).T if len(self.base) else np.zeros((len(x), 0))
        return np.column_stack([y, np.sqrt(np.maximum(near[:, 0] - (y**2).sum(1), 0))])


def _squares(diff: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", diff, diff)


def nearest(x: np.ndarray, apex: np.ndarray, centroids: np.ndarray, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each integer vector the number of its nearest centroid (the least of equals), the exact
    squared distance, and how many distances were computed in all. apex, tops: the projections of
    the vectors and of the centroids."""
    flat = ((apex[:, None, :-1] - tops[None, :, :-1]) ** 2).sum(2)
    low = np.sqrt(flat + (apex[:, None, -1] - tops[None, :, -1]) ** 2)
    high = np.sqrt(flat + (apex[:, None, -1] + tops[None, :, -1]) ** 2)
    slack = MARGIN * (1 + high.max(initial=0))
    bound = high.min(1, keepdims=True)
    if len(x):  # the distance to the likeliest centroid is an upper bound, too
        likely = _squares(x - centroids[low.argmin(1)])
        bound = np.minimum(bound, np.sqrt(likely)[:, None])
    row, col = np.nonzero(low <= bound + slack)
    dist = np.empty(len(row), np.int64)
    step = max(1, (1 << 21) // max(1, x.shape[1]))
    for a in range(0, len(row), step):
        dist[a : a + step] = _squares(x[row[a : a + step]] - centroids[col[a : a + step]])
    first = np.searchsorted(row, np.arange(len(x)))
    least = np.minimum.reduceat(dist, first) if len(x) else dist
    hit = np.flatnonzero(dist == least[row])
    hit = hit[np.searchsorted(row[hit], np.arange(len(x)))]
    return col[hit], least, len(row) + len(x)


def _projected(vectors: DataFrame, id_col: str, x_col: str, base: Simplex, dims: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = block(batch[x_col], dims).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch[id_col], lists(x.astype(np.int32)), lists(base.apex(x))], ["id", "x", "apex"])

    kind = vectors.schema[id_col].dataType.simpleString()
    return vectors.mapInArrow(run, f"id {kind}, x array<int>, apex array<double>")


def _sums(points: DataFrame, centroids: np.ndarray, tops: np.ndarray) -> dict[tuple[int, int], int]:
    """By (cluster, dimension) the sum of its vectors; dimension -1 has their number. A task sends
    one row for each of these, whatever its number of vectors."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = block(batch["x"], dims).astype(np.int64)
                own, _, _ = nearest(x, block(batch["apex"], tops.shape[1]), centroids, tops)
                order = np.argsort(own, kind="stable")
                there, first = np.unique(own[order], return_index=True)
                total[there, :dims] += np.add.reduceat(x[order], first)
                total[there, dims] += np.diff(np.append(first, len(order)))
        full = np.flatnonzero(total[:, dims])
        at = np.repeat(full, dims + 1), np.tile(np.append(np.arange(dims), -1), len(full))
        yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(total[full].ravel())], ["cluster", "dim", "part"])

    parts = points.mapInArrow(run, "cluster int, dim int, part bigint")
    return {(r.cluster, r.dim): int(r.total) for r in parts.groupBy("cluster", "dim").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()}


def _assigned(points: DataFrame, centroids: np.ndarray, tops: np.ndarray) -> DataFrame:
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, dist, _ = nearest(block(batch["x"], dims).astype(np.int64), block(batch["apex"], tops.shape[1]), centroids, tops)
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array(own, pa.int32()), pa.array(dist)], ["id", "cluster", "distance"])

    kind = points.schema["id"].dataType.simpleString()
    return points.mapInArrow(run, f"id {kind}, cluster int, distance bigint")


def _rank(id_col: str, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)


def cluster(vectors: DataFrame, k: int, rounds: int = ROUNDS, dims: int = 64, seed: int = 2, scale: int = SCALE, pivots: int = PIVOTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Exact integer k-means: id, cluster, distance (squared), cluster_inertia, inertia (the sums of
    distance over the cluster and over all) and centroid_sha256 of the final centroid.

    Vectors with another number of components than `dims`, or with null, NaN or infinite ones, and
    null vectors are left out; component x becomes floor(scale * x), in which it has to lie within
    2^27 on both sides, else an error is raised. The first centroids are the k vectors with the least
    lowercase-hex sha256 of "seed:id" (a null id reads as empty; equal ids go by their vectors): all
    of them if there are fewer. Each round assigns every vector to the nearest centroid, the lowest
    number of equally near ones, and replaces each centroid that has vectors by their componentwise
    floor of the mean. Repeated rows and ids are vectors of their own. Other columns are not read, so
    their names can't clash. An empty table gives an empty result.

    The driver holds k centroids and their sums; everything else stays in tasks. Integers and apexes
    are written once to the shared folder and read by each round, which sends k * (dims + 1) rows a
    task to the shuffle. The table of apexes is deleted at the end.
    """
    spark = vectors.sparkSession
    ship(spark)
    kept = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where((F.size("v") == dims) & is_finite("v"))
    whole = kept.select("id", F.transform("v", lambda c: F.floor(c.cast("double") * scale)).alias("x"))
    whole = whole.select("id", F.transform("x", lambda c: F.when(F.abs(c) <= BOUND, c.cast("int")).otherwise(F.raise_error(F.lit("a component is too large for exact distances in a long")).cast("int"))).alias("x"))
    first = whole.orderBy(_rank("id", seed), "x").limit(k).collect()
    if not first:
        none = spark.createDataFrame([], f"id {vectors.schema[id_col].dataType.simpleString()}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
        return none.withColumnRenamed("id", id_col)
    centroids = np.array([r.x for r in first], np.int64)
    base = Simplex(centroids, pivots)
    points = materialise(_projected(whole, "id", "x", base, dims), "apexes")
    for _ in range(rounds):
        sums = _sums(points, centroids, base.apex(centroids))
        for c in {c for c, _ in sums}:
            centroids[c] = [sums[c, d] // sums[c, -1] for d in range(dims)]
    out = materialise(_assigned(points, centroids, base.apex(centroids)), "clusters")
    discard(points)
    inertia = {r.cluster: int(r.total) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    total = sum(inertia.values())
    prints = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    each = spark.createDataFrame([(c, inertia[c], total, prints[c]) for c in inertia], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # one row a centroid: broadcast whatever the table's size
    return out.join(F.broadcast(each), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = 40, rounds: int = ROUNDS, dims: int = 64, seed: int = 2) -> str:
    """The same in DuckDB's SQL, all distances computed; for tables of the correctness check's size."""
    near = lambda c: f"""SELECT vec_id, cluster, d AS distance FROM (
      SELECT vec_id, cluster, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) AS r FROM (
        SELECT v.vec_id, c.cluster, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN {c} c ON v.dim = c.dim GROUP BY v.vec_id, c.cluster) s) t WHERE r = 1"""  # noqa: E731
    steps = [
        f"""kept AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda c: isfinite(c))) = {dims})""",
        f"""v AS (SELECT vec_id, dim, floor({SCALE} * list_extract(embedding, dim)::DOUBLE)::BIGINT AS x FROM kept, (SELECT unnest(generate_series(1, {dims})) AS dim) g)""",
        f"""c0 AS (SELECT o.cluster, v.dim, v.x FROM v JOIN (
          SELECT vec_id, row_number() OVER (ORDER BY sha256(concat('{seed}:', vec_id::VARCHAR))) - 1 AS cluster FROM kept) o ON v.vec_id = o.vec_id WHERE o.cluster < {k})""",
    ]
    for r in range(rounds):
        steps.append(f"""a{r} AS MATERIALIZED ({near(f"c{r}")})""")
        steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.cluster, c.dim, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
          SELECT cluster, dim, ((s - ((s % n + n) % n)) // n)::BIGINT AS x FROM (
            SELECT a.cluster, v.dim, sum(v.x)::BIGINT AS s, count(*) AS n FROM a{r} a JOIN v ON a.vec_id = v.vec_id GROUP BY a.cluster, v.dim) q) m ON m.cluster = c.cluster AND m.dim = c.dim)""")
    return f"""WITH {", ".join(steps)}, fin AS MATERIALIZED ({near(f"c{rounds}")}),
      prints AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY dim)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
    SELECT f.vec_id, f.cluster::INT AS cluster, f.distance, (sum(f.distance) OVER (PARTITION BY f.cluster))::BIGINT AS cluster_inertia, (sum(f.distance) OVER ())::BIGINT AS inertia, p.centroid_sha256
    FROM fin f JOIN prints p ON f.cluster = p.cluster"""
