"""Embedding whitening: directions of the distinct vectors' covariance by a bidiagonal qd solver.

Tasks reduce their centred rows by blockwise QR to one triangle each, triangles are folded in
rounds of a fixed fan-in, and the last one, dims x dims, goes to the driver: Householder
bidiagonalisation, dqds and twisted factorisations (`singular.py`) give its singular values and
directions. No product of uncentred values is ever summed in floating point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posegrid.llm.singular import right_directions
from posegrid.llm.vector_blocks import block, is_finite, lists
from posegrid.session import discard, materialise, ship

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Rows of a QR block, and triangles that one task folds.
ROWS, FAN_IN = 2048, 32


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n: the difference n*x - S is exact in integers, only the quotient is rounded."""
    return (n * x - sums) / n


def _totals(fit: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """Number of vectors and exact sums by dimension; a task sends dims + 1 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims + 1, np.int64)
        for batch in batches:
            x = block(batch["x"], dims)
            total[:dims] += x.sum(0)
            total[dims] += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims + 1), pa.int32()), pa.array(total)], ["dim", "part"])

    rows = fit.mapInArrow(run, "dim int, part bigint").groupBy("dim").agg(F.sum("part").alias("total")).collect()
    total = {r.dim: int(r.total) for r in rows}
    return total.get(dims, 0), np.array([total.get(d, 0) for d in range(dims)], np.int64)


def _triangle(fit: DataFrame, dims: int, n: int, sums: np.ndarray) -> np.ndarray:
    """R of the QR of all centred rows."""

    def folded(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dims))
        for rows in parts:
            r = np.linalg.qr(np.concatenate([r, rows]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array([len(r)], pa.int32()), lists(r.reshape(1, -1))], ["height", "r"])

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[np.ndarray]:
            for batch in batches:
                x = block(batch["x"], dims)
                for a in range(0, len(x), ROWS):
                    yield _centred(x[a : a + ROWS], n, sums)

        yield from folded(parts())

    def reduce_triangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from folded(np.array(r, float).reshape(-1, dims) for batch in batches for r in batch["r"].to_pylist())

    shape = "height int, r array<double>"
    many = fit.rdd.getNumPartitions()
    out = fit.mapInArrow(reduce_rows, shape)
    while many > 1:
        many = -(-many // FAN_IN)
        out = out.where("height > 0").repartition(many).mapInArrow(reduce_triangles, shape)
    return np.array(out.first().r, float).reshape(-1, dims)


def _square(r: np.ndarray) -> np.ndarray:
    """The triangle with rows of zeros below where there were fewer rows than dimensions."""
    return np.concatenate([r, np.zeros((r.shape[1] - len(r), r.shape[1]))])


def _identity_error(fit: DataFrame, dims: int, n: int, sums: np.ndarray, whiten: np.ndarray) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity."""
    c = whiten.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((c, c + 1))
        for batch in batches:
            w = _centred(block(batch["x"], dims), n, sums) @ whiten
            total[:, :c] += w.T @ w
            total[:, c] += w.sum(0)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "part"])

    moments = np.zeros((c, c + 1))
    for r in fit.mapInArrow(run, "i int, j int, part double").groupBy("i", "j").agg(F.sum("part").alias("total")).collect():
        moments[r.i, r.j] = r.total / n
    return float(np.abs(moments[:, :c] - np.outer(moments[:, c], moments[:, c]) - np.eye(c)).max(initial=0.0))


def _deviation(gap: np.ndarray) -> pa.Array:
    """Row sums of squares in integers; null where one doesn't fit a long."""
    most = int(np.abs(gap).max(initial=0))
    if most * most * gap.shape[1] < 1 << 63:
        return pa.array(np.einsum("ij,ij->i", gap, gap))
    return pa.array([v if v < 1 << 63 else None for v in (sum(g * g for g in row) for row in gap.tolist())], pa.int64())


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each usable row and component: id, component (from 1, by falling variance), n (distinct
    vectors), deviation, whitened, explained and identity_error.

    Null vectors and those with null, NaN or infinite entries are left out, as are vectors whose
    length isn't the commonest one above 0 (the smaller of equally common lengths). An entry c
    becomes the long x = floor(64 * c) + 1000000. The distinct x vectors are the fit list: n of
    them, with sums S by dimension; so repeated rows weigh nothing but all get their results.
    deviation is the exact sum of (n*x - S)^2, null where it exceeds a long. Component k is the unit
    eigenvector of the fit list's covariance (divisor n) with the k-th largest eigenvalue e, largest
    entry positive; whitened is x - S/n on it over sqrt(e); explained is e over the trace;
    identity_error is measured on all whitened rows of the fit list. Components whose variance is 0
    in double precision don't exist: equal vectors, one vector or an empty table give no rows.
    Other columns are not read, so their names can't clash; null ids are kept.

    The distinct list is written to the shared folder once and deleted once the directions are
    known; the driver holds one triangle and one matrix of dims x dims.
    """
    ship(vectors.sparkSession)
    own = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where(is_finite("v") & (F.size("v") > 0))
    common = own.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    dims = common.dims if common else 1
    own = own.where(F.size("v") == dims).select("id", F.transform("v", lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long")).alias("x"))
    fit = materialise(own.select("x").distinct(), "distinct-vectors")
    n, sums = _totals(fit, dims)
    triangle = _triangle(fit, dims, n, sums) if n else np.zeros((0, dims))
    squares, directions = right_directions(_square(triangle), components)
    whitening = directions * np.sqrt(n / squares) if n else directions
    error = _identity_error(fit, dims, n, sums, whitening) if len(squares) else 0.0
    discard(fit)
    explained = (squares / max(float((triangle**2).sum()), np.finfo(float).tiny)).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(squares):
                gap = n * block(batch["x"], dims) - sums
                yield pa.RecordBatch.from_arrays([batch["id"], _deviation(gap), lists(gap / n @ whitening)], ["id", "deviation", "w"])

    kind = own.schema["id"].dataType.simpleString()
    rows = own.mapInArrow(run, f"id {kind}, deviation bigint, w array<double>").select("id", "deviation", F.posexplode("w").alias("k", "whitened"))
    share = F.element_at(F.array(*[F.lit(e) for e in explained] or [F.lit(0.0)]), F.col("k") + 1)
    return rows.select(
        F.col("id").alias(id_col), (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error")
    )
