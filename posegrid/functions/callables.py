"""User callables by name, and named metrics over one table of predictions: as tables of their own,
or fused into a single pass."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def load_callable(path: str) -> Callable:
    """The attribute of a module named by "package.module:name"."""
    module, _, name = path.partition(":")
    if not name:
        raise ValueError("a path has the form package.module:name")
    found = getattr(importlib.import_module(module), name)
    if not callable(found):
        raise TypeError(f"{path} is not callable")
    return found


def register_vectorised(spark, name: str, path: str, kind: str) -> None:
    """Register a function of pandas Series, named by its path, as a vectorised SQL function."""
    spark.udf.register(name, F.pandas_udf(load_callable(path), kind))


def evaluate(preds: DataFrame, metrics: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """metric, name and value of one-row metric tables, each computed from the same predictions."""
    rows = []
    for metric, f in metrics.items():
        d = f(preds)
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in d.columns])).alias("m")
        rows.append(d.select(F.lit(metric).alias("metric"), each).select("metric", "m.name", "m.value"))
    return reduce(DataFrame.unionByName, rows)


@dataclass(frozen=True)
class Metric:
    """A metric with a state that adds up: value is a number of each sample, from its columns preds
    (scores by class) and target; it is averaged over samples (micro) or over the classes of the
    targets (macro). Without a value the metric is F1 of the best class."""

    value: Column | None
    average: str = "micro"


def _place() -> Column:
    """Place of the target among the scores, from 1; equal scores go by class."""
    own = F.get("preds", F.col("target"))
    before = F.filter(F.transform("preds", lambda x, i: (x > own) | ((x == own) & (i < F.col("target")))), lambda x: x)
    return F.when(own.isNotNull(), F.size(before) + 1)


def accuracy(k: int = 1, average: str = "micro") -> Metric:
    return Metric(F.coalesce((_place() <= k).cast("double"), F.lit(0.0)), average)


def reciprocal_rank(average: str = "micro") -> Metric:
    return Metric(F.coalesce(1.0 / _place(), F.lit(0.0)), average)


def cross_entropy(average: str = "micro") -> Metric:
    top = F.array_max("preds")
    total = F.aggregate("preds", F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return Metric(F.log(total) + top - F.get("preds", F.col("target")), average)


def f1(average: str = "macro") -> Metric:
    return Metric(None, average)


def evaluate_fused(samples: DataFrame, metrics: dict[str, Metric]) -> DataFrame:
    """metric, value: all metrics of samples (index, preds, target) in one pass. Each is a few sums
    by class, so one scan feeds one shuffle of as many rows as there are classes and tasks.

    Samples with a negative index are padding and left out, as are those with a null among index,
    preds and target. F1 over classes leaves out those that no sample has or gets. Without samples
    every value is null."""
    held = samples.where("index >= 0 AND preds IS NOT NULL AND target IS NOT NULL")
    values = {f"_v{i}": m.value for i, m in enumerate(metrics.values()) if m.value is not None}
    best = (F.array_position("preds", F.array_max("preds")) - 1).cast("int")
    each = held.select(F.col("target").cast("int").alias("target"), best.alias("best"), *[v.alias(n) for n, v in values.items()])
    roles = [F.struct(F.col("target").alias("cls"), F.lit(1).alias("own"))]
    if any(m.value is None for m in metrics.values()):
        roles.append(F.struct(F.col("best").alias("cls"), F.lit(0).alias("own")))
    each = each.select("target", "best", *values, F.explode(F.array(*roles)).alias("r"))
    own = F.col("r.own") == 1
    sums = each.groupBy(F.col("r.cls").alias("cls")).agg(
        F.count(F.when(own, 1)).alias("n"), F.count(F.when(~own, 1)).alias("given"), F.count(F.when(own & (F.col("best") == F.col("target")), 1)).alias("hits"), *[F.sum(F.when(own, F.col(v))).alias(v) for v in values]
    )
    results = []
    for i, m in enumerate(metrics.values()):
        if m.value is None:
            one = lambda h, n, g: 2.0 * h / F.nullif(n + g, F.lit(0))
            result = F.avg(one(F.col("hits"), F.col("n"), F.col("given"))) if m.average == "macro" else one(F.sum("hits"), F.sum("n"), F.sum("given"))
        elif m.average == "macro":
            result = F.avg(F.col(f"_v{i}") / F.nullif(F.col("n"), F.lit(0)))
        else:
            result = F.sum(f"_v{i}") / F.nullif(F.sum("n"), F.lit(0))
        results.append(result.alias(f"_r{i}"))
    rows = [F.struct(F.lit(name).alias("metric"), F.col(f"_r{i}").cast("double").alias("value")) for i, name in enumerate(metrics)]
    return sums.agg(*results).select(F.explode(F.array(*rows)).alias("m")).select("m.*")
