import pytest
from pyspark.sql import functions as F

from posegrid.functions import callables
from posegrid.operators import metrics


def test_load_callable():
    assert callables.load_callable("math:sqrt")(4) == 2
    with pytest.raises(ValueError):
        callables.load_callable("math.sqrt")
    with pytest.raises(TypeError):
        callables.load_callable("math:pi")


def test_evaluate(spark):
    preds = spark.createDataFrame([(1, 0, 0.5, 1), (1, 1, 0.6, 1), (2, 0, 0.9, 0), (2, 1, 0.1, 0)], "q long, cls int, score double, label int")
    got = callables.evaluate(preds, {"f1": metrics.f1, "mrr": lambda p: metrics.macro_mrr(p, 2), "rows": lambda p: p.agg(F.count("*").alias("n"))})
    assert {(r.metric, r.name): round(r.value, 4) for r in got.collect()} == {("f1", "f1"): 1.0, ("mrr", "mrr"): 1.0, ("rows", "n"): 4.0}
    callables.register_vectorised(spark, "rooted", "numpy:sqrt", "double")
    assert spark.sql("SELECT rooted(double(9)) AS r").first().r == 3.0
