"""Places in a global order, and windows over keys of any size, without a window over all rows.

Rows are dealt to ranges of the order, sorted there and written; a row's place is its place in its
range plus the rows of the ranges before. Only one count a range goes to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posegrid.session import materialise

#: Spark's monotonically_increasing_id: the partition's number above, the row's place in it below.
_PLACE_BITS = 33


def in_ranges(rows: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """rows, sorted and written by ranges of the order, with _range (numbers that rise with the
    order) and _at (the place in the range, from 0)."""
    d = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    split = d.withColumn("_range", F.shiftright("_m", _PLACE_BITS)).withColumn("_at", F.col("_m").bitwiseAND((1 << _PLACE_BITS) - 1))
    return materialise(split.drop("_m"), name)


def numbered(rows: DataFrame, order: list[str | Column], place: str = "place") -> DataFrame:
    """rows with their place in the order, from 0. The order must tell all rows apart, or those
    that it doesn't may swap places from run to run."""
    d = in_ranges(rows, order, "numbered")
    before, firsts = 0, []
    for r in sorted(d.groupBy("_range").count().collect(), key=lambda r: r["_range"]):
        firsts.append((r["_range"], before))
        before += r["count"]
    # one row a range: as many as the shuffle has partitions
    first = rows.sparkSession.createDataFrame(firsts, "_range long, _first long")
    return d.join(F.broadcast(first), "_range").withColumn(place, F.col("_first") + F.col("_at")).select(*rows.columns, place)


def numbered_within(rows: DataFrame, keys: list[str], order: list[str | Column], place: str = "place") -> DataFrame:
    """rows with their place, from 0, in the order of their key: a key of any size is ranked by as
    many tasks as the order has ranges. Null keys are a key of their own."""
    d = numbered(rows, [*keys, *order], "_all")
    firsts = d.groupBy(*[F.col(k).alias(f"_by_{k}") for k in keys]).agg(F.min("_all").alias("_first"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in keys])
    return d.join(firsts, same).select(*rows.columns, (F.col("_all") - F.col("_first")).alias(place))


def pieces(rows: DataFrame, keys: list[str], order: list[str | Column], halo: int, size: int = 1 << 15) -> DataFrame:
    """rows with _k (the place in the key), _piece (runs of `size` rows of a key) and _halo: each
    piece also gets, marked, the last `halo` rows of the key before it. A window over (keys, _piece)
    ordered by _k that looks back at most `halo` rows is then whole for the rows not marked."""
    if halo > size:
        raise ValueError("halo is larger than a piece")
    d = numbered_within(rows, keys, order, "_k").withColumn("_piece", F.floor(F.col("_k") / size))
    after = F.when(F.col("_k") % size >= size - halo, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    return d.withColumn("_halo", F.explode(after)).withColumn("_piece", F.col("_piece") + F.col("_halo").cast("long"))
