"""Sinks: episodes, logs, summaries, result tables, points, features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posegrid.operators.metrics import merge_logs


def write_episodes(episodes: DataFrame, path: str) -> None:
    """JSON by scene_id; scenes without episodes get no folder."""
    episodes.write.mode("append").partitionBy("scene_id").json(path)


def append_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_merged(rows: DataFrame, path: str) -> None:
    """The merged log, sorted by scene and episode over its files."""
    merge_logs(rows).orderBy("scene", "episode").write.mode("overwrite").json(path)


def append_summary(rows: DataFrame, path: str) -> None:
    """A run's one-row summary, stamped by the caller's columns."""
    rows.coalesce(1).write.mode("append").json(path)


def result_types(df: DataFrame) -> DataFrame:
    """Columns as text, long or double: integers become long, floats double, booleans text. Any
    other type is an error."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            out.append(c.cast("long").alias(f.name))
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            out.append(c.cast("double").alias(f.name))
        elif isinstance(f.dataType, (T.BooleanType, T.StringType)):
            out.append(c.cast("string").alias(f.name))
        else:
            raise TypeError(f"{f.name}: {f.dataType.simpleString()} is not allowed in a result table")
    return df.select(*out)


def save_results(df: DataFrame, path: str) -> None:
    d = result_types(df)
    d.write.mode("overwrite").csv(path, header=True) if path.rstrip("/").endswith(".csv") else d.write.mode("overwrite").json(path)


#: Folders of points: a scene lies in the one of its number's remainder.
SHELVES = 64


def write_points(points: DataFrame, path: str) -> None:
    """Points in folders by shelf (the scene's remainder by SHELVES) and layer, sorted by scene, so
    that there are as many folders however many scenes there are."""
    shelf = F.pmod(F.col("scene_id"), F.lit(SHELVES)).cast("int")
    d = points.withColumn("shelf", shelf).repartition("shelf", F.pmod(F.xxhash64("scene_id"), F.lit(8)))
    d.sortWithinPartitions("shelf", "layer", "scene_id").write.mode("append").partitionBy("shelf", "layer").parquet(path)


def save_aligned(preds: DataFrame, targets: DataFrame, path: str, index: str = "idx") -> None:
    """Predictions and targets by index; negative indices are padding."""
    preds.where(F.col(index) >= 0).join(targets, index).sortWithinPartitions(index).write.mode("overwrite").parquet(path)


def save_features(features: DataFrame, path: str) -> None:
    features.write.mode("overwrite").parquet(path)


def expect_rows(df: DataFrame, n: int) -> DataFrame:
    """df, after an error if it has not n rows."""
    got = df.count()
    if got != n:
        raise ValueError(f"{got} rows where {n} are expected")
    return df


def encode_depth_frames(pixels: DataFrame, width: int, height: int, depth: str = "depth") -> DataFrame:
    """path, content of a raw frame for each image (image, u, v and depth): a 12-byte header of float
    tag, int width and height, then float32 rows; pixels that are absent, null or outside are 0."""
    import numpy as np
    import pyarrow as pa

    inside = pixels.where((F.col("u") >= 0) & (F.col("u") < width) & (F.col("v") >= 0) & (F.col("v") < height) & F.col(depth).isNotNull())
    at = (F.col("v") * width + F.col("u")).cast("int").alias("at")
    frames = inside.groupBy(F.col("image").cast("string").alias("path")).agg(F.collect_list(F.struct(at, F.col(depth).cast("float").alias("z"))).alias("own"))
    frames = frames.select("path", "own.at", "own.z")

    def run(batches):
        for batch in batches:
            out = []
            for place, z in zip(batch.column("at"), batch.column("z")):
                frame = np.zeros(width * height, "<f4")
                frame[place.values.to_numpy()] = z.values.to_numpy()
                out.append(np.float32(202021.25).tobytes() + np.array([width, height], "<i4").tobytes() + frame.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.binary())], ["path", "content"])

    return frames.mapInArrow(run, "path string, content binary")
