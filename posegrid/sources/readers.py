"""Readers of text, JSON and binary layouts. All parse with column functions on Spark's own
readers; paths are globs that Spark resolves, so any store Spark reads will do."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posegrid.functions import geometry as G
from posegrid.sources.sinks import SHELVES


def file_path() -> Column:
    return F.col("_metadata.file_path")


def _numbers(c: Column | str) -> Column:
    """Doubles of a text; commas are spaces; a word that is no number is null."""
    words = F.filter(F.split(F.regexp_replace(c, ",", " "), r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: w.try_cast("double"))


def _lines(spark: SparkSession, glob: str) -> DataFrame:
    """path, line (from 0), value of every line of the files, empty ones included."""
    whole = spark.read.text(glob, wholetext=True).select(file_path().alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))


def read_pose_text(spark: SparkSession, glob: str) -> DataFrame:
    """path and tx ty tz qx qy qz qw of one-pose files; files with other than 7 numbers dropped."""
    return _poses(spark.read.text(glob, wholetext=True).select(file_path().alias("path"), _numbers("value").alias("n")))


def _poses(numbers: DataFrame) -> DataFrame:
    n = numbers.where("size(n) = 7 AND forall(n, x -> x IS NOT NULL)")
    return n.select("path", *[F.col("n")[i].alias(c) for i, c in enumerate(("tx", "ty", "tz", "qx", "qy", "qz", "qw"))])


def read_pose_packs(spark: SparkSession, glob: str) -> DataFrame:
    """The same of packs: a line for each pose file, its path, a tab and its text."""
    at = F.instr("value", "\t")
    n = spark.read.text(glob).where(at > 0).select(F.expr("substr(value, 1, instr(value, '\t') - 1)").alias("path"), _numbers(F.expr("substr(value, instr(value, '\t') + 1)")).alias("n"))
    return _poses(n)


def read_matrix_text(spark: SparkSession, glob: str) -> DataFrame:
    """path and m, 16 finite numbers row-major; short and non-finite files dropped."""
    n = spark.read.text(glob, wholetext=True).select(file_path().alias("path"), _numbers("value").alias("m"))
    return n.where("size(m) >= 16 AND forall(m, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))").select("path", F.slice("m", 1, 16).alias("m"))


def read_intrinsics(spark: SparkSession, glob: str, layout: str) -> DataFrame:
    """path, fx, fy, cx, cy. layout: matrix (entries of a 4x4 or 3x3 file), keyed (a line of
    key=value or key = v0 v1 ... numbers, the 10th line) or line (w h fx fy cx cy)."""
    if layout == "matrix":
        n = spark.read.text(glob, wholetext=True).select(file_path().alias("path"), _numbers("value").alias("n")).withColumn("k", F.when(F.size("n") >= 16, 4).otherwise(3)).where("size(n) >= 9")
        return n.select("path", F.col("n")[0].alias("fx"), F.get("n", F.col("k") + 1).alias("fy"), F.col("n")[2].alias("cx"), F.get("n", F.col("k") + 2).alias("cy"))
    if layout == "keyed":
        n = _lines(spark, glob).where("line = 9").select("path", _numbers(F.regexp_extract("value", "=\\s*(.*)$", 1)).alias("n")).where("size(n) >= 4")
        return n.select("path", *[F.col("n")[i].alias(c) for i, c in enumerate(("fx", "fy", "cx", "cy"))])
    if layout == "line":
        n = spark.read.text(glob, wholetext=True).select(file_path().alias("path"), _numbers("value").alias("n")).where("size(n) = 6")
        return n.select("path", *[F.col("n")[i + 2].alias(c) for i, c in enumerate(("fx", "fy", "cx", "cy"))])
    raise ValueError(layout)


def read_angle_axis(spark: SparkSession, glob: str) -> DataFrame:
    """path, line, r (9, camera to world), tx, ty, tz from lines of timestamp, rotation vector and
    translation (world to camera), inverted."""
    n = _lines(spark, glob).withColumn("n", _numbers("value")).where("size(n) = 7 AND forall(n, x -> x IS NOT NULL)")
    r, t = G.invert_pose(G.rodrigues(*[F.col("n")[i] for i in (1, 2, 3)]), tuple(F.col("n")[i] for i in (4, 5, 6)))
    return n.select("path", "line", F.array(*r).alias("r"), *[c.alias(k) for k, c in zip(("tx", "ty", "tz"), t)])


def read_lookat(spark: SparkSession, glob: str, width: int, height: int) -> DataFrame:
    """path, line, x, y, z (m), right, down, forward axes and fx, fy, cx, cy from lines of position
    (mm), forward, up and half fields of view."""
    n = _lines(spark, glob).withColumn("n", _numbers("value")).where("size(n) = 11")
    v = lambda i: [F.col("n")[i + k] for k in range(3)]
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    unit = lambda a: [c / F.nullif(F.sqrt(a[0] * a[0] + a[1] * a[1] + a[2] * a[2]), F.lit(0.0)) for c in a]
    f = unit(v(3))
    right = unit(cross(f, v(6)))
    down = cross(f, right)
    cx, cy = width / 2.0, height / 2.0
    return n.select("path", "line", *[(c / 1000.0).alias(k) for k, c in zip("xyz", v(0))], F.array(*right).alias("right"), F.array(*down).alias("down"), F.array(*f).alias("forward"), (F.lit(cx) / F.tan(F.col("n")[9])).alias("fx"), (F.lit(cy) / F.tan(F.col("n")[10])).alias("fy"), F.lit(cx).alias("cx"), F.lit(cy).alias("cy"))


def read_registry(spark: SparkSession, glob: str) -> DataFrame:
    """source, dataset_type, traj_dir, images_dir, scenes_dir and ord, its place by name."""
    kind = "map<string,struct<dataset_type:string,traj_dir:string,images_dir:string,scenes_dir:string>>"
    d = spark.read.text(glob, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("source", "s"))
    return d.select("source", "s.*")


EPISODE = "struct<episode_id:string,instruction_data:struct<style:string,instruction:string>,trajectory:array<struct<step:int,pos:array<double>,heading:double,action:string>>,goal_position:array<double>,goal_id:string>"


def read_episodes(spark: SparkSession, glob: str) -> DataFrame:
    """path, ordinal, episode_id, style, instruction, trajectory, goal_position, goal_id of files
    that hold a list of episodes or one. Missing fields are empty, or null where they are optional."""
    d = spark.read.text(glob, wholetext=True).select(file_path().alias("path"), "value")
    many = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{EPISODE}>")).otherwise(F.array(F.from_json("value", EPISODE)))
    e = d.select("path", F.posexplode(many).alias("ordinal", "e"))
    return e.select("path", "ordinal", F.coalesce("e.episode_id", F.lit("")).alias("episode_id"), F.coalesce("e.instruction_data.style", F.lit("")).alias("style"), F.coalesce("e.instruction_data.instruction", F.lit("")).alias("instruction"), F.coalesce("e.trajectory", F.expr("cast(array() as array<struct<step:int,pos:array<double>,heading:double,action:string>>)")).alias("trajectory"), "e.goal_position", "e.goal_id")


def episode_steps(episodes: DataFrame) -> DataFrame:
    """episode_id, step, x, y, z, heading, action: a row for every logged step."""
    s = episodes.select("episode_id", F.explode("trajectory").alias("t"))
    return s.select("episode_id", "t.step", F.col("t.pos")[0].alias("x"), F.col("t.pos")[1].alias("y"), F.col("t.pos")[2].alias("z"), "t.heading", "t.action")


BENCHMARK = "struct<episodes:array<struct<episode_id:string,trajectory_id:string,scene_id:string,instruction:struct<instruction_text:string,language:string,annotator_id:string>,goals:array<struct<position:array<double>,radius:double>>,reference_path:array<array<double>>>>>"


def read_benchmark(spark: SparkSession, globs: dict[str, str]) -> DataFrame:
    """role and the episode fields of gzipped or plain JSON files, by role."""
    out = None
    for role, glob in globs.items():
        d = spark.read.text(glob, wholetext=True).select(F.lit(role).alias("role"), F.explode(F.from_json("value", BENCHMARK)["episodes"]).alias("e")).select("role", "e.*")
        out = d if out is None else out.unionByName(d)
    return out


def read_gt_paths(spark: SparkSession, globs: dict[str, str]) -> DataFrame:
    """episode_id (text), locations; a later role overrides earlier ones."""
    out = None
    for i, glob in enumerate(globs.values()):
        d = spark.read.text(glob, wholetext=True).select(F.explode(F.from_json("value", "map<string,struct<locations:array<array<double>>>>")).alias("episode_id", "v")).select("episode_id", F.lit(i).alias("o"), "v.locations")
        out = d if out is None else out.unionByName(d)
    return out.groupBy("episode_id").agg(F.max_by("locations", "o").alias("locations"))


def read_annotations(spark: SparkSession, glob: str, registry: DataFrame) -> DataFrame:
    """scene_path, source and the annotation fields; the source is the registry's whose name the
    path contains (the least on several); scenes without one are dropped."""
    kind = "map<string,array<struct<instance_type:array<string>,instance_id:array<string>,instance_position:array<array<double>>,context:array<string>,response:array<string>>>>"
    d = spark.read.text(glob, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("scene_path", "a")).select("scene_path", F.explode("a").alias("a"))
    names = F.broadcast(registry.groupBy().agg(F.array_sort(F.collect_set("source")).alias("names")))
    hit = d.crossJoin(names).withColumn("source", F.get(F.filter("names", lambda n: F.contains("scene_path", n)), F.lit(0))).where("source IS NOT NULL")
    return hit.select("scene_path", "source", "a.*")


def read_jsonl_tolerant(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank, malformed and non-object lines are skipped. No file, no rows."""
    try:
        d = spark.read.text(glob)
    except Exception as e:  # only a missing path is an empty log
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    d = d.where(F.trim("value").startswith("{"))
    parsed = d.select(F.from_json("value", f"struct<{schema}, _bad:string>", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where("r IS NOT NULL AND r._bad IS NULL").select("r.*").drop("_bad")


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A result table from CSV (with header, empty is null) or JSON lines, by the path's ending."""
    return spark.read.schema(schema).csv(path, header=True, nullValue="") if path.rstrip("/").endswith(".csv") else spark.read.schema(schema).json(path)


def read_split_list(spark: SparkSession, glob: str, layout: str = "name") -> DataFrame:
    """name layout: name and its label path (images -> annotations, .jpg -> .png). columns layout:
    image, depth, focal of three columns a line."""
    d = spark.read.text(glob).where(F.trim("value") != "")
    if layout == "name":
        n = F.trim("value")
        return d.select(n.alias("name"), F.regexp_replace(F.regexp_replace(n, "images", "annotations"), r"\.jpg$", ".png").alias("label"))
    w = F.split(F.trim("value"), r"\s+")
    return d.select(w[0].alias("image"), F.nullif(w[1], F.lit("None")).alias("depth"), w[2].try_cast("double").alias("focal"))


def explode_depth_frames(files: DataFrame) -> DataFrame:
    """path, u, v, depth of raw frames (path, content): a 12-byte header of float tag, int width and
    height, then float32 rows. Frames shorter than their header says are dropped. One frame at a
    time is in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                if raw is None or len(raw) < 12:
                    continue
                w, h = np.frombuffer(raw, "<i4", 2, 4).tolist()
                if w <= 0 or h <= 0 or len(raw) < 12 + 4 * w * h:
                    continue
                v, u = np.divmod(np.arange(w * h, dtype=np.int32), np.int32(w))
                yield pa.RecordBatch.from_pydict({"path": pa.array([path] * (w * h)), "u": u, "v": v, "depth": np.frombuffer(raw, "<f4", w * h, 12)})

    return files.select("path", "content").mapInArrow(run, "path string, u int, v int, depth float")


def read_points(spark: SparkSession, path: str, scene: int | None = None) -> DataFrame:
    """Points as sinks.write_points stored them; if a scene is named, only its shelf's folders are read,
    and of these the row groups that may hold it."""
    d = spark.read.parquet(path)
    return (d if scene is None else d.where((F.col("shelf") == scene % SHELVES) & (F.col("scene_id") == scene))).drop("shelf")
