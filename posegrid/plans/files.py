"""Readers, manifests and sinks as queries: the given tables written in a layout, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posegrid.plans.evaluation import SQL as EVALUATION
from posegrid.plans.register import Registry
from posegrid.session import shared_dir
from posegrid.sources import manifests, readers, sinks

R = Registry()


def _at(df: DataFrame, name: str) -> str:
    return f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


def _files(df: DataFrame, name: Column, value: Column, kind: str) -> str:
    """One text file for each name; the glob of all."""
    at = _at(df, kind)
    df.select(name.cast("string").alias("name"), value.alias("value")).repartition("name").write.partitionBy("name").text(at)
    return f"{at}/*/*.txt"


def _name() -> Column:
    return F.regexp_extract("path", "name=([^/]+)", 1)


def _lines() -> Column:
    """A group's lines, by id."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x.line), "\n")


@R.query("poses", sql="SELECT CAST(tx AS BIGINT) AS nation, count(*) AS n, round(120 + 16 * (tx * 0.5 + count(*)), 6) AS total FROM {poses} GROUP BY tx")
def scan_matrix_text(poses):
    """A 4 x 4 matrix of each nation."""
    g = poses.groupBy(F.col("tx").cast("long").alias("nation")).agg(F.count("*").alias("n"))
    m = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (i + F.col("nation") * 0.5 + F.col("n")).cast("string")), " ")
    got = readers.read_matrix_text(poses.sparkSession, _files(g, F.col("nation"), m, "matrices"))
    rows = got.select(_name().cast("long").alias("nation"), F.round(F.aggregate("m", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))
    return rows.join(g, "nation")


@R.query("poses", sql="SELECT CAST(tx AS BIGINT) AS nation, CAST(count(*) + 0.5 AS DOUBLE) AS fx, CAST(count(*) + 1.5 AS DOUBLE) AS fy, tx AS cx, tx + 0.25 AS cy FROM {poses} GROUP BY tx")
def scan_intrinsics(poses):
    """A 3 x 3 camera matrix of each nation."""
    g = poses.groupBy("tx").agg(F.count("*").alias("n"))
    m = F.concat_ws(" ", F.col("n") + 0.5, F.lit(0), F.col("tx"), F.lit(0), F.col("n") + 1.5, F.col("tx") + 0.25, F.lit(0), F.lit(0), F.lit(1))
    got = readers.read_intrinsics(poses.sparkSession, _files(g, F.col("tx").cast("long"), m, "intrinsics"), "matrix")
    return got.select(_name().cast("long").alias("nation"), "fx", "fy", "cx", "cy")


_RANKED = "(SELECT *, row_number() OVER (PARTITION BY tx ORDER BY id) - 1 AS line FROM {poses})"


@R.query("poses", sql=f"SELECT CAST(tx AS BIGINT) AS nation, CAST(line AS INTEGER) AS line, round(-(cos(yaw) * tx + sin(yaw) * ty), 4) + 0.0 AS x, round(sin(yaw) * tx - cos(yaw) * ty, 4) + 0.0 AS y, -tz + 0.0 AS z FROM {_RANKED}")
def scan_angle_axis(poses):
    """Every pose as a rotation vector and a translation, a file a nation; inverted when read."""
    g = poses.withColumn("line", F.concat_ws(" ", "id", F.lit(0), F.lit(0), "yaw", "tx", "ty", "tz")).groupBy("tx").agg(_lines().alias("value"))
    got = readers.read_angle_axis(poses.sparkSession, _files(g, F.col("tx").cast("long"), F.col("value"), "angle-axis"))
    return got.select(_name().cast("long").alias("nation"), "line", (F.round("tx", 4) + 0.0).alias("x"), (F.round("ty", 4) + 0.0).alias("y"), (F.round("tz", 4) + 0.0).alias("z"))


@R.query("poses", sql=f"SELECT CAST(tx AS BIGINT) AS nation, CAST(line AS INTEGER) AS line, tx AS x, round(ty, 4) AS y, tz AS z, round(sin(yaw), 5) + 0.0 AS right_x, round(-cos(yaw), 5) + 0.0 AS right_y, round(320 / tan(0.5), 5) AS fx FROM {_RANKED}")
def scan_lookat(poses):
    """Every pose as position, forward and up, a file a nation."""
    line = F.concat_ws(" ", F.col("tx") * 1000, F.col("ty") * 1000, F.col("tz") * 1000, F.cos("yaw"), F.sin("yaw"), F.lit("0 0 0 1 0.5 0.4"))
    g = poses.withColumn("line", line).groupBy("tx").agg(_lines().alias("value"))
    got = readers.read_lookat(poses.sparkSession, _files(g, F.col("tx").cast("long"), F.col("value"), "lookat"), 640, 480)
    return got.select(_name().cast("long").alias("nation"), "line", "x", F.round("y", 4).alias("y"), "z", (F.round(F.col("right")[0], 5) + 0.0).alias("right_x"), (F.round(F.col("right")[1], 5) + 0.0).alias("right_y"), F.round("fx", 5).alias("fx"))


@R.query("files", sql="SELECT '/' || replace(split_part(path, '_rgb', 1), '_', '-') AS folder FROM (SELECT regexp_replace(path, '_(rgb|depth|pose)$', '_rgb') AS path, count(*) AS n FROM {files} GROUP BY 1) WHERE n = 3")
def viewpoint_folders(files):
    """Folders with all three files of a viewpoint."""
    kind = F.regexp_extract("path", "_(rgb|depth|pose)$", 1)
    name = F.when(kind == "rgb", "rgb.png").when(kind == "depth", "depth.png").otherwise("extrinsics.txt")
    paths = files.select(F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace("path", "_(rgb|depth|pose)$", ""), "_", "-"), F.lit("/"), name).alias("path"))
    return manifests.viewpoint_manifest(paths, ("rgb.png", "depth.png", "extrinsics.txt")).select("folder")


@R.query("files", sql="""
WITH p AS (SELECT split_part(path, '/', 1) AS room, path LIKE '%_rgb' AS pano, path FROM {files})
SELECT room, min(path) AS path, 'panorama' AS kind, true AS trainable FROM p WHERE pano GROUP BY room UNION ALL SELECT room, path, 'perspective', false FROM p WHERE NOT pano""")
def room_views(files):
    """One panorama and all perspective views of each room."""
    room, rest = F.split("path", "/")[0], F.split("path", "/")[1]
    paths = files.select(F.concat(F.lit("/"), room, F.when(F.col("path").endswith("_rgb"), "/panorama/").otherwise("/perspective/"), rest).alias("path"))
    return manifests.room_manifest(paths).withColumn("path", F.concat("room", F.lit("/"), F.regexp_extract("path", "([^/]+)$", 1)))


@R.query("files", "poses", sql="""
WITH a AS (SELECT split_part(path, '/', 1) AS scene, path, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY path) AS i FROM {files} WHERE path LIKE '%_rgb'),
b AS (SELECT concat('scene_', CAST(id % 10 AS VARCHAR)) AS scene, id AS line, row_number() OVER (PARTITION BY id % 10 ORDER BY id) AS i FROM {poses})
SELECT scene, a.i, path, line FROM a JOIN b USING (scene, i)""")
def ordinal_frames(files, poses):
    """Sorted images of a scene paired with its pose lines by place."""
    a = files.where("path LIKE '%_rgb'").select(F.split("path", "/")[0].alias("scene"), "path")
    b = poses.select(F.concat(F.lit("scene_"), (F.col("id") % 10).cast("string")).alias("scene"), F.col("id").alias("line"))
    return manifests.ordinal_manifest(a, b).select("scene", F.col("i").cast("long").alias("i"), "path", "line")


@R.query("steps", sql="SELECT CAST(episode AS VARCHAR) AS episode_id, CASE episode % 3 WHEN 0 THEN 'short' ELSE '' END AS style, count(*) AS n FROM {steps} GROUP BY episode")
def scan_episode_lists(steps):
    """Files that each hold a list of episodes, some without instruction data."""
    e = steps.groupBy("episode").agg(F.collect_list(F.struct(F.col("step").cast("int").alias("step"), F.array("x", "y", F.lit(0.0)).alias("pos"), F.lit(0.0).alias("heading"), F.col("action").cast("string").alias("action"))).alias("trajectory"))
    data = F.when(F.col("episode") % 3 == 0, F.struct(F.lit("short").alias("style"), F.lit("go").alias("instruction")))
    one = e.select((F.col("episode") % 20).alias("file"), F.struct(F.col("episode").cast("string").alias("episode_id"), data.alias("instruction_data"), "trajectory").alias("e"))
    glob = _files(one.groupBy("file").agg(F.to_json(F.collect_list("e")).alias("value")), F.col("file"), F.col("value"), "episode-lists")
    return readers.read_episodes(steps.sparkSession, glob).select("episode_id", "style", F.size("trajectory").cast("long").alias("n"))


@R.query("sources", sql="SELECT CASE WHEN episode % 2 = 0 THEN 'guide' ELSE 'follower' END AS role, CAST(episode AS VARCHAR) AS episode_id, source AS scene_id, concat('go to ', CAST(scene AS VARCHAR)) AS text, CAST(scene AS DOUBLE) AS goal_z FROM {sources}")
def scan_benchmark(sources):
    """Benchmark episodes by role."""
    e = F.struct(F.col("episode").cast("string").alias("episode_id"), F.col("source").alias("scene_id"), F.struct(F.concat(F.lit("go to "), F.col("scene").cast("string")).alias("instruction_text")).alias("instruction"), F.array(F.struct(F.array(F.lit(0.0), F.lit(0.0), F.col("scene").cast("double")).alias("position"), F.lit(3.0).alias("radius"))).alias("goals"))
    globs = {}
    for role, rest in (("guide", 0), ("follower", 1)):
        g = sources.where(F.col("episode") % 2 == rest).groupBy("scene").agg(F.to_json(F.struct(F.collect_list(e).alias("episodes"))).alias("value"))
        globs[role] = _files(g, F.col("scene"), F.col("value"), "benchmark")
    got = readers.read_benchmark(sources.sparkSession, globs)
    return got.select("role", "episode_id", "scene_id", F.col("instruction.instruction_text").alias("text"), F.col("goals")[0]["position"][2].alias("goal_z"))


@R.query("steps", sql="SELECT CAST(episode AS VARCHAR) AS episode_id, count(*) AS n, round(sum(x), 4) + 0.0 AS x FROM {steps} GROUP BY episode")
def scan_gt_paths(steps):
    """Ground-truth paths by episode, in two roles; the later one, in metres, overrides."""
    path = lambda k: steps.groupBy("episode").agg(F.array_sort(F.collect_list(F.struct("step", F.array(F.col("x") * k, F.col("y") * k, F.lit(0.0)).alias("at")))).alias("p"))
    globs = {}
    for role, k in (("first", 100.0), ("second", 1.0)):
        entry = F.struct(F.col("episode").cast("string").alias("key"), F.struct(F.transform("p", lambda s: s["at"]).alias("locations")).alias("value"))
        g = path(k).groupBy((F.col("episode") % 10).alias("file")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
        globs[role] = _files(g, F.col("file"), F.col("value"), "gt-paths")
    got = readers.read_gt_paths(steps.sparkSession, globs)
    total = F.aggregate("locations", F.lit(0.0), lambda s, p: s + p[0])
    return got.select("episode_id", F.size("locations").cast("long").alias("n"), (F.round(total, 4) + 0.0).alias("x"))


@R.query("sources", sql="SELECT source, concat('scans/', source, '/', CAST(scene AS VARCHAR)) AS scene_path, count(*) AS n FROM {sources} WHERE source <> 'HOUSEHOLD' GROUP BY ALL")
def scan_annotations(sources):
    """Annotations by scene path, each given to the source that its path names."""
    g = sources.groupBy("source", "scene").agg(F.collect_list(F.struct(F.array(F.lit("chair")).alias("instance_type"), F.array(F.col("episode").cast("string")).alias("instance_id"))).alias("a"))
    entry = F.struct(F.concat(F.lit("scans/"), "source", F.lit("/"), F.col("scene").cast("string")).alias("key"), F.col("a").alias("value"))
    glob = _files(g.groupBy("source").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")), F.col("source"), F.col("value"), "annotations")
    names = sources.select("source").distinct().where("source <> 'HOUSEHOLD'")
    return readers.read_annotations(sources.sparkSession, glob, names).groupBy("source", "scene_path").agg(F.count("*").alias("n"))


@R.query("files", sql="SELECT concat('images/', path, '.jpg') AS name, concat('annotations/', path, '.png') AS label FROM {files}")
def scan_split_list(files):
    """All files as a split list, with blank lines between."""
    at = _at(files, "split-list")
    files.select(F.explode(F.array(F.concat(F.lit("images/"), "path", F.lit(".jpg")), F.lit(" "))).alias("value")).write.text(at)
    return readers.read_split_list(files.sparkSession, at)


@R.query("evals", sql=EVALUATION["merged_logs"])
def scan_merged(evals):
    """The merged log, first result of an episode kept, written and read back."""
    at = _at(evals, "merged")
    tie = F.struct(F.lpad(F.col("l_partkey").cast("string"), 12, "0").alias("a"), F.lpad(F.col("l_suppkey").cast("string"), 12, "0").alias("b"), "price")
    sinks.write_merged(evals.withColumn("tie", tie), at)
    return evals.sparkSession.read.schema("scene bigint, episode string, rk bigint, line int, success int").json(at)


@R.query("evals", sql="SELECT rk, count(*) AS n, round(avg(spl), 6) AS spl FROM {evals} GROUP BY rk")
def scan_summaries(evals):
    """A one-row summary for each rank, appended to one folder by two runs and read back."""
    at = _at(evals, "summaries")
    for rest in (0, 1):
        sinks.append_summary(evals.where(F.col("rk") % 2 == rest).groupBy("rk").agg(F.count("*").alias("n"), F.round(F.avg("spl"), 6).alias("spl")), at)
    return evals.sparkSession.read.schema("rk bigint, n bigint, spl double").json(at)


@R.query("vecs", sql="SELECT vec_id AS idx, label, len(embedding)::INTEGER AS size FROM {vecs}")
def saved_features(vecs):
    """Features saved and read back, and their labels as targets saved beside them, padding dropped."""
    at = _at(vecs, "features")
    sinks.save_features(vecs.select(F.col("vec_id").alias("idx"), "embedding"), at)
    pad = vecs.select((-F.col("vec_id") - 1).alias("idx"), "embedding")
    sinks.save_aligned(vecs.sparkSession.read.parquet(at).unionByName(pad), vecs.select(F.col("vec_id").alias("idx"), "label"), f"{at}-aligned", "idx")
    return vecs.sparkSession.read.parquet(f"{at}-aligned").select("idx", "label", F.size("embedding").alias("size"))


@R.query("evals", sql="SELECT CAST(success AS BIGINT) AS success, CASE WHEN success = 1 THEN 'true' ELSE 'false' END AS won, spl, episode, count(*) AS n FROM {evals} GROUP BY ALL")
def result_columns(evals):
    """Result columns as text, long or double."""
    typed = sinks.result_types(evals.select("success", (F.col("success") == 1).alias("won"), "spl", "episode"))
    return typed.groupBy(*typed.columns).agg(F.count("*").alias("n"))


@R.query("pixels", sql="""
SELECT g.image, g.u, g.v, round(coalesce(p.gt, 0.0)::FLOAT::DOUBLE, 4) AS depth FROM (
  SELECT image, u, v FROM (SELECT DISTINCT image FROM {pixels}), (SELECT unnest(generate_series(0, 31)) AS u), (SELECT unnest(generate_series(0, 23)) AS v)) g
LEFT JOIN {pixels} p ON g.image = p.image AND g.u = p.u AND g.v = p.v""")
def depth_frames(pixels):
    """Every image's depth as a raw frame, and back to pixels."""
    frames = sinks.encode_depth_frames(pixels, 32, 24, "gt")
    out = readers.explode_depth_frames(frames)
    return out.select(F.col("path").cast("long").alias("image"), "u", "v", F.round(F.col("depth").cast("double"), 4).alias("depth"))


QUERIES, SQL = R.queries, R.sql
