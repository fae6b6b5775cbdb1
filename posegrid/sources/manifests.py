"""Manifests and indexes: frames, scenes, classes, blocks, episodes, captions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posegrid.operators.ranks import numbered

PARTS = ("rgb", "depth", "pose")


def flat_manifest(files: DataFrame) -> DataFrame:
    """scene, uuid and the paths of its parts, from <scene>/<uuid>_<part>; incomplete uuids dropped."""
    p = files.select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("scene"), F.regexp_extract("path", "([^/]*)_[a-z]+(?:\\.[a-z0-9]+)?$", 1).alias("uuid"), F.regexp_extract("path", "_([a-z]+)(?:\\.[a-z0-9]+)?$", 1).alias("part"))
    wide = p.where(F.col("part").isin(*PARTS)).groupBy("scene", "uuid").pivot("part", list(PARTS)).agg(F.min("path"))
    return wide.where(" AND ".join(f"{c} IS NOT NULL" for c in PARTS))


def viewpoint_manifest(files: DataFrame, required: tuple[str, ...] = ("rgb.png", "depth.png", "extrinsics.txt", "depth_scale.txt")) -> DataFrame:
    """folder and the paths of its required files; the key is the parent folder, however deep."""
    p = files.select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"))
    wide = p.where(F.col("name").isin(*required)).groupBy("folder").pivot("name", list(required)).agg(F.min("path"))
    return wide.where(" AND ".join(f"`{c}` IS NOT NULL" for c in required)).select("folder", *[F.col(f"`{c}`").alias(c.split(".")[0]) for c in required])


def room_manifest(files: DataFrame) -> DataFrame:
    """room, path, kind, trainable: one panorama a room (trainable) and its perspective views (not)."""
    p = files.select("path", F.regexp_extract("path", "/([^/]+)/(?:panorama|perspective)/", 1).alias("room"))
    pano = p.where("path LIKE '%/panorama/%'").groupBy("room").agg(F.min("path").alias("path")).select("room", "path", F.lit("panorama").alias("kind"), F.lit(True).alias("trainable"))
    return pano.unionByName(p.where("path LIKE '%/perspective/%'").select("room", "path", F.lit("perspective").alias("kind"), F.lit(False).alias("trainable")))


def sequence_manifest(files: DataFrame) -> DataFrame:
    """scene, uuid, rgb, depth, pose: frames of scenes with the folders color, depth and pose, named by
    the file's name up to its first dot. Colour images are jpg, depths png, poses txt; frames that
    lack a part are dropped."""
    kinds = {"color": ("jpg", "rgb"), "depth": ("png", "depth"), "pose": ("txt", "pose")}
    found = F.lit(None).cast("string")
    for folder, (ending, part) in kinds.items():
        found = F.when(F.col("path").rlike(f"(^|/){folder}/[^/]+[.]{ending}$"), part).otherwise(found)
    d = files.select("path", found.alias("_part"), F.regexp_extract("path", "^(.*?)/?[^/]+/[^/]+$", 1).alias("scene"), F.substring_index(F.substring_index("path", "/", -1), ".", 1).alias("uuid"))
    return _complete(d)


def triplet_manifest(files: DataFrame) -> DataFrame:
    """scene, uuid, rgb, depth, pose: frames written as one prefix with .color.jpg, .depth.pgm and
    .pose.txt in one folder, which is the scene; frames that lack a part are dropped."""
    found = F.when(F.col("path").endswith(".color.jpg"), "rgb").when(F.col("path").endswith(".depth.pgm"), "depth").when(F.col("path").endswith(".pose.txt"), "pose")
    name = F.substring_index("path", "/", -1)
    return _complete(files.select("path", found.alias("_part"), F.regexp_extract("path", "^(.*?)/?[^/]+$", 1).alias("scene"), F.regexp_replace(name, "[.][^.]*[.][^.]*$", "").alias("uuid")))


def _complete(parts: DataFrame) -> DataFrame:
    """The frames that have all parts, one row each; the least path where a part is there twice."""
    each = [F.min(F.when(F.col("_part") == p, F.col("path"))).alias(p) for p in ("rgb", "depth", "pose")]
    return parts.where("_part IS NOT NULL").groupBy("scene", "uuid").agg(*each).where("rgb IS NOT NULL AND depth IS NOT NULL AND pose IS NOT NULL")


def ordinal_manifest(files: DataFrame, poses: DataFrame, group: str = "scene", order: str = "path", line: str = "line") -> DataFrame:
    """Sorted files of a scene paired with its pose lines by place; the shorter side decides."""
    a = files.withColumn("i", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    b = poses.withColumn("i", F.row_number().over(Window.partitionBy(group).orderBy(line)))
    return a.join(b, [group, "i"])


def list_scenes(files: DataFrame, pattern: str) -> DataFrame:
    return files.select(F.regexp_extract("path", pattern, 1).alias("scene")).where("scene <> ''").distinct()


def class_index(files: DataFrame, class_pattern: str, ordinal_pattern: str, names: DataFrame | None = None) -> DataFrame:
    """path, class_id, actual, class_index (dense, by class id) and class_name if names (class_id,
    class_name) are given. The class list is what is ranked; Spark sends it whole where it is small."""
    d = files.select("path", F.regexp_extract("path", class_pattern, 1).alias("class_id"), F.regexp_extract("path", ordinal_pattern, 1).cast("long").alias("actual"))
    ids = numbered(d.select("class_id").distinct(), ["class_id"], "class_index").withColumn("class_index", F.col("class_index").cast("int"))
    out = d.join(ids, "class_id")
    return out if names is None else out.join(names, "class_id", "left")


def block_offsets(logs: DataFrame, order: str = "block", size: int = 512) -> DataFrame:
    """class_id, path, start_offset, end_offset of files in a tar, from their block numbers; the last
    row's end is null."""
    end = F.lead(order).over(Window.partitionBy("class_id").orderBy(order, "path"))
    return logs.select("class_id", "path", (F.col(order) * size).alias("start_offset"), (end * size).alias("end_offset"))


def pending(inputs: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs without outputs: the rest of an incremental run."""
    return inputs.join(outputs.select(*keys).distinct(), keys, "left_anti")


def latest(files: DataFrame, keys: list[str], pattern: str) -> DataFrame:
    return files.groupBy(*keys).agg(F.max_by("path", F.regexp_extract("path", pattern, 1).cast("long")).alias("latest"))


def retain_last(files: DataFrame, keys: list[str], pattern: str, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(F.regexp_extract("path", pattern, 1).cast("long")), F.desc("path"))
    return files.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def episode_index(rows: DataFrame, text: str) -> DataFrame:
    """One row an episode of a JSON text, by patterns and without decoding: ordinal and id; where
    there are no ids one row for each "trajectory"; one row if there is neither."""
    ids = F.regexp_extract_all(text, F.lit('"episode_id"\\s*:\\s*"?([^",}\\s]+)'), F.lit(1))
    n = F.greatest(F.lit(1), F.regexp_count(text, F.lit('"trajectory"')))
    other = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lit(None).cast("string"))
    return rows.select("*", F.posexplode(F.when(F.size(ids) > 0, ids).otherwise(other)).alias("ordinal", "id"))


def captions(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Images with captions, in order; an empty list without any."""
    c = annotations.groupBy(F.col("image_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "caption"))), lambda s: s.caption).alias("captions"))
    return images.join(c, "id", "left").withColumn("captions", F.coalesce("captions", F.array().cast("array<string>")))


def allowed(rows: DataFrame, col: str, values: list[str], wildcard: str = "*") -> DataFrame:
    return rows if wildcard in values else rows.where(F.col(col).isin(*values))


def pad_arrays(rows: DataFrame, col: str, pad: int = -1) -> DataFrame:
    """Arrays padded to the longest one's length."""
    most = rows.agg(F.max(F.size(col)).alias("_m"))
    return rows.crossJoin(F.broadcast(most)).withColumn(col, F.concat(col, F.array_repeat(F.lit(pad).cast("long"), F.col("_m") - F.size(col)))).drop("_m")


def first_source(scenes: DataFrame, registry: DataFrame) -> DataFrame:
    """Each scene with the first registry source (source, ord, scene) that has it; others dropped."""
    hit = scenes.join(registry, "scene")
    return hit.withColumn("_k", F.row_number().over(Window.partitionBy(*scenes.columns).orderBy("ord"))).where("_k = 1").drop("_k", "ord")
