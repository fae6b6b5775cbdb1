"""Readers, sinks and manifests on fixture files written here."""

import gzip
import json
import math
import struct

import pytest
from pyspark.sql import functions as F

from posegrid.sources import manifests, readers, sinks


def test_text_layouts(spark, tmp_path):
    (tmp_path / "a_pose.txt").write_text("1.5, 2 3 0 0 0 1\n")
    (tmp_path / "b_pose.txt").write_text("1 2\n")
    r = readers.read_pose_text(spark, f"{tmp_path}/*_pose.txt").collect()
    assert len(r) == 1 and (r[0].tx, r[0].qw) == (1.5, 1.0)
    (tmp_path / "m1.txt").write_text("\n".join(["1 0 0 5"] * 4))
    (tmp_path / "m2.txt").write_text("nan " * 16)
    m = readers.read_matrix_text(spark, f"{tmp_path}/m*.txt").collect()
    assert len(m) == 1 and m[0].m[3] == 5.0
    (tmp_path / "k.pincam").write_text("640 480 500 510 320 240")
    k = readers.read_intrinsics(spark, f"{tmp_path}/k.pincam", "line").first()
    assert (k.fx, k.fy, k.cx, k.cy) == (500.0, 510.0, 320.0, 240.0)
    (tmp_path / "i.mat").write_text("500 0 320 0\n0 510 240 0\n0 0 1 0\n0 0 0 1")
    k = readers.read_intrinsics(spark, f"{tmp_path}/i.mat", "matrix").first()
    assert (k.fx, k.fy, k.cx, k.cy) == (500.0, 510.0, 320.0, 240.0)
    (tmp_path / "i.txt2").write_text("x = 1\n" * 9 + "m = 500 510 320 240\n")
    assert readers.read_intrinsics(spark, f"{tmp_path}/i.txt2", "keyed").first().fy == 510.0
    (tmp_path / "w.traj").write_text(f"7 0 0 {math.pi / 2} 1 0 0\nbroken\n")
    t = readers.read_angle_axis(spark, f"{tmp_path}/w.traj").collect()
    assert len(t) == 1 and math.isclose(t[0].ty, 1.0) and abs(t[0].tx) < 1e-12
    (tmp_path / "cam.txt").write_text("1000 2000 3000 0 1 0 0 0 1 0.5 0.4\n")
    c = readers.read_lookat(spark, f"{tmp_path}/cam.txt", 640, 480).first()
    assert (c.x, c.z) == (1.0, 3.0) and c.right == [1.0, 0.0, 0.0] and math.isclose(c.fx, 320 / math.tan(0.5))
    (tmp_path / "names.lst").write_text("images/a.jpg\n\n")
    assert readers.read_split_list(spark, f"{tmp_path}/names.lst").first().label == "annotations/a.png"
    (tmp_path / "cols.lst").write_text("a.jpg None 518.8\n")
    assert tuple(readers.read_split_list(spark, f"{tmp_path}/cols.lst", "columns").first()) == ("a.jpg", None, 518.8)


def test_json_layouts(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"episode_id": "x", "trajectory": [{"step": 0, "pos": [1, 2, 3], "heading": 0.5, "action": "STOP"}]}))
    (tmp_path / "two.json").write_text(json.dumps([{"episode_id": "y"}, {"instruction_data": {"style": "s", "instruction": "go"}}]))
    e = {(r.episode_id, r.style): r for r in readers.read_episodes(spark, f"{tmp_path}/*.json").collect()}
    assert set(e) == {("x", ""), ("y", ""), ("", "s")} and e[("y", "")].trajectory == []
    assert readers.episode_steps(readers.read_episodes(spark, f"{tmp_path}/one.json")).first().z == 3.0
    with gzip.open(tmp_path / "val.json.gz", "wt") as f:
        json.dump({"episodes": [{"episode_id": 7, "scene_id": "s", "instruction": {"instruction_text": "t"}, "goals": [{"position": [0, 0, 1], "radius": 3}]}]}, f)
    b = readers.read_benchmark(spark, {"guide": f"{tmp_path}/val.json.gz"}).first()
    assert (b.role, b.episode_id, b.instruction.instruction_text) == ("guide", "7", "t")
    for i, n in enumerate(("gt1", "gt2")):
        (tmp_path / f"{n}.gt").write_text(json.dumps({"7": {"locations": [[i, 0, 0]]}}))
    g = readers.read_gt_paths(spark, {"a": f"{tmp_path}/gt1.gt", "b": f"{tmp_path}/gt2.gt"}).collect()
    assert len(g) == 1 and g[0].locations == [[1.0, 0.0, 0.0]]
    (tmp_path / "reg.registry").write_text(json.dumps({"hm": {"dataset_type": "d", "traj_dir": "t"}, "zz": {}}))
    reg = readers.read_registry(spark, f"{tmp_path}/reg.registry")
    assert {r.source for r in reg.collect()} == {"hm", "zz"}
    (tmp_path / "ann.anno").write_text(json.dumps({"scans/hm/1": [{"instance_type": ["chair"], "context": ["c"]}], "scans/none/1": [{}]}))
    a = readers.read_annotations(spark, f"{tmp_path}/ann.anno", reg).collect()
    assert len(a) == 1 and a[0].source == "hm" and a[0].instance_type == ["chair"]
    (tmp_path / "log.jsonl").write_text('{"a": 1}\n\n[1]\n{"a": \n{"a": 2}\n')
    assert sorted(r.a for r in readers.read_jsonl_tolerant(spark, f"{tmp_path}/log.jsonl", "a int").collect()) == [1, 2]
    assert readers.read_jsonl_tolerant(spark, f"{tmp_path}/missing.jsonl", "a int").count() == 0


def test_depth_frames(spark, tmp_path):
    (tmp_path / "f.dpt").write_bytes(struct.pack("<fii", 202021.25, 2, 2) + struct.pack("<4f", 1, 2, 3, 4))
    (tmp_path / "g.dpt").write_bytes(b"short")
    d = readers.explode_depth_frames(spark.read.format("binaryFile").load(f"{tmp_path}/*.dpt")).collect()
    assert {(r.u, r.v, r.depth) for r in d} == {(0, 0, 1.0), (1, 0, 2.0), (0, 1, 3.0), (1, 1, 4.0)}


def test_manifests(spark):
    files = spark.createDataFrame([("s/v/0/rgb.png",), ("s/v/0/depth.png",), ("s/v/0/extrinsics.txt",), ("s/v/0/depth_scale.txt",), ("s/v/1/rgb.png",)], "path string")
    assert [r.folder for r in manifests.viewpoint_manifest(files).collect()] == ["s/v/0"]
    rooms = spark.createDataFrame([("h/kitchen/panorama/a.png",), ("h/kitchen/perspective/b.png",), ("h/kitchen/perspective/c.png",)], "path string")
    assert sorted((r.kind, r.trainable) for r in manifests.room_manifest(rooms).collect()) == [("panorama", True), ("perspective", False), ("perspective", False)]
    frames = spark.createDataFrame([("a", "2.png"), ("a", "1.png"), ("a", "3.png")], "scene string, path string")
    poses = spark.createDataFrame([("a", 4, 0.5), ("a", 9, 0.7)], "scene string, line int, tx double")
    assert sorted((r.path, r.tx) for r in manifests.ordinal_manifest(frames, poses).collect()) == [("1.png", 0.5), ("2.png", 0.7)]
    reg = spark.createDataFrame([("b", 1, "x"), ("a", 0, "x")], "source string, ord int, scene string")
    assert manifests.first_source(spark.createDataFrame([("x",), ("y",)], "scene string"), reg).collect()[0].source == "a"
    e = manifests.episode_index(spark.createDataFrame([('{"trajectory": 1, "trajectory": 2}',), ("nothing",)], "j string"), "j").collect()
    assert sorted((r.ordinal, r.id) for r in e) == [(0, None), (0, None), (1, None)]


def test_sinks(spark, tmp_path):
    with pytest.raises(TypeError):
        sinks.result_types(spark.createDataFrame([([1],)], "a array<int>"))
    d = spark.createDataFrame([(1, True, 1.5, None)], "i int, b boolean, f float, s string")
    assert sinks.result_types(d).dtypes == [("i", "bigint"), ("b", "string"), ("f", "double"), ("s", "string")]
    sinks.save_results(d, f"{tmp_path}/r.csv")
    assert tuple(readers.read_results(spark, f"{tmp_path}/r.csv", "i long, b string, f double, s string").first()) == (1, "true", 1.5, None)
    logs = spark.createDataFrame([(0, 1, 5, "a", 1), (1, 0, 5, "a", 2), (0, 0, None, "b", 3)], "rk int, line int, scene int, episode string, tie int")
    sinks.write_merged(logs, f"{tmp_path}/m")
    assert [r.tie for r in spark.read.json(f"{tmp_path}/m").collect()] == [1]
    p = spark.createDataFrame([(-1, 0.1), (3, 0.2)], "idx int, score double")
    sinks.save_aligned(p, spark.createDataFrame([(3, 1)], "idx int, target int"), f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").select("idx", "score", "target").collect() == [(3, 0.2, 1)]
    sinks.append_summary(spark.range(1), f"{tmp_path}/s")
    sinks.append_summary(spark.range(1), f"{tmp_path}/s")
    assert spark.read.json(f"{tmp_path}/s").count() == 2
    sinks.save_features(spark.createDataFrame([(1, [0.5, 1.0])], "id long, embedding array<float>"), f"{tmp_path}/f")
    assert spark.read.parquet(f"{tmp_path}/f").first().embedding == [0.5, 1.0]
    with pytest.raises(ValueError):
        sinks.expect_rows(d, 2)
    assert sinks.expect_rows(d, 1).count() == 1
    assert manifests.pending(spark.range(3).select(F.col("id")), spark.range(1, 2).select("id"), ["id"]).count() == 2
