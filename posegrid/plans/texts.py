"""Queries over conversations, file lists and names (views chat, files, documents, objects)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from posegrid.functions import text as X
from posegrid.plans.register import Registry
from posegrid.rand import seeded, sql_seeded
from posegrid.sources import manifests as S

R = Registry()


@R.query("files", sql="WITH p AS (SELECT regexp_extract(path, '^(scene_[0-9]+)/', 1) AS scene, regexp_extract(path, '/([0-9]+)_', 1) AS uuid, regexp_extract(path, '_(rgb|depth|pose)$', 1) AS part FROM {files}) SELECT scene, uuid FROM p GROUP BY ALL HAVING count(DISTINCT part) = 3")
def frame_manifest(files):
    return S.flat_manifest(files).select("scene", "uuid")


_FRAMES = "p AS (SELECT regexp_extract(path, '^(scene_[0-9]+)/', 1) AS scene, regexp_extract(path, '/([0-9]+)_', 1) AS uuid, regexp_extract(path, '_(rgb|depth|pose)$', 1) AS part FROM {files})"


@R.query("files", sql=f"WITH {_FRAMES} SELECT scene, uuid, concat(scene, '/color/', uuid, '.jpg') AS rgb, concat(scene, '/depth/', uuid, '.png') AS depth, concat(scene, '/pose/', uuid, '.txt') AS pose FROM p GROUP BY scene, uuid HAVING count(DISTINCT part) = 3")
def sequence_manifest(files):
    part = F.regexp_extract("path", "_(rgb|depth|pose)$", 1)
    stem = F.regexp_replace(F.regexp_replace("path", "_(rgb|depth|pose)$", ""), "/", F.concat(F.lit("/"), F.when(part == "rgb", "color").otherwise(part), F.lit("/")))
    return S.sequence_manifest(files.select(F.concat(stem, F.when(part == "rgb", ".jpg").when(part == "depth", ".png").otherwise(".txt")).alias("path")))


@R.query("files", sql=f"WITH {_FRAMES} SELECT scene, uuid, concat(scene, '/', uuid, '.color.jpg') AS rgb, concat(scene, '/', uuid, '.depth.pgm') AS depth, concat(scene, '/', uuid, '.pose.txt') AS pose FROM p GROUP BY scene, uuid HAVING count(DISTINCT part) = 3")
def triplet_manifest(files):
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", "_rgb$", ".color.jpg"), "_depth$", ".depth.pgm"), "_pose$", ".pose.txt")
    return S.triplet_manifest(files.select(path.alias("path")))


@R.query("files", sql="SELECT DISTINCT regexp_extract(path, '^scene_([0-9]+)/', 1) AS scene FROM {files}")
def list_scenes(files):
    return S.list_scenes(files, "^scene_([0-9]+)/")


@R.query("files", sql="""
WITH p AS (SELECT path, regexp_extract(path, '^(scene_[0-9]+)/', 1) AS class_id, CAST(regexp_extract(path, '/([0-9]+)_', 1) AS BIGINT) AS actual FROM {files})
SELECT path, class_id, actual, dense_rank() OVER (ORDER BY class_id) - 1 AS class_index FROM p""")
def image_class_index(files):
    return S.class_index(files, "^(scene_[0-9]+)/", "/([0-9]+)_").select("path", "class_id", "actual", "class_index")


@R.query("files", sql="""
WITH b AS (SELECT regexp_extract(path, '^(scene_[0-9]+)/', 1) AS class_id, path, CAST(regexp_extract(path, '/([0-9]+)_', 1) AS BIGINT) * 3 + CASE WHEN path LIKE '%rgb' THEN 0 WHEN path LIKE '%depth' THEN 1 ELSE 2 END AS block FROM {files})
SELECT class_id, path, block * 512 AS start_offset, lead(block) OVER (PARTITION BY class_id ORDER BY block, path) * 512 AS end_offset FROM b""")
def block_index(files):
    part = F.when(F.col("path").endswith("rgb"), 0).when(F.col("path").endswith("depth"), 1).otherwise(2)
    logs = files.select(F.regexp_extract("path", "^(scene_[0-9]+)/", 1).alias("class_id"), "path", (F.regexp_extract("path", "/([0-9]+)_", 1).cast("long") * 3 + part).alias("block"))
    return S.block_offsets(logs)


@R.query("files", sql="WITH s AS (SELECT DISTINCT split_part(path, '/', 1) AS scene FROM {files}), d AS (SELECT DISTINCT split_part(path, '/', 1) AS scene FROM {files} WHERE path LIKE '%7_rgb') SELECT scene FROM s WHERE scene NOT IN (SELECT scene FROM d)")
def pending_scenes(files):
    s = files.select(F.substring_index("path", "/", 1).alias("scene")).distinct()
    return S.pending(s, files.where("path LIKE '%7_rgb'").select(F.substring_index("path", "/", 1).alias("scene")).distinct(), ["scene"])


_PART = "CASE WHEN path LIKE '%rgb' THEN 'rgb' WHEN path LIKE '%depth' THEN 'depth' ELSE 'pose' END"


@R.query("files", sql=f"SELECT scene, path FROM (SELECT split_part(path, '/', 1) AS scene, path, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY {sql_seeded(11, 'path')}, path) AS k FROM {{files}}) WHERE k <= 5")
def sample_per_scene(files):
    from posegrid.operators.sampling import sample_per_group

    return sample_per_group(files.select(F.substring_index("path", "/", 1).alias("scene"), "path"), ["scene"], 5, 11, ["path"]).select("scene", "path")


@R.query("files", sql=f"SELECT path, CASE WHEN kind = 'pose' THEN 'target' WHEN k <= 10 THEN 'source' ELSE 'spare' END AS role FROM (SELECT path, {_PART} AS kind, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY CASE {_PART} WHEN 'rgb' THEN 0 WHEN 'depth' THEN 1 ELSE 2 END, {sql_seeded(5, 'path')}, path) AS k FROM {{files}})")
def allocate_roles(files):
    kind = F.when(F.col("path").endswith("rgb"), 0).when(F.col("path").endswith("depth"), 1).otherwise(2)
    w = Window.partitionBy(F.substring_index("path", "/", 1)).orderBy(kind, seeded(5, "path"), "path")
    return files.withColumn("k", F.row_number().over(w)).select("path", F.when(kind == 2, "target").when(F.col("k") <= 10, "source").otherwise("spare").alias("role"))


@R.query("files", sql="SELECT split_part(path, '/', 1) AS scene, arg_max(path, CAST(regexp_extract(path, '/([0-9]+)_', 1) AS BIGINT)) AS latest FROM {files} WHERE path LIKE '%rgb' GROUP BY split_part(path, '/', 1)")
def latest_artifact(files):
    return S.latest(files.where("path LIKE '%rgb'").withColumn("scene", F.substring_index("path", "/", 1)), ["scene"], "/([0-9]+)_")


@R.query("files", sql="SELECT path FROM (SELECT path, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY CAST(regexp_extract(path, '/([0-9]+)_', 1) AS BIGINT) DESC) AS k FROM {files} WHERE path LIKE '%rgb') WHERE k <= 3")
def retained_artifacts(files):
    return S.retain_last(files.where("path LIKE '%rgb'").withColumn("scene", F.substring_index("path", "/", 1)), ["scene"], "/([0-9]+)_", 3).select("path")


@R.query("files", sql="SELECT scene, (row_number() OVER (ORDER BY scene) - 1) % 3 AS shard FROM (SELECT DISTINCT split_part(path, '/', 1) AS scene FROM {files})")
def sharded_scenes(files):
    from posegrid.operators.sampling import shard

    return shard(files.select(F.substring_index("path", "/", 1).alias("scene")).distinct(), ["scene"], 3).select("scene", "shard")


@R.query("files", sql="SELECT path, regexp_replace(list_extract(string_split(path, '/'), -1), '[.][^.]*$', '') AS stem, concat('data/', substr(path, 7)) AS moved, replace(concat(split_part(path, '/', 1), '_x'), 'scene_', '') AS scene FROM {files}")
def path_names(files):
    p = F.col("path")
    return files.select("path", X.file_stem(p).alias("stem"), X.reroot(p, "scene_", "data/").alias("moved"), X.output_scene(F.concat(F.lit("output_"), F.substring_index(p, "/", 1), F.lit("_x"))).alias("scene"))


@R.query("files", sql=f"SELECT path, {sql_seeded(9, 'path')} AS seed FROM {{files}}")
def stable_seeds(files):
    return files.select("path", seeded(9, "path").alias("seed"))


@R.query("chat", sql="SELECT conv_id, turn, concat(role, '_conv-', CAST(conv_id AS VARCHAR), '_', lpad(CAST(turn AS VARCHAR), 4, '0')) AS id FROM {chat}")
def episode_ids(chat):
    i = X.episode_id(F.concat(F.lit("conv/"), F.col("conv_id").cast("string")), F.lit("s"), F.col("turn"))
    return chat.select("conv_id", "turn", F.concat(F.col("role"), F.lit("_"), F.replace(i, F.lit("_s_"), F.lit("_"))).alias("id"))


_T = "go to the {object} now"


@R.query("chat", sql=f"""
WITH a AS (SELECT conv_id, turn, role, CASE WHEN turn % 3 = 0 THEN '' ELSE concat('1. object ', text) END AS c, concat('the ', text) AS r FROM {{chat}}),
b AS (SELECT *, coalesce(nullif(c, ''), r) AS t FROM a), d AS (SELECT *, CASE WHEN length(t) > 100 THEN '{_T.replace('{', '{{').replace('}', '}}') if False else 'go to the object now'}' ELSE t END AS t2 FROM b),
e AS (SELECT *, trim(regexp_replace(replace(t2, 'object', role), '^[0-9]+[.][ \\t\\n\\r\\f\\v]*', '')) AS t3 FROM d)
SELECT conv_id, turn, t3 AS instruction FROM e WHERE t3 <> '' AND NOT contains(t3, 'object')""")
def clean_instructions(chat):
    c = F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit("1. object "), "text"))
    i = X.clean_instruction(c, F.concat(F.lit("the "), "text"), F.col("role"), "go to the object now")
    return chat.select("conv_id", "turn", i.alias("instruction")).where("instruction IS NOT NULL")


_TEMPLATES = ["find the {object}", "walk to the {object}", "go near the {object}"]


@R.query("chat", sql=f"SELECT conv_id, turn, replace(CASE {sql_seeded(4, 'conv_id')} % 3 WHEN 0 THEN 'find the #' WHEN 1 THEN 'walk to the #' ELSE 'go near the #' END, '#', role) AS instruction FROM {{chat}}")
def filled_templates(chat):
    return chat.select("conv_id", "turn", X.fill_template(_TEMPLATES, 4, F.col("conv_id"), F.col("role")).alias("instruction"))


def _pick(xs, tag):
    return f"CASE {sql_seeded(f'6{tag}', 'conv_id')} % {len(xs)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(xs)) + " END"


@R.query("chat", sql=f"SELECT conv_id, turn, concat_ws('/', {_pick(X.STYLES, 's')}, {_pick(X.SYNTAX, 'x')}, {_pick(X.TONES, 't')}) AS style FROM {{chat}}")
def style_prompts(chat):
    return chat.select("conv_id", "turn", X.style_prompt(6, F.col("conv_id")).alias("style"))


@R.query("chat", sql="SELECT conv_id, turn, concat(CASE turn % 6 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(X.PREFIXES)) + " END, CASE WHEN turn > 0 AND turn % 8 = 0 THEN ' (remember the task)' ELSE '' END) AS prefix FROM {chat}")
def round_prefixes(chat):
    return chat.select("conv_id", "turn", X.round_prefix(F.col("turn")).alias("prefix"))


_MARK = "concat(CASE conv_id % 4 WHEN 0 THEN 'STOP ' WHEN 1 THEN '↑ ' WHEN 2 THEN '← ' ELSE '' END, text, CASE WHEN turn % 2 = 0 THEN ' → ↑' ELSE '' END)"


@R.query("chat", sql=f"SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all({_MARK}, '(STOP|↑|←|→)', 1), lambda t: CASE t WHEN 'STOP' THEN '0' WHEN '↑' THEN '1' WHEN '←' THEN '2' ELSE '3' END), ',') AS actions FROM {{chat}}")
def action_tokens(chat):
    return chat.select("conv_id", "turn", F.array_join(X.action_tokens(F.expr(_MARK)).cast("array<string>"), ",").alias("actions"))


_REPLY = "CASE conv_id % 3 WHEN 0 THEN concat('INVALID: too short ', role) WHEN 1 THEN concat('ok INSTRUCTION: \"', text, '\"') ELSE text END"


@R.query("chat", sql=f"""
WITH r AS (SELECT conv_id, turn, {_REPLY} AS t FROM {{chat}}), i AS (SELECT *, instr(t, 'INVALID') AS b, instr(t, 'INSTRUCTION:') AS g FROM r)
SELECT conv_id, turn, NOT (b > 0 AND (g = 0 OR b < g)) AS accepted, CASE WHEN b > 0 AND (g = 0 OR b < g) THEN trim(regexp_replace(substr(t, b + 7), '^[: ]+', '')) ELSE trim(regexp_replace(trim(replace(CASE WHEN g > 0 THEN substr(t, g + 12) ELSE t END, '```', '')), '^"+|"+$', '', 'g')) END AS said FROM i""")
def verdicts(chat):
    ok, said = X.verdict(F.expr(_REPLY))
    return chat.select("conv_id", "turn", ok.alias("accepted"), said.alias("said"))


@R.query("documents", sql="SELECT doc_id, length(substr(coalesce(text, ''), 1, 2000)) AS n, md5(substr(coalesce(text, ''), 1, 2000)) AS digest FROM {documents}")
def truncated_texts(documents):
    t = X.truncate(F.col("text"))
    return documents.select("doc_id", F.length(t).alias("n"), F.md5(t.cast("binary")).alias("digest"))


@R.query("chat", sql="SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN NULL WHEN conv_id % 2 = 0 THEN 0.25 * turn END AS ratio FROM {chat}")
def parsed_ratios(chat):
    j = F.when(F.col("turn") % 4 == 0, F.lit("{broken")).otherwise(F.concat(F.lit('{"r'), (F.col("conv_id") % 2).cast("string"), F.lit('": '), (F.col("turn") * 0.25).cast("string"), F.lit("}")))
    return chat.select("conv_id", "turn", F.element_at(X.ratios(j), "r0").alias("ratio"))


@R.query("objects", "part", sql="""
WITH w AS (SELECT p_type AS cls, CASE WHEN length(p_type) % 2 = 0 THEN 'manipulation' ELSE 'other' END AS grp FROM part WHERE p_type <> 'PROMO' GROUP BY p_type)
SELECT scene, grp, count(*) AS n, count(DISTINCT o.cls) AS classes FROM {objects} o JOIN w ON o.cls = w.cls GROUP BY scene, grp""")
def vocabulary_groups(objects, part):
    """Objects of a vocabulary, made of the part table's types but one, by the groups of their classes."""
    words = part.where("p_type <> 'PROMO'").select(F.col("p_type").alias("cls"), F.when(F.length("p_type") % 2 == 0, "manipulation").otherwise("other").alias("grp"))
    return X.with_vocabulary(objects, words).groupBy("scene", "grp").agg(F.count("*").alias("n"), F.countDistinct("cls").alias("classes"))


@R.query("objects", sql="SELECT scene, CASE WHEN cls IN ('STANDARD', 'SMALL', 'MEDIUM') THEN 'manipulation' ELSE 'other' END AS grp, count(*) AS n FROM {objects} GROUP BY ALL")
def class_groups(objects):
    return objects.groupBy("scene", X.class_group(F.col("cls"), ("STANDARD", "SMALL", "MEDIUM")).alias("grp")).agg(F.count("*").alias("n"))


@R.query("chat", sql="""
WITH t AS (SELECT conv_id, turn, unnest(l) AS tok, unnest(generate_series(1, len(l))) AS i FROM (SELECT conv_id, turn, string_split(concat('a <s> ', coalesce(text, ''), ' </s> b'), ' ') AS l FROM {chat})),
m AS (SELECT *, coalesce(max(CASE WHEN tok = '<s>' THEN i END) OVER w, 0) AS s, coalesce(max(CASE WHEN tok = '</s>' THEN i END) OVER w, 0) AS e FROM t WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i))
SELECT conv_id, turn, string_agg(CASE WHEN tok NOT IN ('<s>', '</s>') AND s > e THEN tok ELSE '_' END, ' ' ORDER BY i) AS marked FROM m GROUP BY conv_id, turn""")
def marked_spans(chat):
    tokens = F.split(F.concat(F.lit("a <s> "), F.coalesce("text", F.lit("")), F.lit(" </s> b")), " ")
    return chat.select("conv_id", "turn", X.marked_spans(tokens, "<s>", "</s>").alias("m")).select("conv_id", "turn", F.array_join("m", " ", "_").alias("marked"))


@R.query("chat", sql="SELECT conv_id, turn, concat('Set', CAST(conv_id % 3 AS VARCHAR)) AS name, CASE WHEN turn % 2 = 0 THEN 'train' ELSE NULL END AS split, turn % 3 <> 0 AS valid FROM {chat}")
def descriptors(chat):
    d = F.concat(F.lit("Set"), (F.col("conv_id") % 3).cast("string"), F.when(F.col("turn") % 2 == 0, ":split=train").otherwise(""), F.when(F.col("turn") % 3 == 0, ":bad=1").otherwise(":root=/x"))
    name, opts, ok = X.parse_descriptor(d)
    return chat.select("conv_id", "turn", name.alias("name"), F.element_at(opts, "split").alias("split"), ok.alias("valid"))


@R.query("chat", sql="SELECT conv_id, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS roles, max(turn) AS last FROM {chat} GROUP BY conv_id")
def captions(chat):
    images = chat.select(F.col("conv_id").alias("id")).distinct().withColumn("file_name", F.col("id").cast("string"))
    c = S.captions(images, chat.select(F.col("conv_id").alias("image_id"), F.col("turn").alias("ord"), F.col("role").alias("caption")))
    last = chat.groupBy(F.col("conv_id").alias("id")).agg(F.max("turn").alias("last"))
    return c.join(last, "id").select(F.col("id").alias("conv_id"), F.size("captions").cast("long").alias("n"), F.array_join("captions", ",").alias("roles"), "last")


@R.query("chat", sql="SELECT conv_id, turn, k - 1 AS ordinal, concat('ep', CAST(conv_id AS VARCHAR), '_', CAST(k AS VARCHAR)) AS id FROM {chat}, (SELECT unnest([1, 2]) AS k)")
def episode_index(chat):
    j = F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in ('[{"episode_id": "ep', F.col("conv_id").cast("string"), '_1", "trajectory": []}, {"episode_id": "ep', F.col("conv_id").cast("string"), '_2"}]')])
    return S.episode_index(chat.select("conv_id", "turn", j.alias("json")), "json").select("conv_id", "turn", "ordinal", "id")


@R.query("chat", sql="SELECT conv_id, turn, role FROM {chat} WHERE role IN ('user', 'system')")
def allow_lists(chat):
    return S.allowed(S.allowed(chat, "role", ["user", "system"]), "conv_id", ["*"]).select("conv_id", "turn", "role")


@R.query("chat", sql=f"SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY {sql_seeded(2, 'conv_id', 'turn')}, turn) AS k FROM {{chat}}) WHERE k <= 2")
def capped_ids(chat):
    from posegrid.operators.sampling import sample_per_group

    return sample_per_group(chat, ["conv_id"], 2, 2, ["conv_id", "turn"], tie=["turn"]).select("conv_id", "turn")


@R.query("chat", sql="SELECT conv_id, turn, concat_ws(',', CASE WHEN conv_id % 4 = 0 THEN 1 ELSE 0 END, CASE WHEN conv_id % 4 = 1 OR turn % 4 = 1 THEN 1 ELSE 0 END, CASE WHEN conv_id % 4 = 2 OR turn % 4 = 2 THEN 1 ELSE 0 END) AS hot FROM (SELECT conv_id, CASE WHEN turn % 4 = 0 THEN 5 ELSE turn % 4 END AS t4, turn FROM {chat})")
def multi_hot(chat):
    from posegrid.functions.geometry import multi_hot as hot

    labels = F.array((F.col("conv_id") % 4).cast("int"), F.when(F.col("turn") % 4 == 0, F.lit(5)).otherwise((F.col("turn") % 4).cast("int")))
    return chat.select("conv_id", "turn", F.array_join(hot(labels, 3).cast("array<string>"), ",").alias("hot"))


@R.query("chat", sql="WITH s AS (SELECT conv_id, list(turn ORDER BY turn) AS l FROM {chat} GROUP BY conv_id), m AS (SELECT max(len(l)) AS m FROM s) SELECT conv_id, len(l) AS n, m - len(l) AS pads FROM s, m")
def padded_labels(chat):
    s = chat.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("l"))
    padded = S.pad_arrays(s, "l")
    return padded.select("conv_id", F.size(F.filter("l", lambda x: x >= 0)).alias("n"), F.size(F.filter("l", lambda x: x == -1)).alias("pads"))


QUERIES, SQL = R.queries, R.sql
