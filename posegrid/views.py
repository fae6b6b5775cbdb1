"""Binding views: the library's tables over the given star schema, as SQL both engines read.

Braces name the tables a view reads; Spark binds them to DataFrames, DuckDB reads them by name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_TURN = "CASE event_type WHEN 'view' THEN -1 WHEN 'signup' THEN 1 ELSE 0 END"
VIEWS = {
    # logged actions by user: 1 forward, 2 left, 3 right, 0 stop; headings are ticks of 15 degrees
    "steps": f"""
      SELECT episode, step, action, tick, round(coalesce(sum(fwd * 0.25 * sin(tick * pi() / 12)) OVER w, 0.0), 6) + 0.0 AS x, round(coalesce(sum(fwd * 0.25 * cos(tick * pi() / 12)) OVER w, 0.0), 6) + 0.0 AS y
      FROM (SELECT episode, step, action, CASE WHEN action = 1 THEN 1 ELSE 0 END AS fwd, ((coalesce(sum(turn) OVER (PARTITION BY episode ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 24) + 24) % 24 AS tick
            FROM (SELECT user_id AS episode, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step,
                         CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 3 ELSE 0 END AS action, {_TURN} AS turn
                  FROM {{events}}) a) b
      WINDOW w AS (PARTITION BY episode ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    # scenes are suppliers, whose number grows with the tables; a scene is 3 m by 3 m
    "cloud": """
      SELECT l_suppkey AS scene, (l_partkey % 60) * 5 + l_linenumber % 5 AS x_cm, (l_orderkey % 60) * 5 AS y_cm, CAST(floor(l_quantity) AS BIGINT) % 3 AS z_cm,
             l_discount AS r, l_tax AS g, l_quantity / 50 AS b, l_extendedprice AS price, l_orderkey, l_partkey, l_suppkey, l_linenumber
      FROM {lineitem}""",
    "cells": """
      SELECT DISTINCT l_suppkey AS scene, l_partkey % 60 AS gx, l_orderkey % 60 AS gy FROM {lineitem}
      WHERE (7 * (l_partkey % 60) + 13 * (l_orderkey % 60)) % 11 <> 0""",
    "pixels": """
      SELECT image, u, v, gt, gt * (0.75 + 5 * d) AS pred, r, g, b FROM (
        SELECT l_suppkey AS image, l_partkey % 32 AS u, l_orderkey % 24 AS v, max(l_extendedprice) / 10000 AS gt, min(l_discount) AS d,
               max(l_quantity) / 50 AS r, max(l_tax) * 10 AS g, min(l_discount) * 10 AS b
        FROM {lineitem} GROUP BY l_suppkey, l_partkey % 32, l_orderkey % 24) p""",
    "seg": """
      SELECT l_orderkey AS image, l_partkey % 8 AS pred, CASE WHEN l_linenumber = 7 THEN 255 WHEN l_suppkey % 3 = 0 THEN l_partkey % 8 ELSE l_orderkey % 8 END AS label
      FROM {lineitem}""",
    "evals": """
      SELECT l_suppkey % 8 AS rk, l_linenumber AS line, o_custkey % 20 AS scene, CAST(l_orderkey AS STRING) AS episode, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS success,
             l_quantity / 10 AS ne, CASE WHEN o_orderstatus = 'F' THEN 1 - l_discount ELSE 0.0 END AS spl, l_returnflag AS corruption, 1 + l_linenumber % 5 AS lvl, l_partkey, l_suppkey, l_extendedprice AS price
      FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "files": """
      SELECT DISTINCT concat('scene_', CAST(l_orderkey % 10 AS STRING), '/', CAST(l_orderkey AS STRING), '_', CASE l_linenumber % 3 WHEN 0 THEN 'rgb' WHEN 1 THEN 'depth' ELSE 'pose' END) AS path
      FROM {lineitem}""",
    "objects": """
      SELECT l_suppkey AS scene, p_type AS cls, (l_partkey % 60) * 5 + l_linenumber % 5 AS x_cm, (l_orderkey % 60) * 5 AS y_cm, CAST(floor(l_quantity) AS BIGINT) % 3 AS z_cm,
             l_discount * 10 AS conf, p_size, l_quantity, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice AS price
      FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "boxes": """
      SELECT l_orderkey AS image, l_partkey % 100 AS cx, l_suppkey AS cy, 1 + l_quantity AS w, 1 + l_linenumber AS h, l_discount + l_tax AS score, l_returnflag AS cls, l_partkey, l_suppkey, l_linenumber, l_extendedprice AS price
      FROM {lineitem}""",
    "poses": """
      SELECT c_custkey AS id, CAST(c_nationkey AS DOUBLE) AS tx, c_acctbal / 100 AS ty, CAST(c_nationkey % 5 AS DOUBLE) AS tz, (c_custkey % 360) * pi() / 180 AS yaw, c_mktsegment AS kind,
             CASE c_mktsegment WHEN 'BUILDING' THEN 'matterport' WHEN 'MACHINERY' THEN 'gibson' WHEN 'AUTOMOBILE' THEN 'realsee' WHEN 'FURNITURE' THEN 'structured3d_perspective' ELSE 'other' END AS frame
      FROM {customer}""",
    "sources": "SELECT c_mktsegment AS source, c_nationkey AS scene, c_custkey AS episode FROM {customer}",
    "chat": "SELECT conv_id, turn, role, text FROM {conversations}",
    # ten class scores of every vector: some of its coordinates, the true class raised a little
    "preds": """
      SELECT vec_id AS q, cls, round(CAST(list_extract(embedding, cls * 6 + 1) AS DOUBLE), 3) + CASE WHEN cls = label THEN 0.1 ELSE 0.0 END AS score, label
      FROM {embeddings} CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) AS c(cls)""",
    "vecs": "SELECT vec_id, embedding, label FROM {embeddings}",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A binding view, or a base table, as a DataFrame."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name].replace("list_extract", "element_at")
    return spark.sql(sql, **{t: view(spark, sf_dir, t) for t in set(re.findall(r"{(\w+)}", sql))})


def with_views(sql: str) -> str:
    """DuckDB SQL with the views it names as leading CTEs (names in braces)."""
    used = [n for n in VIEWS if f"{{{n}}}" in sql]
    plain = lambda s: re.sub(r"{(\w+)}", r"\1", s)
    ctes = [f"{n} AS ({plain(VIEWS[n])})" for n in used]
    body = plain(sql).strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(ctes)}, {body[15:]}" if ctes else body
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(ctes)}, {body[5:]}" if ctes else body
    return f"WITH {', '.join(ctes)} {body}" if ctes else body
