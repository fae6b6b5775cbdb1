"""Queries over logged trajectories (views steps, events, chat)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from posegrid.operators import trajectories as T
from posegrid.plans.register import Registry
from posegrid.rand import seeded, sql_seeded

R = Registry()
_H = "sqrt(({a}) * ({a}) + ({b}) * ({b}))"
_W = "(PARTITION BY episode ORDER BY step)"
_UP = "(PARTITION BY episode ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_LEG = f"coalesce({_H.format(a=f'x - lag(x) OVER {_W}', b=f'y - lag(y) OVER {_W}')}, 0.0)"
_STUCK = f"""stuckness AS (SELECT *, coalesce(round({_H.format(a=f'x - lag(x, 3) OVER {_W}', b=f'y - lag(y, 3) OVER {_W}')}, 6) <= 0.1
  AND abs((((tick - lag(tick, 3) OVER {_W} + 12) % 24) + 24) % 24 - 12) <= 1, false) AS stuck FROM {{steps}})"""


def _xy(df, *cols):
    return df.select(*cols, F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def goals_of(steps):
    """Goal and shortest way of each episode: its last place, and the straight line there from the first."""
    g = steps.groupBy("episode").agg(F.max_by("x", "step").alias("goal_x"), F.max_by("y", "step").alias("goal_y"), F.min_by("x", "step").alias("x0"), F.min_by("y", "step").alias("y0"))
    dx, dy = F.col("goal_x") - F.col("x0"), F.col("goal_y") - F.col("y0")
    return g.select("episode", "goal_x", "goal_y", F.sqrt(dx * dx + dy * dy).alias("shortest"))


@R.query("steps", sql=f"""
WITH g AS (SELECT episode, arg_max(x, step) AS gx, arg_max(y, step) AS gy, arg_min(x, step) AS x0, arg_min(y, step) AS y0 FROM {{steps}} GROUP BY episode),
d AS (SELECT s.episode, step, round({_H.format(a='x - gx', b='y - gy')}, 6) AS d, {_LEG.replace('episode', 's.episode')} AS leg, {_H.format(a='gx - x0', b='gy - y0')} AS shortest FROM {{steps}} s JOIN g ON s.episode = g.episode),
e AS (SELECT *, sum(leg) OVER {_UP} AS so_far FROM d),
f AS (SELECT *, CASE WHEN d < 3.0 THEN shortest / greatest(shortest, so_far, 1e-9) ELSE 0.0 END AS s FROM e)
SELECT episode, count(*) AS steps_taken, round(sum(leg), 6) AS path_length, arg_max(d, step) AS navigation_error, min(d) AS oracle_error, max(CASE WHEN d < 3.0 THEN 1 ELSE 0 END) AS oracle_success,
  round(arg_max(s, step), 6) AS spl, round(max(s), 6) AS oracle_spl, CASE WHEN arg_max(d, step) < 3.0 THEN 1 ELSE 0 END AS success FROM f GROUP BY episode""")  # fmt: skip
def nav_metrics(steps):
    return T.nav_metrics(steps, goals_of(steps))


@R.query("events", sql="SELECT episode, step, action, tick, round(x, 6) AS x, round(y, 6) AS y FROM {steps}")
def dead_reckoning(events):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.col("event_type")
    action = F.when(kind.isin("click", "purchase"), 1).when(kind == "view", 2).when(kind == "signup", 3).otherwise(0)
    acts = events.select(F.col("user_id").alias("episode"), (F.row_number().over(w) - 1).alias("step"), action.alias("action"))
    return _xy(T.dead_reckon(acts), "episode", "step", "action", "tick")


@R.query("steps", sql=f"WITH {_STUCK} SELECT episode, step FROM stuckness WHERE stuck")
def stuck_steps(steps):
    return T.stuck_steps(steps).where("stuck").select("episode", "step")


@R.query("steps", sql=f"""
WITH {_STUCK}, a AS (SELECT *, min(CASE WHEN stuck THEN step END) OVER (PARTITION BY episode) AS cut FROM stuckness),
b AS (SELECT * FROM a WHERE cut IS NULL OR step < cut)
SELECT episode, step, CASE WHEN cut IS NOT NULL AND step = max(step) OVER (PARTITION BY episode) THEN 0 ELSE action END AS action FROM b""")
def truncate_stuck(steps):
    return T.truncate_stuck(T.stuck_steps(steps)).select("episode", "step", "action")


_LEGS = _STUCK.replace("{steps}", "(SELECT episode * 1000 + step // 8 AS episode, step, action, tick, x, y FROM {steps})")


@R.query("steps", sql=f"WITH {_LEGS} SELECT episode, count(*) AS n FROM stuckness GROUP BY episode HAVING count(CASE WHEN stuck THEN 1 END) = 0")
def reject_stuck(steps):
    """Legs of eight steps that are nowhere stuck."""
    legs = steps.withColumn("episode", F.col("episode") * 1000 + F.floor(F.col("step") / 8))
    return T.truncate_stuck(T.stuck_steps(legs), "reject").groupBy("episode").agg(F.count("*").alias("n"))


@R.query("steps", sql="SELECT episode, step, action FROM (SELECT *, count(*) OVER (PARTITION BY episode) AS n FROM {steps}) WHERE n >= 60")
def min_length(steps):
    return T.min_length(steps, 60).select("episode", "step", "action")


@R.query("steps")
def macro_steps(steps):
    return T.macro_steps(steps)


@R.query("steps", sql=f"""
WITH c AS (SELECT episode, step // 4 AS chunk, {_H.format(a='arg_max(x, step) - arg_min(x, step)', b='arg_max(y, step) - arg_min(y, step)')} AS moved,
  15.0 * ((((arg_max(tick, step) - arg_min(tick, step) + 12) % 24) + 24) % 24 - 12) AS turned, arg_max(action, step) AS action FROM {{steps}} GROUP BY episode, step // 4),
p AS (SELECT *, CASE WHEN action = 0 THEN 'stop' WHEN abs(turned) >= 45 THEN CASE WHEN turned > 0 THEN 'turn right' ELSE 'turn left' END WHEN round(moved, 6) >= 1.0 THEN 'go forward' END AS own FROM c)
SELECT episode, chunk, last_value(own IGNORE NULLS) OVER (PARTITION BY episode ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS phrase FROM p""")  # fmt: skip
def movement_phrases(steps):
    g = steps.groupBy("episode", F.floor(F.col("step") / 4).alias("chunk"))
    dx, dy = F.max_by("x", "step") - F.min_by("x", "step"), F.max_by("y", "step") - F.min_by("y", "step")
    c = g.agg(F.round(F.sqrt(dx * dx + dy * dy), 6).alias("moved"), (T.wrap_ticks(F.max_by("tick", "step") - F.min_by("tick", "step")) * 15.0).alias("turned"), F.max_by("action", "step").alias("action"))
    return T.movement_phrase(c).select("episode", "chunk", "phrase")


@R.query("steps", sql="SELECT episode, coalesce(min(CASE WHEN action NOT IN (2, 3) THEN step END), count(*)) AS turns FROM {steps} GROUP BY episode")
def initial_turns(steps):
    return T.initial_turns(steps)


@R.query("steps", sql=f"SELECT episode, step, concat_ws(',', action, coalesce(lead(action, 1) OVER {_W}, 0), coalesce(lead(action, 2) OVER {_W}, 0), coalesce(lead(action, 3) OVER {_W}, 0)) AS chunk FROM {{steps}}")
def action_chunks(steps):
    return T.action_chunk(steps, 4).select("episode", "step", F.array_join(F.col("chunk").cast("array<string>"), ",").alias("chunk"))


@R.query("steps", sql="SELECT episode, step FROM {steps} WHERE step % 4 = 0")
def stride_pool(steps):
    return T.stride_pool(steps, 4).select("episode", "step")


@R.query("steps", sql="""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY step) - 1 AS i, count(*) OVER (PARTITION BY episode) AS n FROM {steps}),
k AS (SELECT DISTINCT episode, CAST(round_even(j * (n - 1) / 15.0, 0) AS BIGINT) AS i FROM (SELECT DISTINCT episode, n FROM n), (SELECT unnest(generate_series(0, 15)) AS j))
SELECT n.episode, n.step FROM n JOIN k ON n.episode = k.episode AND n.i = k.i""")
def linspace_downsample(steps):
    return T.linspace_downsample(steps, 16).select("episode", "step")


@R.query("steps", sql="""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY step) - 1 AS i, count(*) OVER (PARTITION BY episode) AS n FROM {steps}),
k AS (SELECT DISTINCT episode, CAST(round_even(j * (n - 1) / 7.0, 0) AS BIGINT) AS i FROM (SELECT DISTINCT episode, n FROM n), (SELECT unnest(generate_series(0, 7)) AS j))
SELECT n.episode, n.step FROM n JOIN k ON n.episode = k.episode AND n.i = k.i""")
def sample_uniform(steps):
    return T.sample_uniform(steps, 8).select("episode", "step")


@R.query("steps")
def sample_jittered(steps):
    return T.sample_uniform(steps.select("episode", "step", "action"), 8, jitter=0.4, seed=3)


@R.query("chat", sql="""
WITH b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM {chat}),
o AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM b WHERE back > 2),
k AS (SELECT DISTINCT conv_id, CAST(round_even(j * (n - 1) / 1.0, 0) AS BIGINT) AS i FROM (SELECT DISTINCT conv_id, n FROM o), (SELECT unnest(generate_series(0, 1)) AS j))
SELECT conv_id, turn FROM b WHERE back <= 2 UNION ALL SELECT o.conv_id, o.turn FROM o JOIN k ON o.conv_id = k.conv_id AND o.i = k.i""")
def history_context(chat):
    return T.history_context(chat.select("conv_id", "turn"), recent=2, sparse=2)


@R.query("chat")
def history_flush(chat):
    return T.history_flush(chat.select("conv_id", "turn"), capacity=4, keep=3)


_PASS = "SELECT episode, step, n, i, CASE WHEN n > 5 AND i > 2 AND i < n - 1 THEN avg(x) OVER w ELSE x END AS x, CASE WHEN n > 5 AND i > 2 AND i < n - 1 THEN avg(y) OVER w ELSE y END AS y FROM {} WINDOW w AS (PARTITION BY episode ORDER BY step ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"


@R.query("steps", sql=f"""
WITH p0 AS (SELECT episode, step, count(*) OVER (PARTITION BY episode) AS n, row_number() OVER {_W} AS i, x, y FROM {{steps}}),
{', '.join(f'p{k + 1} AS ({_PASS.format(f"p{k}")})' for k in range(5))}
SELECT episode, step, round(x, 6) AS x, round(y, 6) AS y FROM p5""")
def smooth_paths(steps):
    return _xy(T.smooth_path(steps), "episode", "step")


@R.query("events", sql="""
WITH w AS (SELECT event_id, value, list_sort(list(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) AS l,
  avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m, max(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS x,
  avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM {events})
SELECT event_id, l[(len(l) - 1) // 2 + 1] AS median, round(m + 1e-9, 6) AS mean, x AS most, round(g + 1e-9, 6) AS global_mean FROM w""")
def smoothed_value(events):
    out = T.smoothed_value(events, "event_type", "value", ["ts", "event_id"])
    return out.select("event_id", "median", F.round(F.col("mean") + 1e-9, 6).alias("mean"), "most", F.round(F.col("global_mean") + 1e-9, 6).alias("global_mean"))


@R.query("steps", sql=f"""
WITH g AS (SELECT *, sum(CASE WHEN action <> 1 THEN 0 ELSE 1 END) OVER {_UP} AS g FROM {{steps}})
SELECT episode, step, sum(CASE WHEN action <> 1 THEN 1 ELSE 0 END) OVER (PARTITION BY episode, g ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS run FROM g""")
def non_forward_run(steps):
    return T.non_forward_run(steps).select("episode", "step", "run")


@R.query("steps", sql=f"""
WITH m AS (SELECT *, coalesce({_H.format(a=f'x - lag(x) OVER {_W}', b=f'y - lag(y) OVER {_W}')} < 0.125, false) AS s FROM {{steps}}),
g AS (SELECT *, sum(CASE WHEN s THEN 0 ELSE 1 END) OVER {_UP} AS g FROM m),
r AS (SELECT episode, step, sum(CASE WHEN s THEN 1 ELSE 0 END) OVER (PARTITION BY episode, g ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS run FROM g)
SELECT episode, step, run, CASE WHEN run >= 12 THEN 'stop' WHEN run >= 4 THEN 'warn' ELSE 'ok' END AS state FROM r""")
def stuck_run(steps):
    return T.stuck_run(steps).select("episode", "step", "run", "state")


@R.query("steps", sql=f"""
WITH f AS (SELECT *, {sql_seeded('turns', 'episode')} % 23 - 11 AS k, {sql_seeded('use', 'episode')} / 4294967296.0 < 0.8 AS c FROM {{steps}} WHERE step = 0),
n AS (SELECT episode, abs(k) AS n, k FROM f WHERE c AND k <> 0),
front AS (SELECT f.episode, j - abs(k) - 1 AS step, CASE WHEN k > 0 THEN 3 ELSE 2 END AS action, (((tick - sign(k) * (abs(k) - j + 1)) % 24) + 24) % 24 AS tick FROM f, (SELECT unnest(generate_series(1, 11)) AS j) WHERE c AND k <> 0 AND j <= abs(k)),
al AS (SELECT * FROM front UNION ALL SELECT episode, step, action, tick FROM {{steps}})
SELECT episode, row_number() OVER (PARTITION BY episode ORDER BY step) - 1 AS step, action, CAST(tick AS BIGINT) AS tick FROM al""")
def augment_start(steps):
    turns = (seeded("turns", "episode") % 23 - 11).cast("int")
    return T.augment_start(steps, turns, seeded("use", "episode") / 4294967296.0 < 0.8).select("episode", "step", "action", F.col("tick").cast("long").alias("tick"))


@R.query("steps", sql=f"""
SELECT episode, step FROM (SELECT episode, step, row_number() OVER {_W} AS i, x IS NOT DISTINCT FROM lag(x) OVER {_W} AND y IS NOT DISTINCT FROM lag(y) OVER {_W} AS same FROM {{steps}}) WHERE NOT (same AND i > 1)""")
def dedupe_consecutive(steps):
    return T.dedupe_consecutive(steps).select("episode", "step")


@R.query("steps", sql=f"""
WITH g AS (SELECT episode, arg_max(x, step) AS gx, arg_max(y, step) AS gy FROM {{steps}} GROUP BY episode),
a AS (SELECT s.*, coalesce(lead(x, 8) OVER {_W.replace('episode', 's.episode')}, gx) AS tx, coalesce(lead(y, 8) OVER {_W.replace('episode', 's.episode')}, gy) AS ty, {_H.format(a='gx - x', b='gy - y')} AS gd FROM {{steps}} s JOIN g ON s.episode = g.episode),
b AS (SELECT *, round({_H.format(a='tx - x', b='ty - y')}, 6) AS d, round(degrees(pi() / 2 - atan2(ty - y, tx - x)) - tick * 15.0, 6) + 180.0 AS t FROM a),
c AS (SELECT *, ((t % 360.0) + 360.0) % 360.0 - 180.0 AS turn FROM b)
SELECT episode, step, CASE WHEN gd < 0.5 THEN 0 WHEN d < 0.05 OR round(abs(turn), 6) <= 12.0 THEN 1 WHEN turn > 0 THEN 3 ELSE 2 END AS label FROM c""")  # fmt: skip
def expert_labels(steps):
    g = steps.groupBy("episode").agg(F.max_by("x", "step").alias("gx"), F.max_by("y", "step").alias("gy"))
    dx, dy = F.col("gx") - F.col("x"), F.col("gy") - F.col("y")
    s = steps.join(g, "episode").withColumn("tx", F.coalesce(F.lead("x", 8).over(T.in_order()), F.col("gx"))).withColumn("ty", F.coalesce(F.lead("y", 8).over(T.in_order()), F.col("gy")))
    return T.expert_label(s.withColumn("goal_distance", F.sqrt(dx * dx + dy * dy))).select("episode", "step", "label")


@R.query("steps", sql=f"""
WITH g AS (SELECT *, sum(CASE WHEN action <> 1 THEN 0 ELSE 1 END) OVER {_UP} AS g FROM {{steps}}),
r AS (SELECT *, sum(CASE WHEN action <> 1 THEN 1 ELSE 0 END) OVER (PARTITION BY episode, g ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM g)
SELECT episode, step, CASE WHEN run >= 3 AND action IN (2, 3) AND action = lag(action) OVER {_W} THEN 1 ELSE action END AS action FROM r""")
def break_loops(steps):
    return T.break_loop(steps, run=3).select("episode", "step", "action")


def _path(steps):
    p = T.stride_pool(steps, 5)
    return p.select("episode", (F.col("step") / 5).cast("long").alias("i"), F.col("x").alias("px"), F.col("y").alias("py"))


@R.query("steps")
def waypoint_progress(steps):
    return T.waypoint_progress(steps.select("episode", "step", "x", "y"), _path(steps)).select("episode", "step", "waypoint")


@R.query("steps")
def forward_match(steps):
    return T.forward_match(steps.select("episode", "step", "x", "y"), _path(steps)).select("episode", "step", "matched")


@R.query("steps", sql=f"""
SELECT a.episode, a.step, coalesce(min(CASE WHEN b.step > a.step AND round({_H.format(a='b.x - a.x', b='b.y - a.y')}, 6) >= 1.75 THEN b.step END), max(b.step)) AS subgoal
FROM {{steps}} a JOIN {{steps}} b ON a.episode = b.episode GROUP BY a.episode, a.step""")
def next_subgoal(steps):
    return T.next_subgoal(steps.select("episode", "step", "x", "y"), 1.75)


@R.query("steps")
def relabel_paths(steps):
    return T.relabel(steps.select("episode", "step", "tick", "x", "y")).select("episode", "step", "matched", "subgoal", "label")


@R.query("steps", sql=f"""
WITH l AS (SELECT episode, step, x, y, {_LEG} AS leg FROM {{steps}}),
a AS (SELECT episode, count(*) AS n, sum(leg) AS i, arg_min(x, step) AS ax, arg_min(y, step) AS ay, arg_max(x, step) AS bx, arg_max(y, step) AS b_y FROM l GROUP BY episode)
SELECT episode, round(CASE WHEN n < 2 THEN sqrt(2.0) ELSE i + {_H.format(a='ax', b='ay')} + {_H.format(a='bx - 1.0', b='b_y - 1.0')} END, 6) AS length FROM a""")
def snapped_length(steps):
    s = steps.withColumn("sx", F.lit(0.0)).withColumn("sy", F.lit(0.0)).withColumn("gx", F.lit(1.0)).withColumn("gy", F.lit(1.0))
    return T.path_length_with_legs(s, ("sx", "sy"), ("gx", "gy")).select("episode", F.round("length", 6).alias("length"))


def _scored(steps):
    truth = T.stride_pool(steps, 3)
    w = Window.partitionBy("episode")
    success = steps.groupBy("episode").agg((F.max_by("action", "step") == 0).cast("int").alias("success"))
    return T.ndtw(steps, truth).join(success, "episode")


@R.query("steps")
def ndtw(steps):
    return _scored(steps).select("episode", F.round("ndtw", 6).alias("ndtw"))


@R.query("steps")
def sdtw(steps):
    return _scored(steps).select("episode", F.round(F.col("success") * F.col("ndtw"), 6).alias("sdtw"))


@R.query("evals", sql="SELECT round(coalesce(avg(success), 0.0), 6) AS success, round(coalesce(avg(spl), 0.0), 6) AS spl, round(coalesce(avg(ne), 0.0), 6) AS ne, count(*) AS n FROM {evals}")
def nav_summary(evals):
    s = T.nav_summary(evals.select("success", "spl", "ne"))
    return s.select(*[F.round(c, 6).alias(c) for c in ("success", "spl", "ne")], "n")


QUERIES, SQL = R.queries, R.sql
