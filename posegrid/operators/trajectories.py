"""Trajectory operators over step tables (episode, step, action, x, y and so on).

Actions: 0 stop, 1 forward, 2 left, 3 right. Every operator works within an episode by windows or
one aggregation; the few whose next state depends on an earlier decision run as one pandas group
for each episode.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from posegrid.operators.ranks import pieces


def in_order() -> WindowSpec:
    return Window.partitionBy("episode").orderBy("step")


def whole() -> WindowSpec:
    return Window.partitionBy("episode")


def before() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, -1)


def dead_reckon(actions: DataFrame, step_m: float = 0.25, ticks: int = 24) -> DataFrame:
    """episode, step, action, tick, x, y: positions before each logged action, without collisions.
    A turn is one tick; heading 0 is +y and grows clockwise."""
    turn = F.when(F.col("action") == 3, 1).when(F.col("action") == 2, -1).otherwise(0)
    out = actions.withColumn("tick", F.pmod(F.coalesce(F.sum(turn).over(before()), F.lit(0)), F.lit(ticks)))
    angle = F.col("tick") * (2 * math.pi / ticks)
    forward = F.when(F.col("action") == 1, step_m).otherwise(0.0)
    return out.withColumn("x", F.coalesce(F.sum(forward * F.sin(angle)).over(before()), F.lit(0.0))).withColumn("y", F.coalesce(F.sum(forward * F.cos(angle)).over(before()), F.lit(0.0)))


def wrap_ticks(d: Column, ticks: int = 24) -> Column:
    """A difference of ticks as -ticks/2 up to ticks/2 - 1."""
    return F.pmod(d + ticks // 2, F.lit(ticks)) - ticks // 2


def _moved(k: int = 1) -> Column:
    dx, dy = F.col("x") - F.lag("x", k).over(in_order()), F.col("y") - F.lag("y", k).over(in_order())
    return F.sqrt(dx * dx + dy * dy)


def stuck_steps(steps: DataFrame, states: int = 4, reach: float = 0.1, turn: int = 1) -> DataFrame:
    """Steps with column stuck: over the last `states` states moved at most `reach` and turned at most `turn` ticks."""
    k = states - 1
    turned = F.abs(wrap_ticks(F.col("tick") - F.lag("tick", k).over(in_order())))
    return steps.withColumn("stuck", F.coalesce((F.round(_moved(k), 6) <= reach) & (turned <= turn), F.lit(False)))


def truncate_stuck(steps: DataFrame, mode: str = "truncate") -> DataFrame:
    """truncate: keep the steps before an episode's first stuck one and make the last kept a stop;
    reject: keep only episodes that are never stuck."""
    at = F.min(F.when(F.col("stuck"), F.col("step"))).over(whole())
    if mode == "reject":
        return steps.withColumn("_at", at).where("_at IS NULL").drop("_at")
    kept = steps.withColumn("_at", at).where("_at IS NULL OR step < _at")
    last = F.col("step") == F.max("step").over(whole())
    return kept.withColumn("action", F.when(last & F.col("_at").isNotNull(), 0).otherwise(F.col("action"))).drop("_at")


def min_length(steps: DataFrame, n: int = 5) -> DataFrame:
    return steps.withColumn("_n", F.count("*").over(whole())).where(F.col("_n") >= n).drop("_n")


def macro_steps(steps: DataFrame, far: float = 1.0, turned: int = 3) -> DataFrame:
    """Odometry chunks: cut where stopped, or moved at least `far` or turned at least `turned` ticks
    since the chunk began; what is left is a last chunk. One group for each episode, as each cut
    moves the start of the next chunk."""

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step")
        x, y, tick, action, step = (pdf[c].to_numpy() for c in ("x", "y", "tick", "action", "step"))
        out, a = [], 0
        for i in range(len(pdf)):
            moved = math.hypot(x[i] - x[a], y[i] - y[a])
            turn = int((tick[i] - tick[a] + 12) % 24 - 12)
            if i > a and (action[i] == 0 or moved >= far - 1e-9 or abs(turn) >= turned) or i == len(pdf) - 1:
                out.append((pdf["episode"].iloc[0], len(out), step[a], step[i], round(moved, 6), turn, int(action[i])))
                a = i
        return pd.DataFrame(out, columns=["episode", "chunk", "first", "last", "moved", "turned", "action"])

    return steps.select("episode", "step", "action", "tick", "x", "y").groupBy("episode").applyInPandas(cut, "episode long, chunk int, first long, last long, moved double, turned int, action int")


def movement_phrase(chunks: DataFrame, order: str = "chunk") -> DataFrame:
    """Chunks with column phrase, from distance (m), turn (degrees) and action; a short move with a
    turn under 45 degrees keeps the phrase before, null if there is none."""
    d, t = F.col("moved"), F.col("turned")
    own = F.when(F.col("action") == 0, F.lit("stop")).when(F.abs(t) >= 45, F.when(t > 0, F.lit("turn right")).otherwise(F.lit("turn left"))).when(d >= 1.0, F.lit("go forward"))
    w = Window.partitionBy("episode").orderBy(order)
    return chunks.withColumn("phrase", F.last(own, ignorenulls=True).over(w))


def initial_turns(steps: DataFrame) -> DataFrame:
    """episode, turns: rotations before the first other action; all steps if there is none."""
    first = F.min(F.when(~F.col("action").isin(2, 3), F.col("step")))
    return steps.groupBy("episode").agg(F.coalesce(first, F.count("*")).alias("turns"))


def action_chunk(steps: DataFrame, f: int = 4) -> DataFrame:
    """Steps with chunk: this and the next f - 1 actions, padded with stop."""
    return steps.withColumn("chunk", F.array(*[F.coalesce(F.lead("action", i).over(in_order()), F.lit(0)) for i in range(f)]))


def stride_pool(steps: DataFrame, f: int = 4) -> DataFrame:
    return steps.where(F.col("step") % f == 0)


def linspace_downsample(rows: DataFrame, k: int, group: str = "episode", order: str = "step") -> DataFrame:
    """Rows at indices round-half-even(linspace(0, n - 1, k)), distinct; all rows if n <= k."""
    w = Window.partitionBy(group)
    n = rows.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    wanted = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.bround(j * (F.col("_n") - 1) / F.lit(float(max(1, k - 1)))).cast("int")))
    return n.where((F.col("_n") <= k) | F.array_contains(wanted, F.col("_i").cast("int"))).drop("_i", "_n")


def sample_uniform(rows: DataFrame, k: int, jitter: float = 0.0, seed: int = 0) -> DataFrame:
    """k of n steps with both ends kept. Inner places move by up to `jitter` strides; places that
    fall together are refilled with the least free ones. jitter 0 is linspace_downsample."""
    if jitter == 0:
        return linspace_downsample(rows, k)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step").reset_index(drop=True)
        n = len(pdf)
        if n <= k:
            return pdf
        rng = np.random.default_rng([seed, int(pdf["episode"].iloc[0])])
        stride = (n - 1) / (k - 1)
        at = np.arange(k) * stride
        at[1:-1] += rng.uniform(-jitter, jitter, k - 2) * stride
        got = set(np.clip(np.rint(at), 0, n - 1).astype(int).tolist()) | {0, n - 1}
        got |= set([i for i in range(n) if i not in got][: k - len(got)])
        return pdf.iloc[sorted(got)]

    return rows.groupBy("episode").applyInPandas(pick, rows.schema)


def history_context(rounds: DataFrame, recent: int = 16, sparse: int = 48, group: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last `recent` rounds, and of the older ones `sparse` by linspace."""
    back = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))
    marked = rounds.withColumn("_back", back)
    old = linspace_downsample(marked.where(F.col("_back") > recent).drop("_back"), sparse, group, order)
    return old.unionByName(marked.where(F.col("_back") <= recent).drop("_back"))


def history_flush(rounds: DataFrame, capacity: int = 64, keep: int = 48, group: str = "conv_id", order: str = "turn") -> DataFrame:
    """History held in a buffer that, at `capacity` rounds, is thinned to `keep` by linspace. Each
    flush depends on the one before, so a group is handled in order."""

    def flush(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order).reset_index(drop=True)
        held: list[int] = []
        for i in range(len(pdf)):
            held.append(i)
            if len(held) >= capacity:
                at = np.unique(np.rint(np.linspace(0, len(held) - 1, keep)).astype(int))
                held = [held[j] for j in at]
        return pdf.iloc[held]

    return rounds.groupBy(group).applyInPandas(flush, rounds.schema)


def smooth_path(steps: DataFrame, passes: int = 5) -> DataFrame:
    """`passes` centred 5-point means of x and y; ends stay; paths of 5 points or fewer stay."""
    around = in_order().rowsBetween(-2, 2)
    out = steps.withColumn("_n", F.count("*").over(whole())).withColumn("_i", F.row_number().over(in_order()))
    inner = (F.col("_n") > 5) & (F.col("_i") > 2) & (F.col("_i") < F.col("_n") - 1)
    for _ in range(passes):
        out = out.select(*[c for c in out.columns if c not in ("x", "y")], *[F.when(inner, F.avg(c).over(around)).otherwise(F.col(c)).alias(c) for c in ("x", "y")])
    return out.drop("_n", "_i")


def smoothed_value(rows: DataFrame, key: str, value: str, order: list[str], n: int = 20, size: int = 1 << 15) -> DataFrame:
    """Lower median, mean and max over the last n values of a key, and the running global mean.

    A key's rows are cut into pieces of `size`, each with the n - 1 rows before it and the sums of
    the pieces before, so a task's rows don't grow with a key. The order must tell rows apart."""
    d = pieces(rows.withColumn("_v", F.col(value)), [key], order, n - 1, size)
    w = Window.partitionBy(key, "_piece").orderBy("_k")
    last = w.rowsBetween(-(n - 1), 0)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    held = F.sort_array(F.collect_list("_v").over(last))
    own = lambda c: F.sum(F.when(~F.col("_halo"), c)).over(upto)
    out = d.withColumn("median", F.get(held, ((F.size(held) - 1) / 2).cast("int"))).withColumn("mean", F.avg("_v").over(last)).withColumn("most", F.max("_v").over(last))
    out = out.withColumn("_s", F.coalesce(own(F.col("_v")), F.lit(0))).withColumn("_n", F.coalesce(own(F.col("_v").isNotNull().cast("long")), F.lit(0))).where("NOT _halo")
    # one row a piece: their window is `size` times shorter than the key
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = d.where("NOT _halo").groupBy(F.col(key).alias("_key"), F.col("_piece").alias("_part")).agg(F.sum("_v").alias("_s"), F.count("_v").alias("_n"))
    sums = sums.select("_key", "_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"))
    out = out.join(sums, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_piece") == F.col("_part")))
    return out.select(*rows.columns, "median", "mean", "most", ((F.col("_s") + F.col("_s0")) / F.nullif(F.col("_n") + F.col("_n0"), F.lit(0))).alias("global_mean"))


def _run_length(steps: DataFrame, within: Column, name: str) -> DataFrame:
    group = F.sum(F.when(within, 0).otherwise(1)).over(in_order().rowsBetween(Window.unboundedPreceding, 0))
    out = steps.withColumn("_in", within).withColumn("_g", group)
    w = Window.partitionBy("episode", "_g").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn(name, F.sum(F.when(F.col("_in"), 1).otherwise(0)).over(w)).drop("_in", "_g")


def non_forward_run(steps: DataFrame) -> DataFrame:
    """Steps with run: non-forward actions up to here since the last forward."""
    return _run_length(steps, F.col("action") != 1, "run")


def stuck_run(steps: DataFrame, step_m: float = 0.25, warn: int = 4, stop: int = 12) -> DataFrame:
    """Steps with run (moves under half a step in a row) and state: ok, warn or stop."""
    out = _run_length(steps.withColumn("_m", _moved()), F.coalesce(F.col("_m") < step_m / 2, F.lit(False)), "run").drop("_m")
    return out.withColumn("state", F.when(F.col("run") >= stop, "stop").when(F.col("run") >= warn, "warn").otherwise("ok"))


def augment_start(steps: DataFrame, turns: Column, chosen: Column) -> DataFrame:
    """Episodes for which `chosen` holds get |turns| turns in front that lead to the first heading
    (turns > 0 right, < 0 left), and all are renumbered."""
    first = steps.where("step = 0").withColumn("_k", turns).where(chosen & (F.col("_k") != 0))
    j = F.explode(F.sequence(F.lit(1), F.abs("_k"))).alias("_j")
    front = first.select("*", j).withColumn("step", F.col("_j") - F.abs("_k") - 1).withColumn("tick", F.pmod(F.col("tick") - F.signum("_k").cast("int") * (F.abs("_k") - F.col("_j") + 1), F.lit(24)))
    front = front.withColumn("action", F.when(F.col("_k") > 0, 3).otherwise(2)).select(*[F.col(c).cast(steps.schema[c].dataType) for c in steps.columns])
    return front.unionByName(steps).withColumn("step", F.row_number().over(in_order()) - 1)


def dedupe_consecutive(steps: DataFrame) -> DataFrame:
    """Steps without those at the place of the step before."""
    same = F.col("x").eqNullSafe(F.lag("x").over(in_order())) & F.col("y").eqNullSafe(F.lag("y").over(in_order()))
    return steps.withColumn("_same", same & (F.row_number().over(in_order()) > 1)).where("NOT _same").drop("_same")


def expert_label(steps: DataFrame, near: float = 0.05, goal: float = 0.5, tick_deg: float = 15.0) -> DataFrame:
    """Steps with label, the action a heading rule takes towards (tx, ty); stop where goal_distance < goal."""
    dx, dy = F.col("tx") - F.col("x"), F.col("ty") - F.col("y")
    distance = F.sqrt(dx * dx + dy * dy)
    want = F.degrees(F.lit(math.pi / 2) - F.atan2(dy, dx))
    turn = F.pmod(F.round(want - F.col("tick") * tick_deg, 6) + 180.0, F.lit(360.0)) - 180.0
    label = F.when(F.col("goal_distance") < goal, 0).when((F.round(distance, 6) < near) | (F.round(F.abs(turn), 6) <= 0.8 * tick_deg), 1).when(turn > 0, 3).otherwise(2)
    return steps.withColumn("label", label)


def break_loop(steps: DataFrame, run: int = 12) -> DataFrame:
    """Steps whose action, after `run` non-forward actions, repeats the turn before: made forward."""
    out = non_forward_run(steps)
    again = (F.col("run") >= run) & F.col("action").isin(2, 3) & (F.col("action") == F.lag("action").over(in_order()))
    return out.withColumn("action", F.when(again, 1).otherwise(F.col("action"))).drop("run")


def waypoint_progress(steps: DataFrame, path: DataFrame, reach: float = 0.25) -> DataFrame:
    """Steps with waypoint: the index on the episode's path (i, px, py), advanced while within reach."""

    def walk(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("step"), b.sort_values("i")
        px, py, at, out = b["px"].to_numpy(), b["py"].to_numpy(), 0, []
        for x, y in zip(a["x"], a["y"]):
            while at < len(px) and math.hypot(px[at] - x, py[at] - y) <= reach:
                at += 1
            out.append(min(at, max(0, len(px) - 1)))
        return a.assign(waypoint=np.array(out, "int64"))

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in steps.schema) + ", waypoint long"
    return steps.groupBy("episode").cogroup(path.groupBy("episode")).applyInPandas(walk, kind)


def forward_match(steps: DataFrame, path: DataFrame, ahead: int = 15) -> DataFrame:
    """Steps with matched: the nearest path index within the next `ahead`, never moving back."""

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("step"), b.sort_values("i")
        px, py, at, out = b["px"].to_numpy(), b["py"].to_numpy(), 0, []
        for x, y in zip(a["x"], a["y"]):
            if len(px):
                d = np.hypot(px[at : at + ahead + 1] - x, py[at : at + ahead + 1] - y)
                at += int(d.argmin())
            out.append(at)
        return a.assign(matched=np.array(out, "int64"))

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in steps.schema) + ", matched long"
    return steps.groupBy("episode").cogroup(path.groupBy("episode")).applyInPandas(match, kind)


def next_subgoal(path: DataFrame, far: float) -> DataFrame:
    """For each step the first later step at distance >= far, else the episode's last."""
    later = path.select(F.col("episode").alias("e"), F.col("step").alias("s2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    hit = (F.round(F.sqrt(dx * dx + dy * dy), 6) >= far) & (F.col("s2") > F.col("step"))
    found = path.join(later, F.col("episode") == F.col("e")).groupBy("episode", "step").agg(F.min(F.when(hit, F.col("s2"))).alias("hit"), F.max("s2").alias("end"))
    return found.select("episode", "step", F.coalesce("hit", "end").alias("subgoal"))


def relabel(steps: DataFrame, far: float = 1.0, ahead: int = 15, goal: float = 0.5) -> DataFrame:
    """Path following: match each step to its episode's path, take the sub-goal after the match, label."""
    path = steps.select("episode", F.col("step").alias("i"), F.col("x").alias("px"), F.col("y").alias("py"))
    matched = forward_match(steps, path, ahead)
    target = next_subgoal(steps, far).select("episode", F.col("step").alias("matched"), "subgoal")
    place = path.select("episode", F.col("i").alias("subgoal"), F.col("px").alias("tx"), F.col("py").alias("ty"))
    end = Window.partitionBy("episode")
    gx, gy = F.max_by("x", "step").over(end) - F.col("x"), F.max_by("y", "step").over(end) - F.col("y")
    return expert_label(matched.withColumn("goal_distance", F.sqrt(gx * gx + gy * gy)).join(target, ["episode", "matched"]).join(place, ["episode", "subgoal"]), goal=goal)


def nav_metrics(steps: DataFrame, goals: DataFrame, radius: float = 3.0) -> DataFrame:
    """Per episode: steps_taken, path_length, final and oracle navigation error, success, oracle
    success (strictly within the radius), spl and oracle_spl. goals: episode, goal_x, goal_y, shortest."""
    d = steps.join(goals, "episode")
    gx, gy = F.col("x") - F.col("goal_x"), F.col("y") - F.col("goal_y")
    d = d.withColumn("d", F.round(F.sqrt(gx * gx + gy * gy), 6)).withColumn("leg", F.coalesce(_moved(), F.lit(0.0)))
    d = d.withColumn("so_far", F.sum("leg").over(in_order().rowsBetween(Window.unboundedPreceding, 0)))
    spl = F.when(F.col("d") < radius, F.col("shortest") / F.greatest("shortest", "so_far", F.lit(1e-9))).otherwise(0.0)
    out = d.withColumn("s", spl).groupBy("episode").agg(
        F.count("*").alias("steps_taken"), F.round(F.sum("leg"), 6).alias("path_length"), F.max_by("d", "step").alias("navigation_error"), F.min("d").alias("oracle_error"),
        F.bool_or(F.col("d") < radius).cast("int").alias("oracle_success"), F.round(F.max_by("s", "step"), 6).alias("spl"), F.round(F.max("s"), 6).alias("oracle_spl"),
    )
    return out.withColumn("success", (F.col("navigation_error") < radius).cast("int"))


def path_length_with_legs(path: DataFrame, start: tuple[str, str], goal: tuple[str, str]) -> DataFrame:
    """episode, length: the smoothed path's length with the legs from start and to goal; a path of
    fewer than two points is the straight line."""
    dx, dy = F.col("x") - F.lag("x").over(in_order()), F.col("y") - F.lag("y").over(in_order())
    legs = path.withColumn("leg", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)))
    h = lambda ax, ay, bx, by: F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))
    s, g = (F.first(F.struct(*[F.col(c) for c in p])) for p in (start, goal))
    a = legs.groupBy("episode").agg(F.count("*").alias("n"), F.sum("leg").alias("inner"), F.min_by(F.struct("x", "y"), "step").alias("a"), F.max_by(F.struct("x", "y"), "step").alias("b"), s.alias("s"), g.alias("g"))
    straight = h(F.col("s")[start[0]], F.col("s")[start[1]], F.col("g")[goal[0]], F.col("g")[goal[1]])
    whole = F.col("inner") + h(F.col("s")[start[0]], F.col("s")[start[1]], F.col("a.x"), F.col("a.y")) + h(F.col("b.x"), F.col("b.y"), F.col("g")[goal[0]], F.col("g")[goal[1]])
    return a.select("episode", F.when(F.col("n") < 2, straight).otherwise(whole).alias("length"))


def ndtw(paths: DataFrame, truth: DataFrame, radius: float = 3.0) -> DataFrame:
    """episode, ndtw: exp(-dtw / (len(truth) * radius)), repeats of a place in a row removed first.
    An episode without truth has 0. Many episodes run at once; one is a numpy table."""

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        e = (a if len(a) else b)["episode"].iloc[0]
        if not len(a) or not len(b):
            return pd.DataFrame({"episode": [e], "ndtw": [0.0]}) if len(a) else pd.DataFrame({"episode": [], "ndtw": []})
        p, q = (d.sort_values("step")[["x", "y"]].to_numpy() for d in (a, b))
        keep = np.append(True, (p[1:] != p[:-1]).any(1))
        p = p[keep]
        cost = np.hypot(p[:, None, 0] - q[None, :, 0], p[:, None, 1] - q[None, :, 1])
        row = np.cumsum(cost[0])
        for i in range(1, len(p)):
            new = np.empty_like(row)
            new[0] = row[0] + cost[i, 0]
            both = np.minimum(row[1:], row[:-1])
            for j in range(1, len(q)):
                new[j] = cost[i, j] + min(both[j - 1], new[j - 1])
            row = new
        return pd.DataFrame({"episode": [e], "ndtw": [float(np.exp(-row[-1] / (len(q) * radius)))]})

    return paths.select("episode", "step", "x", "y").groupBy("episode").cogroup(truth.select("episode", "step", "x", "y").groupBy("episode")).applyInPandas(one, "episode long, ndtw double")


def nav_summary(evals: DataFrame) -> DataFrame:
    """One row: mean success, spl, oracle success, error and nDTW (0 on empty) and the row count."""
    cols = [c for c in ("success", "spl", "os", "ne", "ndtw") if c in evals.columns]
    return evals.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in cols], F.count("*").alias("n"))
