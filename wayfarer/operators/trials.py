"""Trial records: what was applied, how it ended and what failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfarer.functions.scalars import matches, wrap


def targets(params: DataFrame) -> DataFrame:
    """One row for each target of a parameter: its own and the extra ones; a footprint label becomes its preset."""
    every = F.concat(F.array(F.struct("ros_node", "name")), F.coalesce("extra_targets", F.array().cast("array<struct<ros_node:string,name:string>>")))
    value = F.when(F.col("apply_via") == "footprint", F.coalesce(F.try_element_at("presets", "value"), "value")).otherwise(F.col("value"))
    return params.select("trial_id", "param_type", value.alias("target_value"), F.explode(every).alias("t")).select("trial_id", "param_type", "target_value", "t.ros_node", "t.name")


def unverified(applied: DataFrame) -> DataFrame:
    """Per trial the parameters that didn't read back: count, names and config_valid. applied: param_type, target_value, got, name, ros_node."""
    failed = F.when(~matches(F.col("param_type"), F.col("target_value"), F.col("got")), F.concat_ws("/", "ros_node", "name"))
    lists = applied.groupBy("trial_id").agg(F.array_sort(F.collect_list(failed)).alias("f"))
    return lists.select("trial_id", F.size("f").cast("long").alias("params_unverified_count"), F.array_join("f", ";").alias("params_unverified"), (F.size("f") == 0).cast("int").alias("config_valid"))


def footprint_of(label: Column, presets: Column, fallback: Column) -> Column:
    """The preset's polygon, or the polygon the label spells, or the fallback."""
    spelled = F.coalesce(F.try_element_at(presets, label), label)
    parsed = F.from_json(spelled, "array<array<double>>")
    good = F.size(parsed) >= 3
    return F.when(good, F.transform(parsed, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))).otherwise(fallback)


def moves(trials: DataFrame, key: str, order: str, label: str, ok: str) -> DataFrame:
    """The trials with move: if the arm must move, as the label isn't the one it holds; a failed move leaves none.

    While labels stay the same the first that succeeds ends the moving, and with it every later one of the
    run is idle; so windows over the runs of equal labels tell it, and nothing is carried row by row. A null
    label moves off a held one.
    """
    w = Window.partitionBy(key).orderBy(order)
    fresh = ~F.col(label).eqNullSafe(F.lag(label).over(w)) | F.lag(order).over(w).isNull()
    runs = trials.withColumn("_run", F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy(key, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.bool_or(F.col(ok)).over(before), F.lit(False))
    runs = runs.withColumn("_held", held).withColumn("_holds", F.col(label).isNotNull() & (F.col("_held") | F.col(ok)))
    off = F.coalesce(F.lag("_holds").over(w), F.lit(False))
    return runs.withColumn("move", F.when(F.col(label).isNull(), off).otherwise(~F.col("_held"))).drop("_run", "_held", "_holds")


def terminated(ticks: DataFrame, key: str, order: list[str], elapsed: Column, xy_error: Column, yaw_error: Column, collided: Column, timeout: float = 150.0, xy_tolerance: float = 0.25, yaw_tolerance: float = 0.25, least: float = 2.0) -> DataFrame:
    """Per key the tick that ends the trial (columns of order), why, and the time elapsed then; keys that no tick ends are left out.

    In one tick the goal tolerance (both errors, not before `least`) goes before a collision and that before the timeout.
    """
    there = (elapsed >= least) & (xy_error <= xy_tolerance) & (F.abs(wrap(yaw_error)) <= yaw_tolerance)
    reason = F.when(there, "SUCCESS").when(collided, "COLLISION").when(elapsed > timeout, "TIMEOUT")
    ends = ticks.select(key, F.struct(*order).alias("at"), elapsed.alias("elapsed"), reason.alias("reason")).where("reason is not null")
    return ends.groupBy(key).agg(F.min_by(F.struct("at", "reason", "elapsed"), "at").alias("e")).select(key, "e.at.*", "e.reason", "e.elapsed")


def terminal_errors(ends: DataFrame, goals: DataFrame, key: str) -> DataFrame:
    """Per key of both how far its last pose (x, y, yaw) is from its goal's, and how far it is turned from it."""
    goal = goals.select(key, *(F.col(c).alias(f"_{c}") for c in ("x", "y", "yaw")))
    both = ends.join(goal, key)
    return both.select(key, F.hypot(F.col("_x") - F.col("x"), F.col("_y") - F.col("y")).alias("xy_error"), wrap(F.col("_yaw") - F.col("yaw")).alias("yaw_error"))


def outcome(collided: Column, decision: Column, result: Column, known: Column) -> Column:
    """Collision first, then the runner's decision, then the navigator's result, then what is known."""
    return F.when(collided, "COLLISION").otherwise(F.coalesce(decision, result, known, F.lit("UNKNOWN")))


def error_tail(text: Column, n: int = 200) -> Column:
    """The last n characters of what a process wrote; empty for none."""
    return F.coalesce(F.right(text, F.lit(n)), F.lit(""))


def with_failures(done: DataFrame, failed: DataFrame) -> DataFrame:
    """Results and failure rows (trial_id, timestamp, error) in one table, whatever columns either has."""
    return done.unionByName(failed.withColumn("status", F.lit("EXCEPTION")), allowMissingColumns=True)


def newest(trials: DataFrame) -> DataFrame:
    """One row of each trial_id: that of the latest timestamp."""
    best = trials.groupBy("trial_id").agg(F.max_by(F.struct(*trials.columns), "timestamp").alias("r"))
    return best.select("r.*")
