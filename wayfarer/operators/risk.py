"""The risk node's computing cycle: eight features of the latest messages at each tick, within a time budget.

A feature that one message decides is computed once for the message. Density and gradient need a costmap and a pose:
density comes from the corners of the window in a summed-area table, so a tick looks up four cells and its own, whatever
the window holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfarer.operators import grid, merge, path, scan

#: Features in the order in which they are computed, with the tier of the budget in which they are.
TIERS = {"r_min": 0, "r_ttc": 0, "r_vis": 0, "r_dens": 1, "r_width": 1, "r_clear": 1, "r_curve": 2, "r_grad": 2}


def of_scans(scans: DataFrame, key: str) -> DataFrame:
    """What each scan (with beams) decides: key, r_min, ahead, r_vis, r_width and r_clear."""
    return scans.select(key, scan.r_min().alias("r_min"), scan.ahead().alias("ahead"), scan.r_vis().alias("r_vis"), scan.r_width().alias("r_width"), scan.r_clear().alias("r_clear"))


def of_plans(poses: DataFrame, horizon: float = 3.0) -> DataFrame:
    """path_id and r_curve of each plan's poses (path_id, i, x, y); a plan of fewer than three has curvature 0."""
    return path.summary(poses, horizon).select("path_id", "r_curve")


def summed(cells: DataFrame, value: Column) -> DataFrame:
    """cells with the sum of value over all rows and columns up to theirs, as upto."""
    rows, columns = (Window.partitionBy("grid_id", a).orderBy(b).rowsBetween(Window.unboundedPreceding, 0) for a, b in (("row", "col"), ("col", "row")))
    return cells.withColumn("_v", value).withColumn("_v", F.sum("_v").over(rows)).withColumn("upto", F.sum("_v").over(columns)).drop("_v")


def around(places: DataFrame, cells: DataFrame, resolution: float, radius: float) -> DataFrame:
    """grid_id, row, col of places with r_dens, the share of lethal cells in the square about it as far as the grid goes, and r_grad, its gradient; 0 off the grid."""
    reach = int(radius / resolution)
    size = cells.groupBy("grid_id").agg((F.max("row") + 1).alias("_h"), (F.max("col") + 1).alias("_w"))
    lethal = summed(grid.gradient(cells, resolution), grid.is_dense(F.col("cost")).cast("long")).select("grid_id", F.col("row").alias("_row"), F.col("col").alias("_col"), "upto", "gradient")
    low = {k: F.greatest(F.lit(0), F.col(k) - reach) for k in ("row", "col")}
    high = {k: F.least(F.col(n), F.col(k) + reach + 1) for k, n in (("row", "_h"), ("col", "_w"))}
    n = F.greatest(F.lit(0), high["row"] - low["row"]) * F.greatest(F.lit(0), high["col"] - low["col"])
    corners = [F.struct((r - 1).alias("_row"), (c - 1).alias("_col"), F.lit(s).alias("sign"), F.lit(False).alias("own")) for r, c, s in ((high["row"], high["col"], 1), (low["row"], high["col"], -1), (high["row"], low["col"], -1), (low["row"], low["col"], 1))]
    own = F.struct(F.col("row").alias("_row"), F.col("col").alias("_col"), F.lit(0).alias("sign"), F.lit(True).alias("own"))
    looked = places.join(size, "grid_id").select("grid_id", "row", "col", n.alias("n"), F.explode(F.array(*corners, own)).alias("p")).select("grid_id", "row", "col", "n", "p.*")
    met = looked.join(lethal, ["grid_id", "_row", "_col"], "left").groupBy("grid_id", "row", "col")
    share = F.when(F.max("n") > 0, F.coalesce(F.sum(F.col("sign") * F.col("upto")), F.lit(0)) / F.max("n")).otherwise(0.0)
    return met.agg(share.alias("r_dens"), F.coalesce(F.max(F.when(F.col("own"), F.col("gradient"))), F.lit(0.0)).alias("r_grad"))


def states(log: DataFrame, key: str, scans: DataFrame, plans: DataFrame, cells: DataFrame, every: float, budget: float, resolution: float, origin: tuple[float, float], radius: float = 2.0, slab: float | None = None) -> DataFrame:
    """key, t, computed and the eight features at each tick, a multiple of every, from a key's first scan to its last message.

    log: key, t, event_id, topic (scan, odom, pose, costmap, plan), ref (the message's scan, costmap or plan), v, x, y, and
    early and late, the time that a cycle has taken when the second and the third tier are due. scans: of_scans by ref; plans:
    of_plans. Features that the budget leaves out keep their last value, 0 at first. A key is a trial: nothing goes on from one
    to the next. slab: seconds of a key's log that one task takes.
    """
    of = {c: F.when(F.col("topic") == c, F.col("ref")) for c in ("scan", "costmap", "plan")}
    of |= {"v": F.when(F.col("topic") == "odom", F.col("v")), "x": F.when(F.col("topic") == "pose", F.col("x")), "y": F.when(F.col("topic") == "pose", F.col("y")), "early": F.col("early"), "late": F.col("late")}
    ticks = merge.ticked(log, key, "t", "event_id", F.col("topic") == "scan", of, every, slab)
    at = {k: grid.cell_of(F.coalesce(F.col(c), F.lit(0.0)), F.lit(o), F.lit(resolution)) for k, c, o in (("col", "x", origin[0]), ("row", "y", origin[1]))}
    ticks = ticks.withColumns(at)
    near = around(ticks.select(F.col("costmap").alias("grid_id"), "row", "col").where("grid_id is not null").distinct(), cells, resolution, radius)
    seen = ticks.join(scans.withColumnRenamed("ref", "scan"), "scan", "left").join(plans.withColumnRenamed("path_id", "plan"), "plan", "left").join(near.withColumnRenamed("grid_id", "costmap"), ["costmap", "row", "col"], "left")
    values = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in TIERS if c != "r_ttc"} | {"r_ttc": scan.r_ttc(F.coalesce("v", F.lit(0.0)), F.col("ahead"))}
    named = seen.select(key, "t", "early", "late", *(v.alias(f"now_{c}") for c, v in values.items()))
    done = merge.degraded(named, key, ["t"], F.col("early"), F.col("late"), budget, {c: (tier, F.col(f"now_{c}")) for c, tier in TIERS.items()}, None if slab is None else F.floor(F.col("t") / slab))
    return done.select(key, "t", "computed", *TIERS)
