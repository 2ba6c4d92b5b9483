"""Path analytics over poses (path_id, i, x, y)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfarer.operators import footprint, grid


def measured(poses: DataFrame, *others: str) -> DataFrame:
    """Adds segment length, distance from the start, heading (0 for the first pose) and curvature (0 at ends and on short segments). others: columns that stay."""
    w = Window.partitionBy("path_id").orderBy("i")
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    ex, ey = F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y")
    steps = poses.select("path_id", "i", "x", "y", *others, dx.alias("dx"), dy.alias("dy"), ex.alias("ex"), ey.alias("ey"))
    steps = steps.withColumn("segment", F.coalesce(F.hypot("dx", "dy"), F.lit(0.0))).withColumn("next", F.hypot("ex", "ey"))
    bend = 2 * F.abs(F.col("dx") * F.col("ey") - F.col("dy") * F.col("ex")) / (F.col("segment") * F.col("next")) / ((F.col("segment") + F.col("next")) / 2)
    bent = F.when((F.col("segment") > 1e-6) & (F.col("next") > 1e-6), bend).otherwise(0.0)
    return steps.select(
        "path_id", "i", "x", "y", *others, "segment", F.sum("segment").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("distance"),
        F.coalesce(F.atan2("dy", "dx"), F.lit(0.0)).alias("heading"), bent.alias("curvature"),
    )


def summary(poses: DataFrame, horizon: float = 3.0) -> DataFrame:
    return measured(poses).groupBy("path_id").agg(F.count("*").alias("n_poses"), F.sum("segment").alias("length"), F.coalesce(F.max(F.when(F.col("distance") <= horizon, F.col("curvature"))), F.lit(0.0)).alias("r_curve"))


def analyzed(poses: DataFrame, cells: DataFrame, poly: Column, resolution: float, size: int) -> DataFrame:
    """Per pose (path_id, grid_id, i, x, y) its heading, footprint cost and distance to the nearest obstacle (+inf off the map).

    Costs come from the tiles that a pose's footprint crosses and the distance from its own cell, so that no row holds a grid.
    """
    far = grid.distances(cells.withColumn("occupied", grid.is_obstacle(F.col("cost"))), resolution).withColumnRenamed("distance", "obstacle")
    found = measured(poses, "grid_id")
    costs = footprint.costs(found.select(F.struct("path_id", "i").alias("id"), "grid_id", "x", "y", F.col("heading").alias("yaw")), cells, poly, resolution, size)
    at = found.withColumns({k: F.floor(F.col(c) / resolution).cast("int") for k, c in (("col", "x"), ("row", "y"))}).join(far, ["grid_id", "row", "col"], "left")
    both = at.join(costs.select("id.path_id", "id.i", F.col("cost").alias("footprint_cost")), ["path_id", "i"])
    return both.select("path_id", "i", "segment", "heading", "footprint_cost", F.coalesce("obstacle", F.lit(float("inf"))).alias("obstacle"))
