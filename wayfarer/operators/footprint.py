"""Footprint costs on grids, and robot outlines measured from parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfarer.functions import geometry
from wayfarer.operators import raster
from wayfarer.operators.design import hull


def costs(poses: DataFrame, cells: DataFrame, poly: Column, resolution: float, size: int, step: float = 0.1) -> DataFrame:
    """id and cost of the footprint at each pose (id, grid_id, x, y, yaw) on square grids from the origin on, given by their cells."""
    maps = cells.select("grid_id").distinct().select("grid_id", *(F.lit(size).alias(k) for k in ("width", "height")), *(F.lit(0.0).alias(f"origin_{k}") for k in "xy"), F.lit(resolution).alias("resolution"))
    return raster.footprint_costs(poses, maps, raster.tiles(cells), poly, step)


def densified(a: Column, b: Column, step: float = 0.04) -> Column:
    """Points from a to b at equal distances, of about step."""
    n = F.greatest(F.lit(1), F.floor(F.hypot(b["x"] - a["x"], b["y"] - a["y"]) / step).cast("int"))
    return F.transform(F.sequence(F.lit(0), n), lambda k: geometry.point(a["x"] + (b["x"] - a["x"]) * k / n, a["y"] + (b["y"] - a["y"]) * k / n))


def outline_points(joints: DataFrame, base: float, link: float, n: int = 6, ends: bool = False) -> DataFrame:
    """(robot, x, y): the base's outline and circles around points along the joint chain, which goes outwards from the robot's origin.

    ends: circles around the joints only, which have the same hull: what lies between two circles of a size is
    within the hull of both.
    """
    origin = F.array(F.struct(F.lit(0.0).alias("r"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))
    n_tasks = int(joints.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but many points: robots go to all tasks
    chain = joints.repartition(n_tasks, "robot").groupBy("robot").agg(F.array_sort(F.concat(origin, F.collect_list(F.struct(F.hypot("x", "y").alias("r"), "x", "y")))).alias("c"))
    steps = chain.select("robot", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("c") - 1, F.lit(1))), lambda k: F.struct(F.element_at("c", k).alias("a"), F.coalesce(F.try_element_at("c", k + 1), F.element_at("c", k)).alias("b")))).alias("s"))
    along = F.array("s.a", "s.b") if ends else densified(F.col("s.a"), F.col("s.b"))
    around = steps.select("robot", F.explode(along).alias("p")).select("robot", F.explode(F.transform(geometry.circle(F.lit(link), n), lambda v: geometry.point(v["x"] + F.col("p.x"), v["y"] + F.col("p.y")))).alias("v"))
    body = chain.select("robot", F.explode(geometry.circle(F.lit(base), 12)).alias("v"))
    return around.union(body).select("robot", "v.x", "v.y")


def measured(joints: DataFrame, base: float, link: float) -> DataFrame:
    """Per robot the pruned hull of its outline points, with the radii about its origin."""
    ring = hull(outline_points(joints, base, link, ends=True), "robot").groupBy("robot").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("r"))
    poly = ring.select("robot", geometry.drop_collinear(F.transform("r", lambda p: geometry.point(p["x"], p["y"]))).alias("poly"))
    at = geometry.point(F.lit(0.0), F.lit(0.0))
    return poly.select("robot", "poly", geometry.inscribed(F.col("poly"), at).alias("inscribed"), geometry.circumscribed(F.col("poly"), at).alias("circumscribed"))


def collision_threshold(inner: Column) -> Column:
    return F.coalesce(inner + 0.05, F.lit(0.15))
