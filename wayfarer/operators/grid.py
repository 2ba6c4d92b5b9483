"""Grid analytics over cells (grid_id, row, col, cost)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfarer.operators import envelope

LETHAL, INSCRIBED, UNKNOWN = 254, 253, 255


def is_obstacle(cost: Column) -> Column:
    """Nearest-obstacle rule: unknown cells count."""
    return cost > INSCRIBED


def is_dense(cost: Column) -> Column:
    return cost == LETHAL


def is_hit(cost: Column) -> Column:
    return cost >= INSCRIBED


def cell_of(x: Column, origin: Column, resolution: Column, guarded: bool = False) -> Column:
    """Cell index, truncated towards zero; guarded: null for what lies before the origin, which would else come to cell 0."""
    at = ((x - origin) / resolution).cast("int")
    return F.when(x >= origin, at) if guarded else at


def numbered(cells: DataFrame) -> DataFrame:
    """Cells with their rank by row and column, from 0. Ranks are taken within a row of the grid; only the rows' counts meet in one task."""
    rows = cells.groupBy("row").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("row").orderBy("col")) - 1
    return cells.withColumn("own", own).join(rows.select("row", before.alias("before")), "row").withColumn("rank", F.col("before") + F.col("own")).drop("before", "own")


def density(cells: DataFrame, row: int, col: int, radius: float, resolution: float) -> DataFrame:
    """Share of lethal cells in the square of int(radius / resolution) cells to each side of (row, col), as far as the grid goes; 0 if none is in it."""
    reach = int(radius / resolution)
    near = (F.abs(F.col("row") - row) <= reach) & (F.abs(F.col("col") - col) <= reach)
    return cells.groupBy("grid_id").agg(F.coalesce(F.avg(F.when(near, is_dense(F.col("cost")).cast("double"))), F.lit(0.0)).alias("density"))


def gradient(cells: DataFrame, resolution: float) -> DataFrame:
    """Central differences, zero on borders, and their magnitude."""
    x, y = Window.partitionBy("grid_id", "row").orderBy("col"), Window.partitionBy("grid_id", "col").orderBy("row")
    gx, gy = ((F.coalesce((F.lead("cost").over(w) - F.lag("cost").over(w)) / 2.0, F.lit(0.0))) for w in (x, y))
    return cells.select("grid_id", "row", "col", "cost", gx.alias("gx"), gy.alias("gy")).withColumn("gradient", F.hypot("gx", "gy") / resolution)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df over all shuffle partitions, for what has few bytes but much work: adaptive execution would put it into few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def distances(cells: DataFrame, resolution: float) -> DataFrame:
    """Distance to the nearest occupied cell of the grid, +inf without one.

    Nearest in each row first, by the last occupied cell in either direction, then over the column, whose distances are
    the lower envelope of parabolas at its cells. Both passes keep to one line of a grid, so no task holds a grid.
    """

    def last(way: Column) -> Column:
        return F.last(F.when(F.col("occupied"), F.col("col")), True).over(Window.partitionBy("grid_id", "row").orderBy(way).rowsBetween(Window.unboundedPreceding, 0))

    in_row = spread(cells.select("grid_id", "row", "col", "occupied"), "grid_id", "row").select("grid_id", "row", "col", F.least(F.col("col") - last(F.asc("col")), last(F.desc("col")) - F.col("col")).cast("int").alias("dx"))
    lines = spread(in_row, "grid_id", "col").groupBy("grid_id", "col").agg(F.array_sort(F.collect_list(F.struct("row", "dx"))).alias("line")).select("grid_id", F.col("col").cast("int").alias("col"), "line.row", "line.dx")
    kind = cells.schema["grid_id"].dataType.simpleString()
    best = lines.mapInArrow(envelope.columns, f"grid_id {kind}, row int, col int, d2 long")
    return best.select("grid_id", "row", "col", F.coalesce(F.sqrt("d2") * resolution, F.lit(float("inf"))).alias("distance"))
