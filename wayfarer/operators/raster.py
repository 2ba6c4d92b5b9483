"""Costmaps as square tiles, and footprint costs that look at the tiles which a footprint's edges cross.

A map has any width, height, origin and resolution, and is held a tile a row. A tile of one cost, as free and unknown space
mostly is, needs no array: its greatest cost answers for all its cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfarer.functions import geometry
from wayfarer.operators.grid import LETHAL, cell_of, spread

#: Cells of a tile's side, as a power of two.
SIDE = 6
ABOVE_ALL = 256  # stands for LETHAL where the greatest cost is sought
_LOW = 31


def _right(x: Column, bits: int) -> Column:
    return F.call_function("shiftright", x, F.lit(bits))


def _pair(row: Column, col: Column) -> Column:
    """Row and column as one number."""
    return F.call_function("shiftleft", row.cast("long"), F.lit(_LOW)).bitwiseOR(col.cast("long"))


def _row(k: Column) -> Column:
    return _right(k, _LOW).cast("int")


def _col(k: Column) -> Column:
    return k.bitwiseAND(F.lit((1 << _LOW) - 1)).cast("int")


def tiles(cells: DataFrame, side: int = SIDE) -> DataFrame:
    """grid_id, tile, th and tw (the tile's height and width at the map's border), most, and costs by row and column, null in tiles of one cost.

    cells: grid_id, row, col, cost, from row and column 0 on; cells that aren't there cost 0.
    """
    last = (1 << side) - 1
    r, c = F.col("row").bitwiseAND(F.lit(last)), F.col("col").bitwiseAND(F.lit(last))
    tile = _pair(_right(F.col("row"), side), _right(F.col("col"), side))
    found = cells.where((F.col("row") >= 0) & (F.col("col") >= 0)).groupBy("grid_id", tile.alias("tile"))
    whole = found.agg((F.max(r) + 1).alias("th"), (F.max(c) + 1).alias("tw"), F.min("cost").alias("least"), F.max("cost").alias("most"), F.array_sort(F.collect_list(F.struct(r.alias("r"), c.alias("c"), "cost"))).alias("cells"))
    full = F.size("cells") == F.col("th") * F.col("tw")
    known = F.map_from_entries(F.transform("cells", lambda x: F.struct((x["r"] * F.col("tw") + x["c"]).alias("k"), x["cost"].alias("cost"))))
    gaps = F.transform(F.sequence(F.lit(0), F.col("th") * F.col("tw") - 1), lambda k: F.coalesce(F.try_element_at(known, k), F.lit(0)))
    costs = F.when(full & (F.col("least") == F.col("most")), None).when(full, F.transform("cells", lambda x: x["cost"])).otherwise(gaps)
    return whole.select("grid_id", "tile", "th", "tw", "most", costs.alias("costs"))


def crossed(a: Column, b: Column, step: float) -> Column:
    """The cells met walking from cell a to cell b, a sample every step from the start, truncated; each once, as numbers."""
    dx, dy = (b["x"] - a["x"]).cast("double"), (b["y"] - a["y"]).cast("double")

    def walked(m: Column) -> Column:
        def at(t: Column) -> Column:
            col, row = (F.when(m["far"] == 0, m[k]).otherwise((m[k] + t * step * m[f"u{k}"]).cast("int")) for k in "xy")
            return _pair(row, col)

        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.floor(m["far"] / step).cast("int")), at))

    # arrays of one bind the line's length and direction, so that they aren't computed for each sample
    far = F.sqrt(dx * dx + dy * dy)
    lines = F.transform(F.array(far), lambda f: F.struct(f.alias("far"), a["x"].alias("x"), a["y"].alias("y"), (dx / F.greatest(f, F.lit(1e-9))).alias("ux"), (dy / F.greatest(f, F.lit(1e-9))).alias("uy")))
    return F.get(F.transform(lines, walked), F.lit(0))


def footprint_costs(poses: DataFrame, maps: DataFrame, tiled: DataFrame, poly: Column, step: float = 0.1, side: int = SIDE) -> DataFrame:
    """id and cost of the footprint at each pose (id, grid_id, x, y, yaw); a vertex off the map, or a pose without a map, is lethal.

    maps: grid_id, width, height, origin_x, origin_y, resolution; tiled: tiles. A pose meets the tiles its edges cross, one to
    four for most footprints. Edges are taken in order: the cost so far ends the walk where it is exactly
    lethal, so an unknown cell met before a lethal one outweighs it and one met behind doesn't count.
    """
    # arrays of one, exploded, keep the optimizer from computing polygon and cells anew wherever they are used
    on = poses.select("id", "grid_id", "x", "y", "yaw").join(maps, "grid_id", "left")
    on = spread(on).withColumn("p", F.explode(F.array(geometry.placed(poly, F.col("x"), F.col("y"), F.col("yaw")))))
    cell = {k: (lambda v, k=k: cell_of(v[k], F.col(f"origin_{k}"), F.col("resolution"))) for k in "xy"}
    inside = F.forall("p", lambda v: (v["x"] >= F.col("origin_x")) & (v["y"] >= F.col("origin_y")) & (cell["x"](v) < F.col("width")) & (cell["y"](v) < F.col("height")))
    corners = F.transform("p", lambda v: geometry.point(cell["x"](v), cell["y"](v)))
    on = on.select("id", "grid_id", F.coalesce(inside, F.lit(False)).alias("inside"), F.explode(F.array(corners)).alias("p"))
    met = F.flatten(F.transform(geometry.edges(F.col("p")), lambda e, i: F.transform(crossed(e["a"], e["b"], step), lambda k: F.struct(i.alias("edge"), k.alias("cell")))))
    on = on.select("id", "grid_id", "inside", F.size("p").alias("n"), F.explode(F.array(F.when(F.col("inside"), met))).alias("met"))
    tile_of = lambda v: _pair(_right(_row(v["cell"]), side), _right(_col(v["cell"]), side))
    each = on.withColumn("tile", F.explode_outer(F.array_distinct(F.transform("met", tile_of)))).withColumn("met", F.filter("met", lambda v: tile_of(v) == F.col("tile")))
    seen = each.join(tiled, ["grid_id", "tile"], "left")
    last = (1 << side) - 1

    def cost(v: Column) -> Column:
        r, c = _row(v["cell"]).bitwiseAND(F.lit(last)), _col(v["cell"]).bitwiseAND(F.lit(last))
        found = F.when((r < F.col("th")) & (c < F.col("tw")), F.when(F.col("costs").isNull(), F.col("most")).otherwise(F.get("costs", r * F.col("tw") + c)))
        return F.when(found == LETHAL, ABOVE_ALL).otherwise(F.coalesce(found, F.lit(0)))

    known = F.transform("met", lambda v: F.struct(v["edge"].alias("edge"), cost(v).alias("cost")))
    edges = lambda of: F.transform(F.sequence(F.lit(0), F.col("n") - 1), of)
    own = seen.select("id", "inside", "n", F.explode(F.array(known)).alias("k")).select("id", "inside", "n", edges(lambda e: F.array_max(F.transform(F.filter("k", lambda v: v["edge"] == e), lambda v: v["cost"]))).alias("best"))
    whole = own.groupBy("id").agg(F.first("inside").alias("inside"), F.first("n").alias("n"), F.collect_list("best").alias("all"))
    lines = edges(lambda e: F.array_max(F.transform("all", lambda b: F.get(b, e))))
    folded = F.aggregate(lines, F.lit(0), lambda acc, c: F.when(acc == LETHAL, acc).otherwise(F.greatest(acc, F.when(c == ABOVE_ALL, LETHAL).otherwise(F.coalesce(c, F.lit(0))))))
    return whole.select("id", F.when(F.col("inside"), folded).otherwise(LETHAL).alias("cost"))
