"""Laser-scan features, in array expressions: a scan never leaves its row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECTORS, NEAR, HALF_FIELD = 36, 3.0, math.pi / 3


def with_beams(scans: DataFrame) -> DataFrame:
    """Adds beams (r, a, valid) from ranges, angle_min, angle_increment, range_min and range_max.

    An array of one, exploded, keeps the optimizer from computing the beams anew for each feature.
    """
    return scans.select("*", F.explode(F.array(F.transform("ranges", lambda r, i: F.struct(r.alias("r"), (F.col("angle_min") + i * F.col("angle_increment")).alias("a"), (~F.isnan(r) & (r > F.col("range_min")) & (r < F.col("range_max"))).alias("valid"))))).alias("beams"))


def least(of: Column) -> Column:
    return F.array_min(F.transform(of, lambda b: b["r"]))


def r_min() -> Column:
    return F.coalesce(least(F.filter("beams", lambda b: b["valid"])), F.lit(10.0))


def ahead() -> Column:
    """The least valid range within the field ahead, null without one."""
    return least(F.filter("beams", lambda b: b["valid"] & (F.abs(b["a"]) < HALF_FIELD)))


def r_ttc(v: Column, near: Column | None = None) -> Column:
    """Time to what is ahead: near, or of the row's beams."""
    near = ahead() if near is None else near
    return F.when((F.abs(v) < 0.01) | (v < 0) | near.isNull(), 100.0).otherwise(F.least(near / v, F.lit(100.0)))


def r_vis() -> Column:
    ahead = F.filter("beams", lambda b: F.abs(b["a"]) < HALF_FIELD)
    hidden = F.filter(ahead, lambda b: F.isnan(b["r"]) | (b["r"] == float("inf")) | (b["r"] >= 0.99 * F.col("range_max")) | (b["r"] <= F.col("range_min")))
    return F.when(F.size(ahead) == 0, 0.0).otherwise(F.size(hidden) / F.greatest(F.size(ahead), F.lit(1)))


def r_width() -> Column:
    def side(middle: float) -> Column:
        return least(F.filter("beams", lambda b: b["valid"] & (F.abs(b["a"] - middle) < math.pi / 6)))

    left, right = side(math.pi / 2), side(-math.pi / 2)
    return F.coalesce(left + right, 2 * left, 2 * right, F.lit(10.0))


def longest_circular(blocked: Column, n: int) -> Column:
    """Longest run of false in a ring of n."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        now = F.when(x, F.lit(0)).otherwise(s["now"] + 1)
        return F.struct(now.alias("now"), F.greatest(s["best"], now).alias("best"))

    return F.least(F.aggregate(F.concat(blocked, blocked), start, step, lambda s: s["best"]), F.lit(n))


def r_clear() -> Column:
    """Widest free stretch of the ring of sectors, which are the bits of one number, so the beams are walked through once."""
    near = F.filter("beams", lambda b: b["valid"] & (b["r"] < NEAR))
    sector = lambda b: F.floor((b["a"] + math.pi) / (2 * math.pi / SECTORS)).cast("int") % SECTORS
    bits = F.aggregate(near, F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), sector(b))))

    def free(m: Column) -> Column:
        blocked = F.transform(F.sequence(F.lit(0), F.lit(SECTORS - 1)), lambda k: F.call_function("shiftright", m, k).bitwiseAND(F.lit(1).cast("long")) == 1)
        return longest_circular(blocked, SECTORS)

    # an array of one binds the number, so that it isn't computed for each sector
    return F.get(F.transform(F.array(bits), free), F.lit(0)) * (2 * math.pi / SECTORS)


def base_distance(offset: float = 0.202) -> Column:
    return F.array_min(F.transform(F.filter("beams", lambda b: b["valid"]), lambda b: F.hypot(b["r"] * F.cos(b["a"]) + offset, b["r"] * F.sin(b["a"]))))


def in_band() -> Column:
    """Beams that a clearance counts."""
    return F.filter("beams", lambda b: ~F.isnan(b["r"]) & (b["r"] > 0.01) & (b["r"] < 30.0))


def clearance(surfaces: Column, fallback: Column) -> Column:
    """Least distance between a beam's end and the robot's outline, with its angle and beam (the first of equals)."""
    good = in_band()
    turn = 2 * math.pi
    each = F.transform(good, lambda b: F.struct((b["r"] - F.coalesce(F.get(surfaces, (F.pmod(b["a"], F.lit(turn)) / turn * 360).cast("int") % 360), fallback)).alias("c"), b["a"].alias("a")))
    return F.coalesce(F.array_min(each), F.struct(F.lit(float("inf")).alias("c"), F.lit(0.0).alias("a")))


def near_returns(limit: float = 0.15) -> Column:
    found = F.transform("beams", lambda b, i: F.struct(i.alias("beam"), b["r"].alias("r"), b["a"].alias("a")))
    return F.slice(F.filter(found, lambda b: (b["r"] > F.col("range_min")) & (b["r"] < limit)), 1, 20)
