"""Polygon expressions over arrays of struct<x: double, y: double>."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The footprints of the robot's poses.
TUCKED = [(0.30, 0.0), (0.21, 0.21), (0.0, 0.30), (-0.21, 0.21), (-0.30, 0.0), (-0.21, -0.21), (0.0, -0.30), (0.21, -0.21)]
CARRY = [(-0.275, 0.000), (-0.238, -0.138), (0.070, -0.476), (0.230, -0.641), (0.420, -0.698), (0.480, -0.698), (0.510, -0.646), (0.238, 0.138), (0.138, 0.238), (0.000, 0.275), (-0.138, 0.238), (-0.238, 0.138)]
EXTENDED = [(0.3, 0.3), (-0.3, 0.3), (-0.3, -0.1), (-0.15, -0.1), (-0.15, -1.3), (0.15, -1.3), (0.15, -0.1), (0.3, -0.1), (0.3, -0.3)]


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def polygon(points: list[tuple[float, float]]) -> Column:
    return F.array(*(point(F.lit(float(x)), F.lit(float(y))) for x, y in points))


def circle(radius: Column, n: int, x: float = 0.0, y: float = 0.0) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: point(x + radius * F.cos(k * (2 * math.pi / n)), y + radius * F.sin(k * (2 * math.pi / n))))


def rectangle(length: Column, width: Column, x: float = 0.0, y: float = 0.0) -> Column:
    corners = ((1, 1), (-1, 1), (-1, -1), (1, -1))
    return F.array(*(point(x + i * length / 2, y + j * width / 2) for i, j in corners))


def edges(poly: Column) -> Column:
    """Each vertex a with the next one b; the last edge closes the polygon."""
    return F.transform(poly, lambda p, i: F.struct(p.alias("a"), F.element_at(poly, F.when(i + 1 == F.size(poly), 1).otherwise(i + 2)).alias("b")))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def signed_area(poly: Column) -> Column:
    return _total(F.transform(edges(poly), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def centroid(poly: Column) -> Column:
    area = signed_area(poly)

    def along(k: str) -> Column:
        moment = _total(F.transform(edges(poly), lambda e: (e["a"][k] + e["b"][k]) * (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])))
        return F.when(F.abs(area) < 1e-10, _total(F.transform(poly, lambda p: p[k])) / F.size(poly)).otherwise(moment / (6 * area))

    return point(along("x"), along("y"))


def to_segment(px: Column, py: Column, a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    size = dx * dx + dy * dy
    t = F.when(size < 1e-10, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - a["x"]) * dx + (py - a["y"]) * dy) / F.greatest(size, F.lit(1e-300)))))
    return F.hypot(px - (a["x"] + t * dx), py - (a["y"] + t * dy))


def inscribed(poly: Column, at: Column) -> Column:
    return F.array_min(F.transform(edges(poly), lambda e: to_segment(at["x"], at["y"], e["a"], e["b"])))


def circumscribed(poly: Column, at: Column) -> Column:
    return F.array_max(F.transform(poly, lambda p: F.hypot(p["x"] - at["x"], p["y"] - at["y"])))


def placed(poly: Column, x: Column, y: Column, yaw: Column) -> Column:
    return F.transform(poly, lambda p: point(x + p["x"] * F.cos(yaw) - p["y"] * F.sin(yaw), y + p["x"] * F.sin(yaw) + p["y"] * F.cos(yaw)))


def surface(poly: Column, at: Column, angle: Column, fallback: Column) -> Column:
    """Distance from at to the outline along a ray; the fallback where the ray meets no edge."""
    c, s = F.cos(angle), F.sin(angle)

    def hit(e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        det = dx * s - dy * c
        ax, ay = e["a"]["x"] - at["x"], e["a"]["y"] - at["y"]
        t, u = (dx * ay - dy * ax), (c * ay - s * ax)
        return F.when((F.abs(det) > 1e-10) & (t / det >= 0) & (u / det >= 0) & (u / det <= 1), t / det)

    return F.coalesce(F.array_min(F.transform(edges(poly), hit)), fallback)


def drop_collinear(poly: Column, tolerance: float = 1e-3) -> Column:
    n = F.size(poly)

    def bends(p: Column, i: Column) -> Column:
        a, c = F.element_at(poly, F.when(i == 0, n).otherwise(i)), F.element_at(poly, F.when(i + 1 == n, 1).otherwise(i + 2))
        return F.abs((p["x"] - a["x"]) * (c["y"] - a["y"]) - (p["y"] - a["y"]) * (c["x"] - a["x"])) > tolerance

    return F.filter(poly, bends)
