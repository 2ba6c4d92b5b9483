"""Readers, writers, streams, designs and geometry on small inputs."""

import json
import math
import random
import struct
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfarer.functions import geometry, scalars
from wayfarer.operators import design, footprint, grid, kdtree, merge, path, scan, trials
from wayfarer.plans import catalog, views
from wayfarer.sources import readers, sinks
from wayfarer.streaming import latest

SF = "/root/testdata/sf0.001"
QUICK = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# scalars


@pytest.mark.parametrize(
    "kind, target, got, want",
    [
        ("continuous", "0.5", "0.504", True), ("continuous", "0.5", "0.506", False), ("continuous", "0.5", "oops", False), ("continuous", "0.5", None, False),
        ("discrete", "30", "30.9", True), ("discrete", "30", "31", False), ("boolean", "True", " true ", True), ("categorical", "a", " a ", True), ("categorical", "a", "A", False),
        ("footprint", "[[0,0],[1,0],[0,1]]", "[[0,0],[1,0.0005],[0,1]]", True), ("footprint", "[[0,0],[1,0],[0,1]]", "[[0,0],[1,0]]", False), ("footprint", "[[0,0]]", "x", False),
    ],
)
def test_read_back(spark, kind, target, got, want):
    assert one(spark, scalars.matches(F.lit(kind), F.lit(target), F.lit(got).cast("string")))[0] is want


def test_truthy_wrap_and_uniform(spark):
    assert tuple(one(spark, *(scalars.truthy(F.lit(x)) for x in ("Yes ", "0", "on")))) == (True, False, True)
    assert one(spark, scalars.wrap(F.lit(3 * math.pi / 2)))[0] == pytest.approx(-math.pi / 2)
    u = np.array([r[0] for r in spark.range(4000).select(scalars.uniform(F.lit(1), F.col("id"))).collect()])
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.02
    again = {r[0]: r[1] for r in spark.range(4000).repartition(7).select("id", scalars.uniform(F.lit(1), F.col("id"))).collect()}
    assert all(again[k] == x for k, x in enumerate(u))


# geometry


def test_collinear_points_go_and_radii_hold(spark):
    square = geometry.polygon([(0, 0), (1, 0), (2, 0), (2, 2), (0, 2)])
    assert one(spark, F.size(geometry.drop_collinear(square)))[0] == 4
    ring = geometry.circle(F.lit(0.5), 12)
    far = one(spark, geometry.inscribed(ring, geometry.point(F.lit(0.0), F.lit(0.0))), geometry.circumscribed(ring, geometry.point(F.lit(0.0), F.lit(0.0))))
    assert far[0] == pytest.approx(0.5 * math.cos(math.pi / 12)) and far[1] == pytest.approx(0.5)
    flat = geometry.polygon([(0, 0), (1, 1), (2, 2)])
    assert one(spark, geometry.centroid(flat))[0] == (1.0, 1.0)


def test_surface_and_placing(spark):
    box = geometry.rectangle(F.lit(2.0), F.lit(1.0))
    at = geometry.point(F.lit(0.0), F.lit(0.0))
    got = one(spark, *(geometry.surface(box, at, F.lit(a), F.lit(9.0)) for a in (0.0, math.pi / 2, math.pi)))
    assert [round(x, 9) for x in got] == [1.0, 0.5, 1.0]
    moved = one(spark, geometry.placed(geometry.polygon([(1, 0)]), F.lit(2.0), F.lit(3.0), F.lit(math.pi / 2)))[0][0]
    assert (moved.x, moved.y) == pytest.approx((2.0, 4.0))


def test_edge_costs_fold_in_order(spark):
    cells = spark.createDataFrame([("a", 0, c, {3: 255, 6: 254}.get(c, 1)) for c in range(8)] + [("a", r, c, 2) for r in range(1, 8) for c in range(8)], "grid_id string, row int, col int, cost int")
    poses = spark.createDataFrame([(1, "a", 0.0, 0.0, 0.0), (2, "a", 9.0, 0.0, 0.0)], "id long, grid_id string, x double, y double, yaw double")

    def cost(points):
        return {r.id: r.cost for r in footprint.costs(poses, cells, geometry.polygon(points), 1.0, 8).collect()}

    assert cost([(0.5, 0.5), (4.5, 0.5), (7.5, 0.5)]) == {1: 255, 2: 254}  # edges cost 255, 254, 254
    assert cost([(4.5, 0.5), (7.5, 0.5), (0.5, 0.5)])[1] == 254  # 254 comes first
    assert cost([(0.5, 0.5), (4.5, 0.5), (4.5, 3.5)])[1] == 255
    assert cost([(0.5, 1.5), (3.5, 1.5), (3.5, 3.5)])[1] == 2


# scans


@QUICK
@given(st.lists(st.one_of(st.floats(0, 12), st.sampled_from([float("nan"), float("inf"), 0.05, 10.0])), min_size=1, max_size=72), st.sampled_from([0.005, -0.3, 0.5]))
def test_scan_features_equal_plain_versions(spark, ranges, v):
    n = len(ranges)
    angles = [-math.pi + i * (2 * math.pi / n) for i in range(n)]
    df = spark.createDataFrame([(ranges, -math.pi, 2 * math.pi / n, 0.1, 10.0)], "ranges array<double>, angle_min double, angle_increment double, range_min double, range_max double")
    got = scan.with_beams(df).select(scan.r_min(), scan.r_ttc(F.lit(v)), scan.r_vis(), scan.r_width(), scan.r_clear()).first()
    good = [(r, a) for r, a in zip(ranges, angles) if 0.1 < r < 10.0]
    ahead = [r for r, a in good if abs(a) < math.pi / 3]
    field = [r for r, a in zip(ranges, angles) if abs(a) < math.pi / 3]
    hidden = [r for r in field if not math.isfinite(r) or r >= 9.9 or r <= 0.1]
    sides = [min((r for r, a in good if abs(a - m) < math.pi / 6), default=None) for m in (math.pi / 2, -math.pi / 2)]
    width = 10.0 if sides == [None, None] else sum(sides) if None not in sides else 2 * next(s for s in sides if s is not None)
    blocked = [False] * 36
    for r, a in good:
        if r < 3.0:
            blocked[int((a + math.pi) / (2 * math.pi / 36)) % 36] = True
    run = best = 0
    for x in blocked * 2:
        run = 0 if x else run + 1
        best = max(best, run)
    want = (min((r for r, _ in good), default=10.0), 100.0 if abs(v) < 0.01 or v < 0 or not ahead else min(min(ahead) / v, 100.0), len(hidden) / len(field) if field else 0.0, width, min(best, 36) * 2 * math.pi / 36)
    assert tuple(got) == pytest.approx(want)


def test_circular_runs(spark):
    for bins, want in (([0, 1, 0, 0], 3), ([0] * 4, 4), ([1] * 4, 0)):
        assert one(spark, scan.longest_circular(F.array(*(F.lit(bool(b)) for b in bins)), 4))[0] == want


# grids and paths


def test_distances_and_nearest_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    occupied = rng.random((9, 13)) < 0.1
    cells = spark.createDataFrame([(g, r, c, bool(occupied[r, c]) and g == "a") for g in "ab" for r in range(9) for c in range(13)], "grid_id string, row int, col int, occupied boolean")
    got = {(r.grid_id, r.row, r.col): r.distance for r in grid.distances(cells, 0.5).collect()}
    at = np.argwhere(occupied)
    assert all(got["a", r, c] == pytest.approx(0.5 * math.sqrt(((at - (r, c)) ** 2).sum(axis=1).min())) for r in range(9) for c in range(13))
    assert got["b", 3, 3] == float("inf")
    points, walls = rng.random((80, 2)) * 100, np.r_[rng.random((30, 2)), [[99.0, 2.0]]]
    p = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(points)], "id long, x double, y double")
    w = spark.createDataFrame([(float(x), float(y)) for x, y in walls], "x double, y double")
    near = {r.id: r.distance for r in kdtree.nearest(p, w, ("x", "y")).collect()}
    assert len(near) == 80 and all(near[k] == pytest.approx(math.sqrt(((walls - x) ** 2).sum(axis=1).min())) for k, x in enumerate(points))
    assert {r.distance for r in kdtree.nearest(p, w.limit(0), ("x", "y")).collect()} == {float("inf")}


def test_nearest_in_six_dimensions_compares_few_pairs(spark):
    n, names = 100_000, [f"d{k}" for k in range(6)]
    points = spark.range(n).select("id", *((F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << 30)) / (1 << 30)).alias(c) for k, c in enumerate(names)))
    got = kdtree.nearest(points, points, tuple(names), True)
    some = {r.id: r for r in got.where("id < 40").collect()}
    x = points.toPandas().sort_values("id")[names].to_numpy()
    for k in range(40):
        d = np.sqrt(((x - x[k]) ** 2).sum(axis=1))
        d[k] = np.inf
        assert some[k].distance == pytest.approx(d.min())
    share = got.agg(F.sum("compared")).first()[0] / (n * (n - 1))
    assert got.count() == n and share < 0.05


def test_nearest_among_crowds_and_copies(spark, monkeypatch):
    monkeypatch.setattr(kdtree, "LEAF", 8)
    monkeypatch.setattr(kdtree, "PIECE", 20)
    rng = np.random.default_rng(5)
    x = np.r_[rng.normal(size=(300, 3)) * 1e-3, rng.normal(size=(100, 3)) * 50, np.tile([[1.0, 2.0, 3.0]], (150, 1))]
    rows = [(f"p{k}", *map(float, v)) for k, v in enumerate(x)]
    df = spark.createDataFrame([*rows, ("odd", None, 1.0, 1.0), ("nan", float("nan"), 1.0, 1.0)], "id string, a double, b double, c double").repartition(4)
    for itself, others in ((True, df), (False, df.where("id > 'p3'").drop("id"))):
        got = {r.id: r.distance for r in kdtree.nearest(df, others, ("a", "b", "c"), itself).collect()}
        for k, (name, *_) in enumerate(rows):
            d = np.sqrt(((x - x[k]) ** 2).sum(axis=1))
            d[k if itself else [j for j, r in enumerate(rows) if r[0] <= "p3"]] = np.inf
            assert got[name] == pytest.approx(d.min(), abs=1e-12)
        assert got["odd"] == got["nan"] == float("inf") and len(got) == len(rows) + 2


def test_density_window_is_the_radius_in_cells(spark):
    cells = views.cells(spark, SF)
    every = cells.collect()
    for row, col, radius in ((4, 4, 2.0), (1, 6, 1.3), (20, 20, 2.0)):
        near = {}
        for c in every:
            held = near.setdefault(c.grid_id, [])
            if max(abs(c.row - row), abs(c.col - col)) <= int(radius / 0.5):
                held.append(c.cost == 254)
        got = {r.grid_id: r.density for r in grid.density(cells, row, col, radius, 0.5).collect()}
        assert got == pytest.approx({k: sum(x) / len(x) if x else 0 for k, x in near.items()})
    whole = {r.grid_id: r.n / 64 for r in cells.where("cost = 254").groupBy("grid_id").agg(F.count("*").alias("n")).collect()}
    assert {r.grid_id: r.r_dens for r in catalog.f4_density(spark, SF).collect()} == {k: round(whole.get(k, 0), 6) for k in near}


def test_cells_truncate(spark):
    assert tuple(one(spark, *(grid.cell_of(F.lit(x), F.lit(0.5), F.lit(0.5), True) for x in (0.49, 0.1, -9.0, 0.5, 1.2)))) == (None, None, None, 0, 1)
    assert tuple(one(spark, *(grid.cell_of(F.lit(x), F.lit(0.0), F.lit(1.0)) for x in (-0.5, 1.9)))) == (0, 1)


def test_paths_of_any_length(spark):
    rows = [("one", 0, 1.0, 1.0), *(("line", k, x, 0.0) for k, x in enumerate((0.0, 0.5, 3.0))), *(("turn", k, *p) for k, p in enumerate([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)])), ("same", 0, 0.0, 0.0), ("same", 1, 0.0, 0.0), ("same", 2, 1.0, 0.0)]
    got = {r.path_id: (r.n_poses, r.length, r.r_curve) for r in path.summary(spark.createDataFrame(rows, "path_id string, i int, x double, y double")).collect()}
    assert got == {"one": (1, 0.0, 0.0), "line": (3, 3.0, 0.0), "turn": (3, 2.0, 2.0), "same": (3, 1.0, 0.0)}


def test_confirmation_and_throttle(spark):
    log = spark.createDataFrame([(1, k, bool(h)) for k, h in enumerate((1, 1, 0, 1))], "key int, t int, hit boolean")
    assert [r.confirmed for r in merge.confirmed(log, "key", ["t"], "hit").orderBy("t").collect()] == [False, True, False, False]
    times = (0.0, 0.05, 0.11, 0.15, 0.22, 0.5)
    log = spark.createDataFrame([(k, t + k) for k in (1, 2) for t in times] + [(3, None), (None, 1.0)], "key int, t double")
    assert sorted(map(tuple, merge.throttled(log.coalesce(1), "key", "t", 0.1).collect())) == [(k, t + k) for k in (1, 2) for t in (0.0, 0.11, 0.22, 0.5)]


def test_a_hot_keys_throttle_equals_the_fold(spark):
    rng = random.Random(2)
    times = sorted(rng.choice([rng.uniform(0, 50), rng.randrange(50) / 4]) for _ in range(600))
    want, last = [], -math.inf
    for t in times:
        if t >= last + 0.7:
            want.append(t)
            last = t
    log = spark.createDataFrame([("a", t) for t in times], "key string, t double")
    for slab in (None, 3.0):
        assert sorted(r.t for r in merge.throttled(log, "key", "t", 0.7, slab).collect()) == want


def test_slabs_carry_runs_and_minima(spark):
    draw = random.Random(5)
    rows = [(key, t, draw.choice((True, True, True, False, None)), draw.choice((None, 1.0, 2.0, float(t % 17))), t // 4) for key in (1, 2, None) for t in draw.sample(range(60), 40)]
    log = spark.createDataFrame(rows, "key int, t int, hit boolean, value double, extra int")
    slab = F.floor(F.col("t") / 4)
    runs, least = {}, {}
    for key, t, hit, value, _ in sorted(rows, key=lambda r: (r[0] or 0, r[1])):
        last, low = next(((runs[k], least[k]) for k in reversed(runs) if k[0] == key), (0, None))
        runs[key, t] = 0 if hit is False else last + bool(hit)
        least[key, t] = min((v for v in (low, value) if v is not None), default=None)
    for by in (None, slab):
        got = merge.confirmed(log, "key", ["t"], "hit", 3, by)
        assert got.columns == [*log.columns, "run", "confirmed"]
        # a null hit ends no run, and a row of a miss itself counts none
        assert {(r.key, r.t): (r.run, r.confirmed) for r in got.collect()} == {k: (n, n >= 3) for k, n in runs.items()}
        assert {(r.key, r.t): r.low for r in merge.running_minima(log, "key", ["t"], {"low": F.col("value")}, by).collect()} == least
        assert merge.confirmed(log.limit(0), "key", ["t"], "hit", 3, by).count() == merge.running_minima(log.limit(0), "key", ["t"], {"low": F.col("value")}, by).count() == 0


def test_tiles_of_one_cost_and_with_gaps(spark):
    from wayfarer.operators import raster

    cells = spark.createDataFrame([("a", r, c, 10 * (r // 4) + 10 * (c // 4) * (c % 2)) for r in range(6) for c in range(7)] + [("b", 1, 1, 7), ("b", 0, 0, 9), ("b", -1, 0, 8)], "grid_id string, row int, col int, cost int")
    got = {(r.grid_id, r.tile >> 31, r.tile & 3): (r.th, r.tw, r.most, r.costs) for r in raster.tiles(cells, side=2).collect()}
    assert got[("a", 0, 0)] == (4, 4, 0, None) and got[("a", 1, 0)] == (2, 4, 10, None) and got[("a", 0, 1)] == (4, 3, 10, [0, 10, 0] * 4) and got[("b", 0, 0)] == (2, 2, 9, [9, 0, 0, 7])


def test_footprint_costs_on_a_large_map_keep_tiles_small(spark):
    from wayfarer.operators import raster

    n = 1500  # cells a side; free but for a wall and a corner of unknown cells
    cost = F.when(F.col("col") == 700, 254).when((F.col("row") > 1400) & (F.col("col") > 1400), 255).otherwise(0)
    cells = spark.range(n * n).select(F.lit("m").alias("grid_id"), F.floor(F.col("id") / n).cast("int").alias("row"), (F.col("id") % n).cast("int").alias("col")).withColumn("cost", cost)
    tiled = raster.tiles(cells)
    sizes = tiled.select(F.max(F.size("costs")), F.count_if(F.col("costs").isNotNull()), F.count("*")).first()
    assert sizes[0] <= 4096 and sizes[1] < 0.1 * sizes[2]
    maps = spark.createDataFrame([("m", n, n, -10.0, -20.0, 0.05)], "grid_id string, width int, height int, origin_x double, origin_y double, resolution double")
    at = [(1, 20.0, 0.0, 0.3), (2, 24.9, 0.0, 0.0), (3, 64.0, 54.0, 1.0), (4, -10.1, 0.0, 0.0), (5, 0.0, 10.0, 2.0)]
    poses = spark.createDataFrame([(i, "m", *p) for i, *p in at] + [(6, "none", 0.0, 0.0, 0.0)], "id int, grid_id string, x double, y double, yaw double")
    square = geometry.polygon([(0.4, 0.4), (-0.4, 0.4), (-0.4, -0.4), (0.4, -0.4)])
    assert {r.id: r.cost for r in raster.footprint_costs(poses, maps, tiled, square).collect()} == {1: 0, 2: 254, 3: 255, 4: 254, 5: 0, 6: 254}



def test_termination_order(spark):
    ticks = [(1, 0, 1.0, 0.1, 0.1, False), (1, 1, 2.0, 0.25, 2 * math.pi - 0.2, True), (2, 0, 3.0, 0.1, 0.3, True), (3, 0, 9.0, 1.0, 0.0, False), (3, 1, 9.5, 0.0, 0.0, False), (4, 0, 1.0, 9.0, 0.0, False)]
    df = spark.createDataFrame(ticks, "key int, i int, elapsed double, xy double, yaw double, hit boolean")
    got = trials.terminated(df, "key", ["i"], F.col("elapsed"), F.col("xy"), F.col("yaw"), F.col("hit"), 8.0).collect()
    assert {tuple(r) for r in got} == {(1, 1, "SUCCESS", 2.0), (2, 0, "COLLISION", 3.0), (3, 0, "TIMEOUT", 9.0)}


def test_windows_without_rows_are_stale(spark):
    log = spark.createDataFrame([("a", 0.5, 1.0, True), ("a", 1.0, 2.0, False), ("a", 16.0, 9.0, False)], "key string, t double, v double, d boolean")
    got = merge.timing(log, "key", F.col("t"), ["t"], F.col("v"), F.col("d"), 5.0, 10.0).orderBy("w").collect()
    assert [(r.w, r.level, r.cycles, r.cycles_total, r.degraded_total, r.last) for r in got] == [(0, "OK", 2, 2, 1, 2.0), (1, "STALE", 0, 2, 1, None), (2, "STALE", 0, 2, 1, None), (3, "WARN", 1, 3, 1, 9.0)]
    assert [round(r.degraded_pct, 3) for r in got] == [50.0, 50.0, 50.0, 33.333]


# designs


def test_pose_pairs_keep_to_valid_cells_or_fail(spark):
    cells = spark.createDataFrame([(0, r, c, 254 if (r, c) == (3, 3) else 0) for r in range(12) for c in range(12)], "grid_id int, row int, col int, cost int")
    valid = design.valid_cells(cells, 1.0, 2.0, F.col("cost") <= 50, F.col("cost") == 254, F.col("col") < 10).select("row", "col", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    rows = design.pose_pairs(valid, 40, 5, 3.0, 9.0, first=1).collect()
    assert len(rows) == 40 and max(r.attempt for r in rows) > 1 and len({(r.start.x, r.start.y) for r in rows}) > 20
    for r in rows:
        d = math.hypot(r.goal.x - r.start.x, r.goal.y - r.start.y)
        assert 3 <= d <= 9 and r.distance == round(d, 3) and all(-math.pi <= p.yaw < math.pi and p.x < 10 and math.hypot(p.x - 3, p.y - 3) >= 2 for p in (r.start, r.goal))
    assert sorted(map(tuple, design.pose_pairs(valid.repartition(7), 40, 5, 3.0, 9.0, first=1000).collect())) == sorted(map(tuple, rows))
    with pytest.raises(Exception, match="no start and goal"):
        design.pose_pairs(valid, 3, 5, 50.0, 60.0, 20).collect()
    with pytest.raises(Exception, match="too few valid cells: 9"):
        design.pose_pairs(valid.limit(9), 3, 5).collect()


def test_spread_out_designs(spark):
    rows = design.spread_out(spark, 20, 3, [("v", 0.0, 1.0, 0), ("w", 0.0, 1.0, 0)], {"arm": ["a", "b"]}).collect()
    assert sorted(r["rank"] for r in rows) == list(range(20)) and sum(r.arm == "a" for r in rows) == 10
    assert [r.id for r in sorted(rows, key=lambda r: r["rank"])] != sorted(r.id for r in rows)


@QUICK
@given(st.integers(2, 40), st.integers(0, 99))
def test_latin_hypercube_fills_each_stratum_once(spark, n, seed):
    rows = design.latin_hypercube(spark, n, seed, [("v", 0.0, 1.0, 0), ("k", 30, 90, 61)], {"arm": ["a", "b", "c"]}).collect()
    assert sorted(int(r.v * n) for r in rows) == list(range(n))
    assert all(30 <= r.k <= 90 and r.k == int(r.k) for r in rows)
    counts = [sum(r.arm == c for r in rows) for c in "abc"]
    assert max(counts) - min(counts) <= 1 or n < 3


def test_maximin_keeps_quotas_and_spreads(spark):
    numeric = [("v", 0.0, 1.0, 0), ("w", 0.0, 1.0, 0)]
    pool = design.latin_hypercube(spark, 300, 1, numeric, {"arm": ["a", "b"]})
    rows = design.maximin(pool, "arm", ["v", "w"], 21).toPandas()
    assert sorted(rows.groupby("arm").size()) == [10, 11] and rows["id"].is_unique

    def least(x):
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        return d[~np.eye(len(x), dtype=bool)].min()

    for arm, g in rows.groupby("arm"):
        some = pool.where(F.col("arm") == arm).orderBy("id").limit(len(g)).toPandas()
        assert least(g[["v", "w"]].to_numpy()) >= least(some[["v", "w"]].to_numpy())


def test_hull_holds_all_points(spark):
    points = views.poses(spark, SF).select("path_id", "x", "y")
    rings = design.hull(points, "path_id").toPandas()
    for key, pts in points.toPandas().groupby("path_id"):
        ring = rings[rings.path_id == key].sort_values("i")[["x", "y"]].to_numpy()
        if len(ring) < 3:
            continue
        a, b = ring, np.roll(ring, -1, axis=0)
        p = pts[["x", "y"]].to_numpy()[:, None]
        assert ((b[:, 0] - a[:, 0]) * (p[..., 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (p[..., 0] - a[:, 0]) >= -1e-5).all()


def test_measured_outline(spark):
    joints = spark.createDataFrame([("r", 0.6, 0.0), ("r", 0.3, 0.0), ("r", 0.0, 0.1)], "robot string, x double, y double")
    ring = design.hull(footprint.outline_points(joints, 0.27, 0.05), "robot").toPandas()
    assert ring["x"].max() == pytest.approx(0.65) and ring["x"].min() == pytest.approx(-0.27)
    ends = design.hull(footprint.outline_points(joints, 0.27, 0.05, ends=True), "robot").toPandas()
    assert ends["x"].max() == ring["x"].max() and ends["y"].max() == ring["y"].max() and len(ends) <= len(ring)


def test_hulls_grow_batch_by_batch(spark):
    draw = random.Random(2)
    rows = [(k, draw.uniform(-1, 1), draw.uniform(-1, 1)) for k in ("a", "b", "c") for _ in range(300)] + [("one", 0.5, 0.5), ("line", 0.0, 0.0), ("line", 0.5, 0.5), ("line", 1.0, 1.0), (None, 9.0, 9.0), ("a", None, 9.0)]
    points = spark.createDataFrame(rows, "k string, x double, y double").repartition(3)
    whole = {tuple(r) for r in design.hull(points, "k").collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {tuple(r) for r in design.hull(points, "k").collect()} == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r for r in whole if r[0] in ("one", "line")} == {("one", 0, 0.5, 0.5), ("line", 0, 0.0, 0.0), ("line", 1, 1.0, 1.0)}
    assert design.hull(points.limit(0), "k").count() == 0


def test_hull_of_points_on_slanted_edges_equals_sql(spark, tmp_path):
    """Where decimals are on a line, doubles may not be: what the SQL takes for a corner is one here, however the points are parted."""
    draw = random.Random(5)
    # (5.16, 75) is on the line of (0.18, 63) and (13.46, 95); the SQL's arithmetic keeps it
    seen = [(0.18, 63), (1.58, 14), (3.55, 10), (17.51, 5), (38.99, 1), (227.67, 11), (172.55, 47), (112.9, 84), (54.05, 99), (18.85, 98), (13.46, 95), (5.16, 75)]
    groups = [seen, [(3.0, 4)], [(3.0, 4)] * 2, [(3.0, 4), (5.0, 9)]]
    for _ in range(40):  # corners and many points on the edges between them
        (ax, ay), (bx, by), (cx, cy) = (draw.randint(0, 9), 0), (draw.randint(40, 60), draw.randint(0, 5)), (draw.randint(10, 30), draw.randint(30, 60))
        at = [(p + (q - p) * k, r + (s - r) * k) for p, r, q, s in ((ax, ay, bx, by), (bx, by, cx, cy), (cx, cy, ax, ay)) for k in (0, 0.25, 0.5, 0.75)]
        groups.append([(round(x * 0.6 + 0.07, 2), round(y * 4)) for x, y in at] + [(20.0, 50)])
    events = [(user, value, f'{{"k": {k}}}') for user, g in enumerate(groups) for value, k in g]
    draw.shuffle(events)
    rows = [(n, user, "view", value, props) for n, (user, value, props) in enumerate(events)]
    made = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").withColumn("ts", F.timestamp_seconds("event_id"))
    made.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.sql(catalog.ORACLE_SQL["g16_convex_hull"]).fetchall())
    assert (0, 11, 0.0516, 0.75) in want
    for few in (design.FEW, 1):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(design, "FEW", few)
            assert sorted(map(tuple, catalog.QUERIES["g16_convex_hull"](spark, str(tmp_path)).collect())) == want


# trials


def test_targets_and_unverified(spark):
    ddl = "trial_id long, param_type string, apply_via string, value string, presets map<string,string>, ros_node string, name string, extra_targets array<struct<ros_node:string,name:string>>"
    params = spark.createDataFrame([(1, "continuous", None, "0.5", None, "n", "r", [("m", "r")]), (1, "footprint", "footprint", "tucked", {"tucked": "[[0,0],[1,0],[0,1]]"}, "n", "f", None), (2, "discrete", None, "3", None, "n", "k", None)], ddl)
    got = {"m": "0.9", "n": "0.5"}
    applied = trials.targets(params).withColumn("got", F.when(F.col("name") == "f", "[[0,0],[1,0],[0,1]]").when(F.col("name") == "k", "3").otherwise(F.when(F.col("ros_node") == "m", got["m"]).otherwise(got["n"])))
    assert {tuple(r) for r in trials.unverified(applied).collect()} == {(1, 1, "m/r", 0), (2, 0, "", 1)}


def test_footprints_and_moves(spark):
    presets, fallback = F.create_map(F.lit("t"), F.lit("[[0,0],[1,0],[0,1]]")), geometry.circle(F.lit(1.0), 8)
    sizes = [one(spark, F.size(trials.footprint_of(F.lit(x), presets, fallback)))[0] for x in ("t", "[[0,0],[2,0],[2,2],[0,2]]", "other", None)]
    assert sizes == [3, 4, 8, 8]
    said = ((None, True), ("x", True), ("x", True), ("y", False), ("y", True), ("y", True), (None, False), (None, True), ("y", False), (None, True))
    rows = spark.createDataFrame([(1, i, *r) for i, r in enumerate(said)], "key int, i int, label string, ok boolean")
    assert [r.move for r in trials.moves(rows, "key", "i", "label", "ok").orderBy("i").collect()] == [False, True, False, True, True, False, True, False, True, False]


# sources and sinks


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "poses.json").write_text(json.dumps([{"id": 0, "start": {"x": 0.0, "y": 0.0, "yaw": 0.0}, "goal": {"x": 3.0, "y": 4.0, "yaw": 1.0}, "distance": 5.0}], indent=1))
    assert readers.pose_pairs(spark, str(tmp_path / "poses.json")).selectExpr("round(hypot(goal.x - start.x, goal.y - start.y), 3) = distance").first()[0]
    (tmp_path / "configs.json").write_text('[{"id": 0, "config": {"a": 1.5, "b": "x"}}, {"a": 2.5, "b": "y"}]')
    assert [tuple(r.config) for r in readers.configs(spark, str(tmp_path / "configs.json"), "struct<a: double, b: string>").collect()] == [(1.5, "x"), (2.5, "y")]
    (tmp_path / "trials.csv").write_text("trial_id,status,clearance\n1,SUCCESS,inf\n2,PLANNING_FAILED,0.0\n3,TIMEOUT,nan\n")
    log = readers.trials_csv(spark, str(tmp_path / "trials.csv"), "trial_id long, status string, clearance double")
    assert [str(r.clearance) for r in log.orderBy("trial_id").collect()] == ["inf", "0.0", "nan"]
    assert [r.clearance for r in readers.typed_trials(log, ["clearance"]).where("trial_id = 2").collect()] == [None]
    assert readers.completed(log).first()[0] == 3 and readers.completed(log.limit(0)).first()[0] == 0
    assert sinks.summary(log).first().asDict() == {"total": 3, "success": 1, "collision": 0, "timeout": 1, "canceled": 0, "failed": 0, "planning_failed": 1, "unknown": 0, "exception": 0, "other": 0}


def test_trial_log_takes_new_columns(spark, tmp_path):
    first = spark.createDataFrame([(1, (0.5,))], "trial_id long, params struct<`c.vx`: double>")
    sinks.append(sinks.flat(first), str(tmp_path / "log"))
    sinks.append(spark.createDataFrame([(2, "e")], "trial_id long, error string"), str(tmp_path / "log"))
    assert [tuple(r) for r in sinks.log(spark, str(tmp_path / "log")).orderBy("trial_id").collect()] == [(None, 0.5, 1), ("e", None, 2)]
    sinks.checkpoint(spark.createDataFrame([(4,), (9,)], "trial_id long"), str(tmp_path / "at"), "m.yaml")
    assert readers.resumed(spark, str(tmp_path / "at")) == 9
    sinks.export(spark.createDataFrame([("b",), ("a",)], "name string"), ["name"], str(tmp_path / "out"))
    assert {(r.id, r.name) for r in spark.read.json(str(tmp_path / "out")).collect()} == {(0, "a"), (1, "b")}
    rerun = spark.createDataFrame([(1, "t1", "EXCEPTION"), (1, "t2", "SUCCESS"), (2, "t1", "TIMEOUT")], "trial_id long, timestamp string, status string")
    assert {tuple(r) for r in trials.newest(rerun).collect()} == {(1, "t2", "SUCCESS"), (2, "t1", "TIMEOUT")}


def test_trial_records_are_nested(spark, tmp_path):
    made = [(k, "SUCCESS", 0.0, 1.0, 0.5, 3.0, 4.0, -0.5, 10.0, 20.0, 0.2) for k in range(6)]
    done = spark.createDataFrame(made, "trial_id long, status string, start_x double, start_y double, start_yaw double, goal_x double, goal_y double, goal_yaw double, t_nav_start double, t_nav_end double, goal_distance_remaining double")
    samples = spark.createDataFrame([(0, 12.0, 0.4), (0, 11.0, 0.3)], "trial_id long, ts double, footprint_cost double")
    states = spark.createDataFrame([(0, t, t / 2) for t in (9.0, 20.0, 10.0, 21.0)], "trial_id long, ts double, r_min double")
    plans = spark.createDataFrame([(1, 15.0, [(0.0, 0.0)])], "trial_id long, ts double, poses array<struct<x: double, y: double>>")
    sinks.details(sinks.records(done, samples, states, plans), str(tmp_path / "details"), 2)
    files = [f for f in (tmp_path / "details").iterdir() if f.suffix == ".json"]
    assert len(files) == 2
    read = {r["trial_id"]: r for f in files for r in map(json.loads, f.read_text().splitlines())}
    assert len(read) == 6 and read[0]["initial_pose"] == {"x": 0.0, "y": 1.0, "yaw": 0.5} and read[0]["goal_pose"]["yaw"] == -0.5
    assert [s["ts"] for s in read[0]["path_with_controller"]] == [11.0, 12.0] and [s["ts"] for s in read[0]["risk_state_history"]] == [10.0, 20.0]
    assert (read[0]["num_risk_samples"], read[0]["num_controller_samples"], read[0]["num_global_replans"], read[1]["num_global_replans"]) == (4, 2, 0, 1)
    assert "goal_distance_remaining" in read[0] and "t_nav_start" not in read[0]


def png(pixels):
    """A plain 8-bit PNG: grey for two dimensions, colour for three."""
    h, w = pixels.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if pixels.ndim == 2 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_map_files_and_settings(spark, tmp_path):
    grey = np.array([[0, 254, 205], [7, 0, 254]], np.uint8)
    (tmp_path / "a.png").write_bytes(png(grey))
    (tmp_path / "b.png").write_bytes(png(np.stack([grey, grey // 2, grey // 3], axis=2)))
    (tmp_path / "map.yaml").write_text("image: a.png\nresolution: 0.5\norigin: [1.0, 2.0, 0.0]\noccupied_thresh: 0.6\n")
    meta = readers.map_meta(spark, str(tmp_path / "map.yaml"))
    assert (meta["resolution"], meta["negate"], meta["occupied_thresh"]) == (0.5, 0, 0.6) and meta["image"].endswith("/a.png")
    cells = readers.image_cells(spark, meta["image"]).orderBy("row", "col").collect()
    assert [r.pixel for r in cells] == grey.ravel().tolist()
    colour = [r.pixel for r in readers.image_cells(spark, str(tmp_path / "b.png")).orderBy("row", "col").collect()]
    assert colour == [(r * 19595 + (r // 2) * 38470 + (r // 3) * 7471 + 32768) >> 16 for r in map(int, grey.ravel())]
    (tmp_path / "c.yaml").write_text("num_trials: 7\nmap_frame: map\n")
    assert readers.Settings.read(spark, str(tmp_path / "c.yaml")).num_trials == 7
    (tmp_path / "bad.yaml").write_text("image: a.png\n")
    with pytest.raises(ValueError, match="origin, resolution"):
        readers.map_meta(spark, str(tmp_path / "bad.yaml"))


def test_maps(spark, tmp_path):
    (tmp_path / "a.pgm").write_bytes(b"P5\n# map\n3 2\n255\n" + bytes([0, 254, 205, 0, 0, 254]))
    (tmp_path / "b.pgm").write_text("P2\n3 2\n255\n0 254 205\n0 0 254\n")
    cells = readers.map_cells(spark, str(tmp_path))
    by_map = {k: g.sort_values(["row", "col"])["pixel"].tolist() for k, g in cells.toPandas().groupby("map_id")}
    assert list(by_map.values()) == [[0, 254, 205, 0, 0, 254]] * 2
    meta = {"resolution": 0.5, "origin": [1.0, 2.0, 0.0], "negate": 0, "occupied_thresh": 0.65}
    found = readers.occupied(cells.where("map_id like '%a.pgm'"), meta, 2)
    assert {(r.x, r.y) for r in found.collect()} == {(1.25, 2.75), (1.25, 2.25), (1.75, 2.25)}
    with pytest.raises(ValueError):
        readers.decode_pgm(b"P6 nope")


def test_settings():
    assert readers.Settings.of({"num_trials": 5}).num_trials == 5
    with pytest.raises(ValueError, match="unknown settings: nope"):
        readers.Settings.of({"nope": 1})


# streams


def test_stream_state_equals_batch(spark, tmp_path):
    log = spark.read.parquet(f"{SF}/events.parquet")
    log.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    topics = ["click", "error", "view"]
    files = latest.events(spark, str(tmp_path / "in"), log.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "), 100)
    q = latest.latest_values(files, topics).writeStream.format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = merge.latest(log, "user_id", ["ts", "event_id"], "event_type", "value", topics).select("event_id", *(f"last_{t}" for t in topics))
    plain = lambda df: sorted((tuple(None if x is None or x != x else x for x in r) for r in df.collect()), key=lambda r: r[0])
    assert plain(spark.table("latest")) == plain(want)


def test_closed_windows_equal_batch(spark, tmp_path):
    log = spark.read.parquet(f"{SF}/events.parquet")
    log.write.parquet(str(tmp_path / "in"))
    files = latest.events(spark, str(tmp_path / "in"), log.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "), 100)
    q = latest.timing(files, "1 day", "1 hour", 200.0).writeStream.format("memory").queryName("timing").option("checkpointLocation", str(tmp_path / "c2")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    closed = {r.started: tuple(r)[1:] for r in spark.table("timing").collect()}
    batch = {r.started: tuple(r)[1:] for r in latest.timing(log.withColumn("ts", F.col("ts").cast("timestamp")), "1 day", "1 hour", 200.0).collect()}
    assert closed and all(batch[k][:-1] == pytest.approx(v[:-1]) and batch[k][-1] == v[-1] for k, v in closed.items())
    assert len(batch) - len(closed) <= 2


def test_topics_become_risk_messages(spark, tmp_path):
    rows = [("r", "2024-01-01 00:00:01", -1.0, 1.0, 0.5, 0.1, 5.0, [1.0, 2.0, 0.5, 9.0])]
    spark.createDataFrame(rows, "key string, ts string, angle_min double, angle_max double, angle_increment double, range_min double, range_max double, ranges array<float>").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "scan"))
    seen = scan.with_beams(latest.topic(spark, "scan", str(tmp_path / "scan")))
    states = seen.select("ts", scan.r_min().alias("r_min"), *(F.lit(0.0).alias(n) for n in latest.RISK[1:]))
    latest.published(latest.risk_messages(states), str(tmp_path / "risk"), str(tmp_path / "cp")).awaitTermination(120)
    back = latest.well_formed(spark.read.parquet(str(tmp_path / "risk"))).collect()
    assert [(r.r_min, r.r_vis) for r in back] == [(0.5, 0.0)]


def test_messages_and_ticks(spark):
    messages = spark.createDataFrame([(1.0, [float(k) for k in range(8)]), (2.0, [1.0])], "ts double, data array<double>")
    assert [(r.ts, r.r_vis) for r in latest.well_formed(messages).collect()] == [(1.0, 7.0)]
    assert latest.ticks("2024-01-01 00:00:00", "2024-01-01 00:00:01", spark).count() == 11


def test_distances_on_long_lines_are_not_quadratic(spark):
    import time

    n = 30_000
    cells = spark.range(n).select(F.lit(0).alias("grid_id"), F.lit(0).alias("row"), F.col("id").cast("int").alias("col"), (F.col("id") == 7).alias("occupied"))
    turned = cells.select("grid_id", F.col("col").alias("row"), F.col("row").alias("col"), "occupied")
    grid.distances(cells.limit(10), 1.0).collect()
    for lines, k in ((cells, "col"), (turned, "row")):
        began = time.time()
        got = grid.distances(lines, 0.5).agg(F.count("*"), F.sum(F.col("distance") - 0.5 * F.abs(F.col(k) - 7))).first()
        assert got[:] == (n, 0.0) and time.time() - began < 20


def test_the_lower_envelope_equals_brute_force():
    from wayfarer.operators import envelope

    rng = np.random.default_rng(1)
    for _ in range(100):
        n, m = rng.integers(0, 30, 5), rng.integers(0, 10, 5)
        at, places = (np.concatenate([np.sort(rng.choice(60, k, replace=False)) for k in x]).astype(int) for x in (n, m))
        values, of, sites_of = rng.integers(0, 200, len(places)), np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(m)]
        want = [min(((x - p) ** 2 + v for p, v in zip(places[a:b], values[a:b], strict=True)), default=-1) for k, (a, b) in enumerate(zip(sites_of[:-1], sites_of[1:], strict=True)) for x in at[of[k] : of[k + 1]]]
        assert envelope.lower(at, of, places, values, sites_of).tolist() == want
