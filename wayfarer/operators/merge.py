"""Ordered and stateful operators over logs with a key and a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfarer.sources.shared import stash


def upto(key: str, *order: str) -> Window:
    return Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def last_known(log: DataFrame, key: str, order: list[str], values: dict[str, Column], slab: Column | None = None) -> DataFrame:
    """The log with the last value that isn't null of each column of values, up to each row of its key.

    slab: a number that grows with the order, such as the day. Rows are then looked through within a key's
    slab, and what earlier slabs hold comes from one row for each, so a key of any size is many tasks' work.
    """
    if slab is None:
        w = upto(key, *order)
        return log.select("*", *(F.last(v, True).over(w).alias(n) for n, v in values.items()))
    marked = log.select("*", slab.alias("_slab"), *(v.alias(f"_{n}") for n, v in values.items()))
    w = Window.partitionBy(key, "_slab").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = marked.select(*log.columns, "_slab", *(F.last(f"_{n}", True).over(w).alias(f"_{n}") for n in values))
    ends = marked.groupBy(F.col(key).alias("_key"), F.col("_slab").alias("_of")).agg(*(F.max_by(f"_{n}", F.when(F.col(f"_{n}").isNotNull(), F.struct(*order))).alias(f"_{n}") for n in values))
    earlier = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("_key", "_of", *(F.last(f"_{n}", True).over(earlier).alias(f"_before_{n}") for n in values))
    both = seen.join(before, F.col(key).eqNullSafe(F.col("_key")) & F.col("_slab").eqNullSafe(F.col("_of")))
    return both.select(*log.columns, *(F.coalesce(f"_{n}", f"_before_{n}").alias(n) for n in values))


def latest(log: DataFrame, key: str, order: list[str], topic: str, value: str, topics: list[str], slab: Column | None = None) -> DataFrame:
    """The log with the latest value of each topic at each row (as-of merge, backward); slab as for last_known."""
    return last_known(log, key, order, {f"last_{t}": F.when(F.col(topic) == t, F.col(value)) for t in topics}, slab)


def confirmed(log: DataFrame, key: str, order: list[str], hit: str, frames: int = 2, slab: Column | None = None) -> DataFrame:
    """The run of hits up to each row and if it is long enough. A null hit neither goes on with a run nor ends it.

    slab as for last_known: runs are then counted within a key's slab, and one that is still going on at its
    end is carried into the next.
    """
    of = [key] if slab is None else [key, "_slab"]
    w = Window.partitionBy(*of).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = log if slab is None else log.withColumn("_slab", slab)
    marked = marked.withColumn("_island", F.coalesce(F.sum((~F.col(hit)).cast("int")).over(w), F.lit(0)))
    within = Window.partitionBy(*of, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("run", F.coalesce(F.sum(F.col(hit).cast("int")).over(within), F.lit(0).cast("long")))
    if slab is None:
        return marked.withColumn("confirmed", F.col("run") >= frames).drop("_island")
    ends = marked.groupBy(F.col(key).alias("_key"), F.col("_slab").alias("_of")).agg(F.max_by("run", F.struct(*order)).alias("_tail"), (F.max("_island") > 0).alias("_ended"))
    slabs = Window.partitionBy("_key").orderBy("_of")
    ends = ends.withColumn("_group", F.sum(F.col("_ended").cast("int")).over(slabs))
    going = F.sum("_tail").over(Window.partitionBy("_key", "_group").orderBy("_of"))
    before = ends.withColumn("_going", going).select("_key", "_of", F.coalesce(F.lag("_going").over(slabs), F.lit(0)).alias("_before"))
    both = marked.join(before, F.col(key).eqNullSafe(F.col("_key")) & F.col("_slab").eqNullSafe(F.col("_of")))
    run = F.col("run") + F.when(F.col("_island") == 0, F.col("_before")).otherwise(0)
    return both.select(*log.columns, run.alias("run"), (run >= frames).alias("confirmed"))


def bounded(key: str, order: list[str], frames: int = 2) -> Window:
    return Window.partitionBy(key).orderBy(*order).rowsBetween(-(max(10, 2 * frames) - 1), 0)


def detection_stats(log: DataFrame, key: str, order: list[str], costmap_hit: Column, lidar_hit: Column, cost: Column, clearance: Column, frames: int = 2) -> DataFrame:
    """The log with statistics of the bounded history up to each row."""
    w = bounded(key, order, frames)
    rate = lambda c: F.avg(c.cast("double")).over(w)
    return log.select("*", F.count("*").over(w).alias("num_frames"), rate(costmap_hit).alias("costmap_rate"), rate(lidar_hit).alias("lidar_rate"), F.avg(cost).over(w).alias("mean_cost"), F.avg(clearance).over(w).alias("mean_clearance"), F.min(clearance).over(w).alias("min_clearance"))


def fused(log: DataFrame, key: str, order: list[str], cost: Column, lidar_hit: Column, both: bool = False, frames: int = 2, lethal: int = 253, slab: Column | None = None) -> DataFrame:
    """The log with costmap_hit, hit (of either source, or of both) and if the run of hits confirms a collision."""
    costmap_hit = cost >= lethal
    marked = log.withColumn("costmap_hit", costmap_hit).withColumn("hit", costmap_hit & lidar_hit if both else costmap_hit | lidar_hit)
    return confirmed(marked, key, order, "hit", frames, slab)


def degraded(log: DataFrame, key: str, order: list[str], early: Column, late: Column, budget: float, features: dict[str, tuple[int, Column]], slab: Column | None = None) -> DataFrame:
    """The log with features as far as the time budget went, else carried on from the rows before (0 at first), and how many were computed.

    features: name to tier and value. Tier 0 is always computed, 1 if `early` is below half the budget, 2 if
    `late` is below 0.8 of it.
    """
    due = (F.lit(True), early < 0.5 * budget, late < 0.8 * budget)
    n = sum((due[tier].cast("int") for tier, _ in features.values()), F.lit(0))
    known = last_known(log.withColumn("computed", n), key, order, {name: F.when(due[tier], x) for name, (tier, x) in features.items()}, slab)
    return known.fillna(0.0, list(features))


def last_pose(log: DataFrame, key: str, order: list[str], pose: list[str], live: DataFrame | None = None) -> DataFrame:
    """Per key the pose of its last sample and the number of samples; live (key and pose): what holds for keys without samples."""
    last = log.groupBy(key).agg(F.max_by(F.struct(*pose), F.struct(*order)).alias("p"), F.count("*").alias("n_samples"))
    found = last.select(key, *(F.col(f"p.{c}").alias(c) for c in pose), "n_samples")
    if live is None:
        return found
    both = live.select(key, F.struct(*pose).alias("live")).join(last, key, "full")
    return both.select(key, *(F.coalesce(F.col(f"p.{c}"), F.col(f"live.{c}")).alias(c) for c in pose), F.coalesce("n_samples", F.lit(0)).alias("n_samples"))


def running_minima(log: DataFrame, key: str, order: list[str], values: dict[str, Column], slab: Column | None = None) -> DataFrame:
    """The log with the least value so far of each column of values (null before the first); slab as for last_known."""
    if slab is None:
        return log.select("*", *(F.min(v).over(upto(key, *order)).alias(n) for n, v in values.items()))
    marked = log.select("*", slab.alias("_slab"), *(v.alias(f"_{n}") for n, v in values.items()))
    w = Window.partitionBy(key, "_slab").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = marked.select(*log.columns, "_slab", *(F.min(f"_{n}").over(w).alias(f"_{n}") for n in values))
    ends = marked.groupBy(F.col(key).alias("_key"), F.col("_slab").alias("_of")).agg(*(F.min(f"_{n}").alias(f"_{n}") for n in values))
    earlier = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("_key", "_of", *(F.min(f"_{n}").over(earlier).alias(f"_before_{n}") for n in values))
    both = seen.join(before, F.col(key).eqNullSafe(F.col("_key")) & F.col("_slab").eqNullSafe(F.col("_of")))
    return both.select(*log.columns, *(F.least(f"_{n}", f"_before_{n}").alias(n) for n in values))


def finite(value: Column) -> Column:
    """The value where it is a finite number."""
    return F.when(F.abs(value) < float("inf"), value)


def timing(log: DataFrame, key: str, time: Column, order: list[str], value: Column, degraded: Column, every: float, budget: float) -> DataFrame:
    """Per key and window of `every` from time 0: timing statistics, the cycles and degraded cycles so far, and a level.

    The level comes from the 99th percentile and the budget; windows without rows between a key's others are STALE.
    """
    at = log.select(key, F.floor(time / every).cast("long").alias("w"), value.alias("v"), degraded.cast("long").alias("d"), F.struct(*order).alias("o"))
    p99 = F.percentile("v", 0.99)
    level = F.when(p99 < 0.5 * budget, "OK").when(p99 < budget, "WARN").otherwise("ERROR")
    stats = at.groupBy(key, "w").agg(
        F.count("*").alias("cycles"), F.sum("d").alias("degraded"), F.avg("v").alias("mean"), F.percentile("v", 0.95).alias("p95"), p99.alias("p99"),
        F.max("v").alias("worst"), F.max_by("v", "o").alias("last"), level.alias("level"),
    )
    ends = stats.groupBy(key).agg(F.min("w").alias("a"), F.max("w").alias("b"))
    whole = ends.select(key, F.explode(F.sequence("a", "b")).alias("w")).join(stats, [key, "w"], "left")
    w = upto(key, "w")
    whole = whole.withColumns({"cycles": F.coalesce("cycles", F.lit(0)), "degraded": F.coalesce("degraded", F.lit(0)), "level": F.coalesce("level", F.lit("STALE"))})
    whole = whole.withColumns({"cycles_total": F.sum("cycles").over(w), "degraded_total": F.sum("degraded").over(w)})
    return whole.withColumn("degraded_pct", 100.0 * F.col("degraded_total") / F.greatest("cycles_total", F.lit(1)))


def throttled(log: DataFrame, key: str, time: str, period: float, slab: float | None = None) -> DataFrame:
    """(key, time) at which a throttle emits: at the first row, then at the first row at least the period after the last emission.

    Each time points to the one that would be emitted after it. Pointers are doubled (2, 4, 8 .. emissions on) and the first
    times follow them back from the longest, so a key's n emissions take log n joins by key and time, which deal
    a hot key over all tasks. slab: units of time of a key's log that are taken together to find the pointers.
    """
    times = log.select(F.col(key).alias("of"), F.col(time).cast("double").alias("own")).where("of is not null and own is not null").distinct()
    asked = times.select("of", "own", (F.col("own") + period).alias("at"), F.lit(1).alias("ask"), F.lit(None).cast("double").alias("here"))
    both = times.select("of", F.lit(None).cast("double").alias("own"), F.col("own").alias("at"), F.lit(0).alias("ask"), F.col("own").alias("here")).unionByName(asked).withColumn("back", -F.col("at"))
    seen = last_known(both, "of", ["back", "ask"], {"next": F.col("here")}, F.floor(F.col("back") / (slab or 64 * period)))
    steps = [stash(seen.where("ask = 1 and next is not null").select("of", "own", "next"), "throttle")]
    longest = times.groupBy("of").agg((F.max("own") - F.min("own")).alias("span")).agg(F.max("span")).first()[0] or 0.0
    for _ in range(int(longest / period).bit_length() - 1):
        a, b = steps[-1], steps[-1].select("of", F.col("own").alias("next"), F.col("next").alias("after"))
        steps.append(stash(a.join(b, ["of", "next"]).select("of", "own", F.col("after").alias("next")), "throttle"))
    met = times.groupBy("of").agg(F.min("own").alias("own"))
    for step in reversed(steps):
        met = stash(met.union(met.join(step, ["of", "own"]).select("of", F.col("next").alias("own"))), "throttle")
    return met.select(F.col("of").alias(key), F.col("own").alias(time))


def first_rows(log: DataFrame, key: str, order: list[str], n: int = 3) -> DataFrame:
    """The first n rows of each key."""
    return log.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def first_stop(failed: DataFrame, key: str, order: str, flag: str, n: int) -> DataFrame:
    """Per key, the first row at which n failures have come in a row."""
    runs = confirmed(failed, key, [order], flag, n)
    return runs.where("confirmed").groupBy(key).agg(F.min(order).alias("stopped_at"))


def ticked(log: DataFrame, key: str, time: str, order: str, driving: Column, values: dict[str, Column], every: float, slab: float | None = None) -> DataFrame:
    """(key, time) and the last known values at each multiple of every from a key's first driving row to its last row.

    Rows of a tick's own time count. slab: so many units of time of a key's log are taken together.
    """
    span = log.groupBy(key).agg(F.min(F.when(driving, F.col(time))).alias("lo"), F.max(time).alias("hi"))
    spread = F.sequence(F.ceil(F.col("lo") / every), F.floor(F.col("hi") / every))
    ticks = span.where(F.ceil(F.col("lo") / every) <= F.floor(F.col("hi") / every)).select(key, F.explode(F.transform(spread, lambda k: k * every)).alias(time), F.lit(True).alias("_tick"))
    rows = log.select(key, time, order, F.lit(False).alias("_tick"), *(v.alias(f"_in_{n}") for n, v in values.items())).unionByName(ticks, allowMissingColumns=True)
    known = last_known(rows, key, [time, "_tick", order], {n: F.col(f"_in_{n}") for n in values}, None if slab is None else F.floor(F.col(time) / slab))
    return known.where("_tick").select(key, time, *values)


def at_ticks(log: DataFrame, key: str, time: str, order: str, topic: str, value: str, topics: list[str], every: float, slab: float | None = None) -> DataFrame:
    """Per key, ticks with the topics' latest values; none comes before the first row of topics[0], which drives the output."""
    return ticked(log, key, time, order, F.col(topic) == topics[0], {t: F.when(F.col(topic) == t, F.col(value)) for t in topics}, every, slab)
