"""The risk node as a stream: the latest messages of a robot as state, a feature vector at each tick of event time.

A tick is a timer: it fires when the watermark has passed it, so all messages up to it are there, in any order
of arrival. Messages wait in a list until a tick takes them. State is cleared where a trial ends and another begins, and
when nothing has come for a while. The operator risk.states gives the same rows from a stored log.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wayfarer.operators import risk, scan
from wayfarer.operators.risk import TIERS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SCAN = ("r_min", "ahead", "r_vis", "r_width", "r_clear")
_STATES = {
    "scan": ", ".join(f"{c} double" for c in _SCAN), "odom": "v double", "pose": "x double, y double", "plan": "r_curve double",
    "costmap": "size_x int, size_y int, resolution double, origin_x double, origin_y double, data array<int>", "cycle": "early double, late double",
}
#: A message, normalised: the columns of other topics are null.
MESSAGE = "robot string, trial string, ts timestamp, event_id long, topic string, " + ", ".join(x for k, x in _STATES.items() if k != "plan") + ", px array<double>, py array<double>"
_FIELDS = [x.split()[0] for x in MESSAGE.split(", ")]
OUTPUT = "robot string, trial string, ts timestamp, computed int, took double, " + ", ".join(f"{c} double" for c in TIERS)


def scans(messages: DataFrame) -> DataFrame:
    """Scan messages as the topic sends them, with their features in place of their beams."""
    beams = scan.with_beams(messages.withColumn("ranges", F.transform("ranges", lambda r: r.cast("double"))))
    return beams.select("robot", "trial", "ts", "event_id", F.lit("scan").alias("topic"), scan.r_min().alias("r_min"), scan.ahead().alias("ahead"), scan.r_vis().alias("r_vis"), scan.r_width().alias("r_width"), scan.r_clear().alias("r_clear"))


def normalised(spark: SparkSession, topics: list[DataFrame]) -> DataFrame:
    """One stream of messages from the topics' own, whose further columns are null."""
    out = None
    for rows in topics:
        full = rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], MESSAGE).schema))
        out = full if out is None else out.unionByName(full)
    return out


def curvature(x: np.ndarray, y: np.ndarray, horizon: float = 3.0) -> float:
    """The greatest curvature of a plan's poses within the horizon, 0 for fewer than three."""
    if len(x) < 3:
        return 0.0
    dx, dy = np.diff(x), np.diff(y)
    size = np.hypot(dx, dy)
    a, b = size[:-1], size[1:]
    cross = np.abs(dx[:-1] * dy[1:] - dy[:-1] * dx[1:])
    good = (a > 1e-6) & (b > 1e-6)
    bend = np.where(good, 2 * cross / np.where(good, a * b * (a + b) / 2, 1.0), 0.0)
    return float(bend[np.cumsum(size)[:-1] <= horizon].max(initial=0.0))


def density_and_gradient(costmap: tuple, x: float, y: float, radius: float) -> tuple[float, float]:
    """Share of lethal cells around a position and the gradient at it, 0 off the map."""
    w, h, resolution, left, low, data = costmap
    cost = np.asarray(data, float).reshape(h, w)
    col, row, reach = int((x - left) / resolution), int((y - low) / resolution), int(radius / resolution)
    window = cost[max(0, row - reach) : max(0, row + reach + 1), max(0, col - reach) : max(0, col + reach + 1)]
    if not (0 <= row < h and 0 <= col < w):
        return float((window == 254).mean()) if window.size else 0.0, 0.0
    gx = (cost[row, col + 1] - cost[row, col - 1]) / 2 if 0 < col < w - 1 else 0.0
    gy = (cost[row + 1, col] - cost[row - 1, col]) / 2 if 0 < row < h - 1 else 0.0
    return float((window == 254).mean()), float(np.hypot(gx, gy)) / resolution


class Node(StatefulProcessor):
    def __init__(self, every_ms: int, budget: float, radius: float = 2.0, idle_ms: int = 7 * 86_400_000) -> None:
        self.every, self.budget, self.radius, self.idle = every_ms, budget, radius, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", MESSAGE)
        self.topics = {k: handle.getValueState(k, v) for k, v in _STATES.items()}
        self.features = handle.getValueState("features", ", ".join(f"{c} double" for c in TIERS))
        self.clock = handle.getValueState("clock", "tick long, trial string, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for some in rows:
            plain = some[_FIELDS].astype(object).where(some[_FIELDS].notna(), None)
            self.waiting.appendList([tuple(map(_value, _FIELDS, r)) for r in plain.itertuples(index=False, name=None)])
            if not self.clock.exists():
                first = _ms(some["ts"].min())
                self.clock.update((-(-first // self.every) * self.every, None, first))
        self.handle.registerTimer(self.clock.get()[0])
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        (tick, trial, last), now = self.clock.get(), timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get(), key=lambda r: (_ms(r[2]), r[3]))
        if not rows and expiredTimerInfo.getExpiryTimeInMs() >= last + self.idle:
            self._forget([*self.topics.values(), self.features, self.clock])
            yield pd.DataFrame()
            return
        at, out = 0, []
        while tick <= now:
            while at < len(rows) and _ms(rows[at][2]) <= tick:
                if rows[at][1] != trial:
                    self._forget([*self.topics.values(), self.features])
                    trial = rows[at][1]
                last = _ms(rows[at][2])
                self._take(rows[at])
                at += 1
            going = at < len(rows) and rows[at][1] == trial
            if going or last == tick:
                out += self._cycle(key[0], trial, tick)
                tick += self.every
            elif at < len(rows):  # the next trial's first tick
                tick = -(-_ms(rows[at][2]) // self.every) * self.every
            else:  # what comes next says if the trial goes on
                break
        self.waiting.put(rows[at:]) if at < len(rows) else self.waiting.clear()
        self.clock.update((tick, trial, last))
        self.handle.registerTimer(tick if at < len(rows) else last + self.idle)
        yield pd.DataFrame(out, columns=[x.split()[0] for x in OUTPUT.split(", ")]) if out else pd.DataFrame()

    def close(self) -> None:
        pass

    def _forget(self, states: list) -> None:
        for s in states:
            s.clear()

    def _take(self, row: tuple) -> None:
        r = dict(zip(_FIELDS, row, strict=True))
        if r["topic"] == "plan":
            self.topics["plan"].update((curvature(np.array(r["px"], float), np.array(r["py"], float)),))
        else:
            self.topics[r["topic"]].update(tuple(r[x.split()[0]] for x in _STATES[r["topic"]].split(", ")))
        if r["early"] is not None:
            self.topics["cycle"].update((r["early"], r["late"]))

    def _cycle(self, robot: str, trial: str, tick: int) -> list[tuple]:
        seen = {k: s.get() if s.exists() else None for k, s in self.topics.items()}
        if seen["scan"] is None:
            return []
        (v,), (x, y), (curve,), (early, late) = (seen[k] or z for k, z in (("odom", (0.0,)), ("pose", (0.0, 0.0)), ("plan", (0.0,)), ("cycle", (0.0, 0.0))))
        own = dict(zip(_SCAN, seen["scan"], strict=True))
        ahead = own.pop("ahead")
        own["r_ttc"] = 100.0 if abs(v) < 0.01 or v < 0 or ahead is None else min(ahead / v, 100.0)
        own["r_dens"], own["r_grad"] = density_and_gradient(seen["costmap"], x, y, self.radius) if seen["costmap"] else (0.0, 0.0)
        own["r_curve"] = curve
        due = (True, early < 0.5 * self.budget, late < 0.8 * self.budget)
        before = dict(zip(TIERS, self.features.get() if self.features.exists() else [0.0] * len(TIERS), strict=True))
        state = {c: own[c] if due[tier] else before[c] for c, tier in TIERS.items()}
        self.features.update(tuple(state.values()))
        return [(robot, trial, pd.Timestamp(tick, unit="ms", tz="UTC"), sum(due[tier] for tier in TIERS.values()), late, *state.values())]


def _ms(at: object) -> int:
    return pd.Timestamp(at).value // 1_000_000 if not isinstance(at, pd.Timestamp) or at.tz is not None else at.tz_localize("UTC").value // 1_000_000


def _value(name: str, x: object) -> object:
    if isinstance(x, np.ndarray):
        return x.tolist()
    if x is not None and name in ("event_id", "size_x", "size_y"):  # pandas has them as floats where some are null
        return int(x)
    return x.to_pydatetime() if isinstance(x, pd.Timestamp) else x


def risk_states(messages: DataFrame, every_ms: int, budget: float, late: str = "1 hour", radius: float = 2.0, idle_ms: int = 7 * 86_400_000) -> DataFrame:
    """Feature vectors of a stream of normalised messages. The session's state store must be RocksDB's (PROVIDER)."""
    keyed = messages.withWatermark("ts", late).groupBy("robot")
    return keyed.transformWithStateInPandas(statefulProcessor=Node(every_ms, budget, radius, idle_ms), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
