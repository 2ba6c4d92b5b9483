"""Streaming twins of the log operators, on event time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RISK = ("r_min", "r_width", "r_ttc", "r_dens", "r_clear", "r_curve", "r_grad", "r_vis")


def events(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """A file stream; ts becomes a timestamp with zone, which watermarks ask for."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


#: Topics by name, as their messages are stored.
TOPICS = {
    "scan": "key string, ts timestamp, angle_min double, angle_max double, angle_increment double, range_min double, range_max double, ranges array<float>",
    "odom": "key string, ts timestamp, vx double",
    "pose": "key string, ts timestamp, x double, y double, qx double, qy double, qz double, qw double",
    "costmap": "key string, ts timestamp, size_x int, size_y int, resolution double, origin_x double, origin_y double, data array<short>",
    "plan": "key string, ts timestamp, poses array<struct<x: float, y: float, yaw: float>>",
}


def topic(spark: SparkSession, name: str, path: str, files: int = 100) -> DataFrame:
    """The stream of a topic's messages below path."""
    return spark.readStream.schema(TOPICS[name]).option("maxFilesPerTrigger", files).parquet(path)


def published(rows: DataFrame, path: str, checkpoint: str, mode: str = "append", **trigger: object) -> StreamingQuery:
    """Starts writing a stream as Parquet files, each row once; trigger: as DataStreamWriter.trigger takes it."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(**(trigger or {"availableNow": True})).start()


def risk_messages(states: DataFrame) -> DataFrame:
    """Risk states by name as messages (ts, data) of eight numbers in fixed order; well_formed reads them."""
    return states.select("ts", F.array(*(F.col(n).cast("double") for n in RISK)).alias("data"))


def latest_values(log: DataFrame, topics: list[str], key: str = "user_id") -> DataFrame:
    """For each row the latest value of each topic of its key, from state that holds one value a topic.

    Rows of a micro-batch are taken in order of ts and event_id; a row older than the state doesn't turn it back.
    """
    names = ", ".join(f"last_{t} double" for t in topics)

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else [None] * (2 * len(topics))
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], ignore_index=True)
        at = rows["ts"].astype("int64").to_numpy() / (1e3 if rows["ts"].dtype.name.startswith("datetime64[ns") else 1.0)
        out = {"event_id": rows["event_id"].to_numpy()}
        for k, t in enumerate(topics):
            value, since = held[2 * k : 2 * k + 2]
            own = (rows["event_type"] == t).to_numpy() & (at >= (since if since is not None else -np.inf))
            seen = pd.Series(np.where(own, rows["value"].to_numpy(float), np.nan)).ffill()
            out[f"last_{t}"] = seen.fillna(value).to_numpy(float) if value is not None else seen.to_numpy(float)
            if own.any():
                held[2 * k : 2 * k + 2] = float(rows["value"].to_numpy(float)[own][-1]), float(at[own][-1])
        state.update(tuple(held))
        yield pd.DataFrame(out)

    kept = ", ".join(f"v{k} double, t{k} double" for k in range(len(topics)))
    return log.groupBy(key).applyInPandasWithState(step, f"event_id long, {names}", kept, "append", GroupStateTimeout.NoTimeout)


def timing(log: DataFrame, every: str = "5 seconds", late: str = "1 hour", budget: float = 10.0) -> DataFrame:
    """Timing statistics of closed windows; the level comes from the 99th percentile and the budget."""
    p99 = F.percentile("value", 0.99)
    level = F.when(p99 < 0.5 * budget, "OK").when(p99 < budget, "WARN").otherwise("ERROR")
    stats = log.withWatermark("ts", late).groupBy(F.window("ts", every)).agg(F.count("*").alias("cycles"), F.avg("value").alias("mean"), F.percentile("value", 0.95).alias("p95"), p99.alias("p99"), F.max("value").alias("worst"), level.alias("level"))
    return stats.select(F.col("window.start").alias("started"), *stats.columns[1:])


def malformed(messages: DataFrame) -> DataFrame:
    """How many messages well_formed drops, per arity (-1: no data)."""
    arity = F.coalesce(F.size("data"), F.lit(-1))
    return messages.where(arity != len(RISK)).groupBy(arity.alias("arity")).agg(F.count("*").alias("rejected"))


def well_formed(messages: DataFrame) -> DataFrame:
    """Risk messages of the right arity, by name; others are dropped."""
    return messages.where(F.size("data") == len(RISK)).select("ts", *(F.col("data")[k].alias(n) for k, n in enumerate(RISK)))


def ticks(first: str, last: str, spark: SparkSession, milliseconds: int = 100) -> DataFrame:
    """Fixed-rate ticks on event time."""
    return spark.sql(f"select explode(sequence(timestamp'{first}', timestamp'{last}', interval {milliseconds} milliseconds)) as ts")


def within_windows(rows: DataFrame, windows: DataFrame, longest: str, late: str = "1 hour", key: str = "trial") -> DataFrame:
    """Rows (key, ts and others) within their trial's navigation window (key, started, ended), with the seconds since it started.

    Both streams have watermarks, and a window is at most `longest`, so a row waits no longer for its window, nor a window
    for its rows, than that and what comes late; then Spark drops them.
    """
    windows = windows.select(F.col(key).alias("_key"), "started", "ended").withWatermark("ended", late)
    near = (F.col(key) == F.col("_key")) & (F.col("ts") >= F.col("started")) & (F.col("ts") <= F.col("ended")) & (F.col("ts") >= F.col("ended") - F.expr(f"interval {longest}"))
    since = (F.unix_micros("ts") - F.unix_micros("started")) / 1e6
    return rows.withWatermark("ts", late).join(windows, near).select(*rows.columns, since.alias("since"))
