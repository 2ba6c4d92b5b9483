"""Readers of experiment files; all go through Spark, so that any store it knows will do."""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POSE = "struct<x: double, y: double, yaw: double>"
PAIRS = f"id long, start {POSE}, goal {POSE}, distance double"


@dataclasses.dataclass(frozen=True)
class Settings:
    """Settings of a campaign."""

    num_trials: int = 3000
    trial_timeout_sec: float = 180.0
    cooldown_sec: float = 3.0
    min_goal_distance: float = 3.0
    max_goal_distance: float = 15.0
    max_consecutive_failures: int = 10

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Settings:
        """Those of a YAML file that this class knows; a campaign's file has others too."""
        known = {f.name for f in dataclasses.fields(cls)}
        return cls.of({k: v for k, v in mapping(spark, path).items() if k in known})

    @classmethod
    def of(cls, values: dict) -> Settings:
        if unknown := sorted(set(values) - {f.name for f in dataclasses.fields(cls)}):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return cls(**values)


def mapping(spark: SparkSession, path: str) -> dict:
    """One small YAML file, read through Spark from any store."""
    import yaml  # only here: not everywhere at hand

    return yaml.safe_load(spark.read.text(path, wholetext=True).first()[0]) or {}


def map_meta(spark: SparkSession, path: str) -> dict:
    """resolution, origin, negate, occupied_thresh and image of a map's YAML file; image is a path beside it."""
    found = {"negate": 0, "occupied_thresh": 0.65} | mapping(spark, path)
    if missing := sorted({"resolution", "origin", "image"} - set(found)):
        raise ValueError(f"map without {', '.join(missing)}")
    return found | {"image": found["image"] if found["image"].startswith("/") or "://" in found["image"] else f"{path.rsplit('/', 1)[0]}/{found['image']}"}


def pose_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAIRS).option("multiLine", True).json(path)


def configs(spark: SparkSession, path: str, config_ddl: str) -> DataFrame:
    """Configurations that are wrapped ({id, config}) or bare; columns id and config."""
    bare = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.createDataFrame([], f"c {config_ddl}").schema["c"].dataType)
    raw = spark.read.schema(f"id long, config {config_ddl}, {bare}").option("multiLine", True).json(path)
    names = [f.name for f in spark.createDataFrame([], f"c {config_ddl}").schema["c"].dataType]
    return raw.select("id", F.coalesce("config", F.struct(*names)).alias("config"))


def trials_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The trial log as written by Python, whose inf and nan must be named."""
    return spark.read.schema(schema).options(header=True, positiveInf="inf", negativeInf="-inf", nanValue="nan", enforceSchema=False).csv(path)


def typed_trials(trials: DataFrame, measures: list[str]) -> DataFrame:
    """NULL instead of a stand-in number where a trial that failed early has no measure."""
    early = F.col("status").isin("PLANNING_FAILED", "EXCEPTION")
    return trials.withColumns({c: F.when(~early, F.col(c)) for c in measures})


def completed(trials: DataFrame) -> DataFrame:
    return trials.agg(F.coalesce(F.max("trial_id"), F.lit(0).cast("long")).alias("completed_trials"))


def resumed(spark: SparkSession, path: str) -> int:
    """Trials completed by the checkpoint at path."""
    return spark.read.schema("completed_trials long").json(path).first()[0]


def near_frames(frames: DataFrame, pattern: str) -> DataFrame:
    return frames.where(F.col("frame").rlike(pattern)).select("frame").distinct().orderBy("frame")


def decode_pgm(content: bytes) -> np.ndarray:
    """Grey values of a binary (P5) or plain (P2) greymap of 8 bits."""
    head = re.match(rb"(P[25])(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)\s", content)
    if not head or int(head[4]) > 255:
        raise ValueError("not an 8-bit greymap")
    w, h, body = int(head[2]), int(head[3]), content[head.end() :]
    flat = np.frombuffer(body, np.uint8, w * h) if head[1] == b"P5" else np.array(body.split()[: w * h], np.uint8)
    return flat.reshape(h, w)


def map_cells(spark: SparkSession, path: str) -> DataFrame:
    """(map_id, row, col, pixel) of all greymaps below path; map_id is the file's path."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                pixels = decode_pgm(content)
                row, col = np.indices(pixels.shape)
                yield pd.DataFrame({"map_id": name, "row": row.ravel(), "col": col.ravel(), "pixel": pixels.ravel().astype(np.int16)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cells, "map_id string, row int, col int, pixel short")


def image_cells(spark: SparkSession, path: str) -> DataFrame:
    """(map_id, row, col, pixel) of PNG and other images that Spark's image source reads; colours become grey by luma."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, h, w, n, data in batch.itertuples(index=False):
                bands = np.frombuffer(data, np.uint8).reshape(h, w, n).astype(np.int64)
                # blue, green, red; fixed weights of ITU-R 601 luma in 16 bits
                grey = bands[..., 0] if n == 1 else (bands[..., 2] * 19595 + bands[..., 1] * 38470 + bands[..., 0] * 7471 + 32768) >> 16
                row, col = np.indices(grey.shape)
                yield pd.DataFrame({"map_id": name, "row": row.ravel(), "col": col.ravel(), "pixel": grey.ravel().astype(np.int16)})

    found = spark.read.format("image").load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    return found.mapInPandas(cells, "map_id string, row int, col int, pixel short")


def first_populated(cells: DataFrame, order: str) -> DataFrame:
    """Per grid_id the first snapshot, by order, that has a known cell; of a grid that never has one the last."""
    known = cells.groupBy("grid_id", order).agg(F.bool_or(F.col("cost") != 255).alias("known"))
    first = known.groupBy("grid_id").agg(F.coalesce(F.min(F.when(F.col("known"), F.col(order))), F.max(order)).alias(order))
    return cells.join(first, ["grid_id", order])


def occupied(cells: DataFrame, meta: dict, height: int) -> DataFrame:
    """Centres of occupied cells by the map server's rule, which negate turns round."""
    share = F.col("pixel") / 255.0 if meta["negate"] else (255 - F.col("pixel")) / 255.0
    ox, oy, res = meta["origin"][0], meta["origin"][1], meta["resolution"]
    return cells.where(share >= meta["occupied_thresh"]).select("map_id", (ox + (F.col("col") + 0.5) * res).alias("x"), (oy + (height - 0.5 - F.col("row")) * res).alias("y"))


def corner_of(row: str, col: str, meta: dict, height: int) -> list:
    """World coordinates of a pixel's corner, the sampler's convention."""
    return [(meta["origin"][0] + F.col(col) * meta["resolution"]).alias("x"), (meta["origin"][1] + (height - F.col(row)) * meta["resolution"]).alias("y")]
