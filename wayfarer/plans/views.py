"""The driver's tables seen as the engine's inputs; plain views, no further data."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.operators import scan

RESOLUTION = 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 64-float embedding as a scan of 64 beams; the label gives a speed."""
    e = table(spark, sf_dir, "embeddings")
    return scan.with_beams(e.select("vec_id", (F.col("label") / 10.0).alias("v"), F.transform("embedding", lambda x: F.abs(x.cast("double")) * 20).alias("ranges"), F.lit(-math.pi).alias("angle_min"), F.lit(2 * math.pi / 63).alias("angle_increment"), F.lit(0.1).alias("range_min"), F.lit(5.0).alias("range_max")))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as an 8 x 8 costmap."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("grid_id"), F.posexplode("embedding").alias("k", "x"))
    r = F.abs(F.col("x").cast("double")) * 20
    cost = F.when(r > 5.5, 255).when(r > 5, 254).when(r > 4.5, 253).otherwise(F.floor(r * 40)).cast("int")
    return e.select("grid_id", F.floor(F.col("k") / 8).cast("int").alias("row"), (F.col("k") % 8).cast("int").alias("col"), cost.alias("cost"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a topic log: user_id is the trial, t the seconds since 2024."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"), ((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 1e6).alias("t"), F.get_json_object("props", "$.k").cast("double").alias("k"))


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).select(F.col("user_id").alias("path_id"), F.struct("ts", "event_id").alias("i"), (F.col("value") / 100).alias("x"), (F.col("k") / 100).alias("y"))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as trial outcomes."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "SUCCESS").when(F.col("o_orderstatus") == "O", "COLLISION").otherwise("TIMEOUT")
    return o.select(F.col("o_orderkey").alias("trial_id"), F.col("o_custkey").alias("campaign"), status.alias("status"), F.col("o_totalprice").alias("path_length"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a robot's topics; a trial is a week of a user. Scans and costmaps are embeddings below 500, which all sizes have."""
    e = log(spark, sf_dir)
    topic = F.when(F.col("event_type") == "click", "scan").when(F.col("event_type") == "error", "odom").when(F.col("event_type") == "purchase", "pose").when(F.col("event_type") == "signup", "costmap").otherwise("plan")
    ref = F.when(F.col("event_type") == "click", F.col("event_id") % 500).when(F.col("event_type") == "signup", (F.col("event_id") * 3 + F.col("user_id")) % 500).otherwise(F.col("event_id"))
    trial = F.concat_ws("-", F.col("user_id").cast("string"), F.floor(F.col("t") / 604800).cast("string"))
    return e.select(trial.alias("trial"), "user_id", "ts", "t", "event_id", topic.alias("topic"), ref.alias("ref"), (F.col("value") / 50 - 1).alias("v"), (F.col("value") / 60 - 1).alias("x"), (F.col("k") / 25 - 0.5).alias("y"), (F.col("k") / 10).alias("early"), (F.col("k") / 10 + F.col("value") / 100).alias("late"))


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five poses, or two, for each plan of messages."""
    some = log(spark, sf_dir).where("event_type = 'view'").select("event_id", F.col("k").cast("long").alias("k"), F.explode(F.sequence(F.lit(0), F.when(F.col("event_id") % 11 == 0, 1).otherwise(4))).alias("i"))
    return some.select(F.col("event_id").alias("path_id"), "i", (F.col("i") * 0.5).alias("x"), (((F.col("i") * F.col("i") * F.col("k") + F.col("event_id")) % 7) / 10.0).alias("y"))
