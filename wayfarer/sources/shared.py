"""Written intermediate tables in the folder that a cluster's machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir. Without that setting a local session gets a root of its own; a cluster raises ValueError."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = getattr(spark, "_wayfarer_root", None) or f"file://{tempfile.mkdtemp(prefix='wayfarer-')}"
        spark._wayfarer_root = root
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet below the shared folder and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
