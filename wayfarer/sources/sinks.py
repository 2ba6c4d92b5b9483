"""Writers of experiment results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STATUSES = ("SUCCESS", "COLLISION", "TIMEOUT", "CANCELED", "FAILED", "PLANNING_FAILED", "UNKNOWN", "EXCEPTION")


def flat(trials: DataFrame, params: str = "params") -> DataFrame:
    """The params struct as columns param__<name>, dots as underscores; columns by name."""
    fields = [f.name for f in trials.schema[params].dataType]
    wide = trials.select(*(c for c in trials.columns if c != params), *(F.col(f"{params}.`{f}`").alias(f"param__{f}".replace(".", "_")) for f in fields))
    return wide.select(*sorted(wide.columns))


def append(trials: DataFrame, path: str) -> None:
    """Appends to the trial log; rows may bring new columns."""
    trials.write.mode("append").parquet(path)


def log(spark: SparkSession, path: str) -> DataFrame:
    """The trial log with the columns of all appends, by name."""
    found = spark.read.option("mergeSchema", True).parquet(path)
    return found.select(*sorted(found.columns))


def records(trials: DataFrame, samples: DataFrame, states: DataFrame, plans: DataFrame) -> DataFrame:
    """One nested record a trial: its columns, start and goal as poses, and its controller samples, risk states and plans in order of ts.

    States outside the trial's navigation window (t_nav_start to t_nav_end) are left out of the history, but counted.
    """
    own = [c for c in trials.columns if not c.startswith(("start_", "goal_")) and c not in ("t_nav_start", "t_nav_end", "goal_distance_remaining")]
    pose = lambda p: F.struct(*(F.col(f"{p}_{c}").alias(c) for c in ("x", "y", "yaw")))

    def listed(rows: DataFrame, name: str) -> DataFrame:
        rest = [c for c in rows.columns if c not in ("trial_id", "ts")]
        return rows.groupBy("trial_id").agg(F.sort_array(F.collect_list(F.struct("ts", *rest))).alias(name))

    head = trials.select(*own, "t_nav_start", "t_nav_end", pose("start").alias("initial_pose"), pose("goal").alias("goal_pose"), *(["goal_distance_remaining"] if "goal_distance_remaining" in trials.columns else []))
    for rows, name in ((samples, "path_with_controller"), (states, "risk_state_history"), (plans, "global_replan_history")):
        head = head.join(listed(rows, name), "trial_id", "left")
    counts = {"num_risk_samples": "risk_state_history", "num_controller_samples": "path_with_controller", "num_global_replans": "global_replan_history"}
    head = head.withColumns({n: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)) for n, c in counts.items()})
    within = F.filter("risk_state_history", lambda s: s["ts"].between(F.col("t_nav_start"), F.col("t_nav_end")))
    return head.withColumn("risk_state_history", within).drop("t_nav_start", "t_nav_end")


def details(records: DataFrame, path: str, files: int | None = None) -> None:
    """Nested records as JSON lines in ranges of trial_id, so that a trial is found by its file's range and files stay few."""
    n = [files] if files else []
    records.repartitionByRange(*n, "trial_id").sortWithinPartitions("trial_id").write.mode("append").json(path)


def checkpoint(trials: DataFrame, path: str, map_name: str) -> None:
    """How far a campaign got, as JSON."""
    done = trials.agg(F.coalesce(F.max("trial_id"), F.lit(0).cast("long")).alias("completed_trials"))
    done.withColumn("timestamp", F.current_timestamp()).withColumn("map", F.lit(map_name)).write.mode("overwrite").json(path)


def summary(trials: DataFrame) -> DataFrame:
    other = F.count_if(F.col("status").isNull() | ~F.col("status").isin(*STATUSES)).alias("other")
    return trials.agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES), other)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Ids 0 to n - 1 in the given order. Designs and pose pairs are some thousand rows, so one task numbers them."""
    return rows.withColumn("id", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))


def export(rows: DataFrame, order: list[str], path: str) -> None:
    """JSON rows, numbered."""
    numbered(rows, order).write.mode("overwrite").json(path)


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def committed_ids(spark: SparkSession, path: str) -> DataFrame:
    """The ids of the batches that append_once has committed."""
    return spark.read.schema("batch long").json(f"{path}/commits/*") if _there(spark, f"{path}/commits") else spark.createDataFrame([], "batch long")


def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends each batch of trial records once, however often it is run.

    A batch's rows go to a folder of its id, which a second run overwrites, and count once the id is in the list of commits; a run
    that ends between the two leaves nothing that committed reads. Batches may have further columns.
    """

    def run(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        if _there(spark, f"{path}/commits/{batch}/_SUCCESS"):
            return
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
        commit(spark, path, batch)

    return run


def commit(spark: SparkSession, path: str, batch: int) -> None:
    spark.range(1).select(F.lit(batch).cast("long").alias("batch")).write.mode("overwrite").json(f"{path}/commits/{batch}")


def committed(spark: SparkSession, path: str) -> DataFrame:
    """All rows of committed batches, of all columns that any batch has; trials.newest keeps the last row of each trial."""
    ids = [r.batch for r in committed_ids(spark, path).collect()]  # a number a batch
    rows = spark.read.option("mergeSchema", "true").parquet(f"{path}/rows")
    return rows.where(F.col("batch").isin(ids)).drop("batch")
