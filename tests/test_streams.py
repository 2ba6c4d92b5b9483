"""Joins of streams and appends that happen once."""

import pytest
from pyspark.sql import functions as F

from wayfarer.operators import trials
from wayfarer.plans import catalog, views
from wayfarer.sources import sinks
from wayfarer.streaming import latest

SF = "/root/testdata/sf0.001"


def test_stream_join_gives_the_stored_logs_windows(spark, tmp_path):
    log = views.log(spark, SF).select(F.col("user_id").alias("trial"), "ts", "event_id", "event_type")
    windows = log.where("event_type = 'signup'").groupBy("trial").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"))
    log.repartition(3).write.parquet(f"{tmp_path}/rows")
    windows.repartition(2).write.parquet(f"{tmp_path}/windows")
    rows, nav = (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}") for df, name in ((log, "rows"), (windows, "windows")))
    out = latest.within_windows(rows, nav, "31 days", "40 days")
    latest.published(out, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert {r.event_id: round(r.since, 6) for r in got.collect()} == {r.event_id: r.since for r in catalog.QUERIES["p5_window_trim"](spark, SF).collect()}
    assert {r.event_id for r in got.where("event_type = 'view'").collect()} == {r.event_id for r in catalog.QUERIES["j10_replan_gate"](spark, SF).collect()} and got.count() == got.distinct().count()


def test_a_batch_that_runs_twice_is_appended_once(spark, tmp_path, monkeypatch):
    out, one = f"{tmp_path}/out", spark.createDataFrame([(1, 10, "SUCCESS"), (2, 10, "FAILED")], "trial_id long, timestamp long, status string")
    append = sinks.append_once(out)
    append(one, 0)
    append(one, 0)
    more = spark.createDataFrame([(2, 20, "SUCCESS", 1.5)], "trial_id long, timestamp long, status string, travel_time double")
    with monkeypatch.context() as m:  # the run ends between write and commit
        m.setattr(sinks, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            append(more, 1)
    assert sinks.committed(spark, out).count() == 2
    append(more, 1)
    append(more, 1)
    rows = {(r.trial_id, r.timestamp): (r.status, r.travel_time) for r in sinks.committed(spark, out).collect()}
    assert rows == {(1, 10): ("SUCCESS", None), (2, 10): ("FAILED", None), (2, 20): ("SUCCESS", 1.5)}
    assert {r.trial_id: r.status for r in trials.newest(sinks.committed(spark, out)).collect()} == {1: "SUCCESS", 2: "SUCCESS"}


def test_a_stream_restarted_from_its_checkpoint_appends_once(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k, k, "SUCCESS")], "trial_id long, timestamp long, status string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    for upto in (2, 3):
        source = spark.readStream.schema("trial_id long, timestamp long, status string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/[0-{upto - 1}]")
        source.writeStream.foreachBatch(sinks.append_once(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.trial_id for r in sinks.committed(spark, f"{tmp_path}/out").collect()) == [0, 1, 2]
