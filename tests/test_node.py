"""The streaming risk node against the operator on the stored log."""

import math

import pytest
from pyspark.sql import functions as F

from wayfarer.operators import risk
from wayfarer.plans import views
from wayfarer.streaming import node

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def messages(spark):
    """The log's messages with what their topics send; a robot is a user, its trials are weeks."""
    log = views.messages(spark, SF).withColumn("robot", F.col("user_id").cast("string"))
    scans = risk.of_scans(views.scans(spark, SF).withColumnRenamed("vec_id", "ref"), "ref").withColumn("topic", F.lit("scan"))
    data = F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "cost"))), lambda c: c["cost"])
    maps = views.cells(spark, SF).groupBy(F.col("grid_id").alias("ref")).agg(data.alias("data")).select("ref", F.lit("costmap").alias("topic"), F.lit(8).alias("size_x"), F.lit(8).alias("size_y"), F.lit(0.5).alias("resolution"), F.lit(-1.0).alias("origin_x"), F.lit(-0.5).alias("origin_y"), "data")
    at = F.array_sort(F.collect_list(F.struct("i", "x", "y")))
    plans = views.plans(spark, SF).groupBy(F.col("path_id").alias("ref")).agg(at.alias("p")).select("ref", F.lit("plan").alias("topic"), F.col("p.x").alias("px"), F.col("p.y").alias("py"))
    own = {"odom": ["v"], "pose": ["x", "y"]}
    common = ["robot", "trial", "ts", "event_id", "topic", "early", "late"]
    parts = [log.join(x, ["ref", "topic"]).select(*common, *(c for c in x.columns if c not in ("ref", "topic"))) for x in (scans, maps, plans)]
    parts += [log.where(F.col("topic") == k).select(*common, *c) for k, c in own.items()]
    return node.normalised(spark, parts)


def test_replayed_messages_give_the_stored_logs_states(spark, messages, tmp_path):
    # files by time, rows within them in no order; a last message far ahead moves the watermark over all ticks
    days = messages.withColumn("day", F.floor((F.unix_seconds("ts") - 1704067200) / 86400 / 4))
    for k, day in enumerate(sorted(r.day for r in days.select("day").distinct().collect())):
        days.where(F.col("day") == day).drop("day").orderBy(F.rand(k)).coalesce(1).write.parquet(f"{tmp_path}/in/{k:02d}")
    end = messages.limit(1).select(*(F.lit("end").alias(c) if c in ("robot", "trial") else F.lit("2025-06-01").cast("timestamp").alias(c) if c == "ts" else F.col(c) for c in messages.columns))
    end.coalesce(1).write.parquet(f"{tmp_path}/in/98")
    end.withColumn("ts", F.lit("2025-06-02").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/in/99")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", node.PROVIDER)
    try:
        for upto in (4, 100):  # a second run goes on from the checkpoint of the first
            folders = ",".join(f"{k:02d}" for k in [*range(8), 98, 99] if k < upto)
            stream = spark.readStream.schema(node.MESSAGE).parquet(f"{tmp_path}/in/{{{folders}}}")
            out = node.risk_states(stream, 21_600_000, 10.0)
            out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = spark.read.parquet(f"{tmp_path}/out").where("robot <> 'end'").withColumn("t", F.unix_seconds("ts") - 1704067200)
    scans = risk.of_scans(views.scans(spark, SF).withColumnRenamed("vec_id", "ref"), "ref")
    want = risk.states(views.messages(spark, SF), "trial", scans, risk.of_plans(views.plans(spark, SF)), views.cells(spark, SF), 21600.0, 10.0, views.RESOLUTION, (-1.0, -0.5))
    a, b = ({(r.trial, int(r.t)): (r.computed, *(r[c] for c in risk.TIERS)) for r in x.collect()} for x in (got, want))
    assert len(b) > 300 and set(a) == set(b)
    assert all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for k in b for x, y in zip(a[k], b[k], strict=True))
    assert got.count() == len(a)
