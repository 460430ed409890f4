"""Stored waveforms: shapes of a package file's windows, and a join that leaves them where they are."""

from collections import Counter

from pyspark.sql import functions as F

from spindleflow.operators.staging import staged_in_buckets
from spindleflow.plans.ingest import WindowPlan, ingest_packages
from spindleflow.sources import tables


def test_windows_are_stored_with_their_samples(spark, tmp_path):
    x, y = [float(i) for i in range(16)], [i / 2 for i in range(16)]
    rows = [("t1", "1000", "16", "9000", str(x), str(y), "0"), ("t2", "1000", "16", "9000", str(x[::-1] + [])[:-1] + "]", str([float(i % 3) for i in range(16)]), "1")]
    df = spark.createDataFrame(rows, "timestamp string, fs string, numscans string, spindlespeed string, x_channel string, y_channel string, status string")
    df.coalesce(1).write.option("header", True).csv(f"{tmp_path}/in")
    windows = ingest_packages(spark, f"{tmp_path}/in", WindowPlan(0.008, 0.004, 0.02, 1.0, waveforms=True))
    tables.write_window_dataset(windows, f"{tmp_path}/out", 0.008, 0.004)
    stored = tables.read_window_dataset(spark, f"{tmp_path}/out").orderBy("window_id").collect()
    assert Counter(r.label for r in stored) == {"stable": 3, "slight": 3}
    assert all(len(r.sensor_window) == 8 and {len(s) for s in r.sensor_window} == {2} for r in stored)
    first = [r for r in stored if r.label == "stable"]
    assert [[s[0] for s in r.sensor_window] for r in first] == [x[0:8], x[4:12], x[8:16]]
    assert [[s[1] for s in r.sensor_window] for r in first] == [y[0:8], y[4:12], y[8:16]]
    assert "sensor_window" not in ingest_packages(spark, f"{tmp_path}/in", WindowPlan(0.008, 0.004, 0.02, 1.0)).columns


def test_bucketed_waveforms_are_not_exchanged(spark):
    wide = staged_in_buckets(spark.range(4_000).select(F.col("id").alias("window_id"), F.array_repeat(F.col("id"), 20).alias("sensor_window")), "window_id", 16)
    narrow = spark.range(4_000).select(F.col("id").alias("window_id"), (F.col("id") % 7).alias("label"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = narrow.join(wide, "window_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        assert joined.where("sensor_window[0] = window_id").count() == 4_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
