"""Live feature windows, context enrichment and alert burden; recommendations are in ``event_order``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindleflow.session import shared_folder
from spindleflow.sources.tables import fresh_path


def feature_windows(
    stream: DataFrame, keys: list[str], value: str, size: str, slide: str | None = None, delay: str = "10 minutes", ts: str = "ts"
) -> DataFrame:
    """Sliding (or tumbling) event-time windows: count, RMS, peak.  Works on a stream and on a batch alike."""
    span = F.window(ts, size, slide) if slide else F.window(ts, size)
    return (
        stream.withWatermark(ts, delay)
        .groupBy(*keys, span.alias("w"))
        .agg(
            F.count(F.lit(1)).alias("samples"),
            F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"),
            F.max(F.abs(value)).alias("peak"),
        )
        .select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "samples", "rms", "peak")
    )


def session_features(stream: DataFrame, keys: list[str], value: str, gap: str, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """The same features per run session, split where the signal pauses longer than ``gap``."""
    return (
        stream.withWatermark(ts, delay)
        .groupBy(*keys, F.session_window(ts, gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("samples"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))
        .select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "samples", "rms")
    )


def enrich(
    samples: DataFrame, context: DataFrame, key: str, sample_id: str, columns: list[str], bound: str, delay: str = "10 minutes"
) -> DataFrame:
    """Latest context row at most ``bound`` before each sample; NULL columns where there is none.

    A stream-stream interval join with watermarks on both sides, then one row per sample; state is bounded by
    ``bound`` plus the delay. A sample without context leaves the join once the watermark rules a match out.
    """
    left = samples.select(F.col(key), F.col(sample_id), F.col("ts")).withWatermark("ts", delay).alias("s")
    right = context.select(F.col(key), F.col("ts").alias("context_ts"), *columns).withWatermark("context_ts", delay).alias("c")
    joined = left.join(
        right,
        (F.col(f"s.{key}") == F.col(f"c.{key}"))
        & (F.col("c.context_ts") <= F.col("s.ts"))
        & (F.col("c.context_ts") >= F.col("s.ts") - F.expr(f"INTERVAL {bound}")),
        "left",
    )
    latest = F.max_by(F.struct(*columns), F.col("context_ts"))
    return (
        joined.groupBy(F.col(f"s.{key}").alias(key), F.col(sample_id), F.window("ts", "1 second"))
        .agg(latest.alias("_c"))
        .select(key, sample_id, "_c.*")
    )


def rolling_burden(recs: DataFrame, size: str, slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Warnings and actions per event-time window."""
    span = F.window("ts", size, slide) if slide else F.window("ts", size)
    acting = (F.abs(F.col("feed_override") - 1.0) > 1e-9) | (F.abs(F.col("spindle_override") - 1.0) > 1e-9)
    return (
        recs.withWatermark("ts", delay)
        .groupBy(span.alias("w"))
        .agg(
            F.count(F.lit(1)).alias("windows"),
            F.count(F.when(F.col("shadow_warning"), 1)).alias("warning_windows"),
            F.count(F.when(acting, 1)).alias("action_windows"),
        )
        .select(F.col("w.start").alias("window_start"), "windows", "warning_windows", "action_windows")
    )


def drain(stream: DataFrame, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Run a stream over everything available and return what it wrote to the shared folder.

    Without ``keys`` rows are appended by the file sink with its exactly-once log. With ``keys`` the stream runs in
    update mode: every batch is kept under its number (a repeated batch replaces itself), and of each key the row of
    the latest batch counts.
    """
    spark = stream.sparkSession
    base = fresh_path(shared_folder(spark), name)
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if not keys:
        writer.outputMode("append").format("parquet").option("path", f"{base}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/rows")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    writer.outputMode("update").foreachBatch(keep).start().awaitTermination()
    kept = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{base}/rows")
    latest = F.max_by(F.struct(*stream.columns), F.col("batch")).alias("_row")
    return kept.groupBy(*keys).agg(latest).select("_row.*")
