"""Machine-run folders: sensors, controller context, label intervals and metadata.

A reader takes one run folder or a folder of many; a run is named by the folder that holds its files. All files of one
kind have the same header.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindleflow.functions.physics import feed_from_mm_min
from spindleflow.operators.align import interpolate_context
from spindleflow.operators.scan import Layout
from spindleflow.operators.timebase import timebase_findings, timebase_summary
from spindleflow.sources.tables import in_file_order, label_intervals, read_rows, read_run_metadata


def run_of(path: str = "_path"):
    """Run name: the folder that holds the file."""
    return F.regexp_extract(F.col(path), r"([^/]+)/[^/]+$", 1)


def read_sensors(
    spark: SparkSession, folder: str, time: str = "time_s", channels: tuple[str, ...] = ("accel_x", "accel_y", "accel_z")
) -> DataFrame:
    rows = in_file_order(read_rows(spark, folder, "sensors.csv", one_header=True), "_n", _run=run_of())
    missing = [c for c in (time, *channels) if c not in rows.columns]
    if missing:
        raise ValueError(f"sensors.csv is missing columns {missing}")
    return rows.select(
        F.col("_run").alias("run"),
        (F.col("_n") - 1).alias("sample_idx"),
        F.col(time).cast("double").alias("time_s"),
        F.array(*[F.col(c).cast("double") for c in channels]).alias("ch"),
    )


def read_context(spark: SparkSession, folder: str, tools: DataFrame | None = None) -> DataFrame:
    """Spindle speed and feed per tooth; a feed in mm/min is converted with the flute count of the run's tool.

    ``tools`` holds run and flute_count; a run without a tool has 4.
    """
    rows = in_file_order(read_rows(spark, folder, "cnc_context.csv", one_header=True), "_n", _run=run_of()).withColumn("run", F.col("_run"))
    if "spindle_rpm" not in rows.columns or not {"feed_per_tooth_m", "feed_mm_min"} & set(rows.columns):
        raise ValueError("cnc_context.csv needs spindle_rpm and feed_per_tooth_m or feed_mm_min")
    rpm = F.col("spindle_rpm").cast("double")
    if "feed_per_tooth_m" in rows.columns:
        feed = F.col("feed_per_tooth_m").cast("double")
    else:
        flutes = F.lit(4.0)
        if tools is not None:
            rows = rows.join(tools.select("run", F.col("flute_count").alias("_flutes")), "run", "left")
            flutes = F.coalesce(F.col("_flutes").cast("double"), F.lit(4.0))
        feed = feed_from_mm_min(F.col("feed_mm_min").cast("double"), rpm, flutes)
    return rows.select(
        "run",
        (F.col("_n") - 1).alias("row"),
        F.col("time_s").cast("double").alias("time_s"),
        rpm.alias("spindle_rpm"),
        feed.alias("feed_per_tooth_m"),
    )


def align_run(sensors: DataFrame, context: DataFrame, span: float = 60.0) -> DataFrame:
    """Samples on their own clock starting at zero, with the context interpolated onto them."""
    origin = sensors.groupBy("run").agg(F.min_by("time_s", "sample_idx").alias("_t0"))
    shifted = sensors.join(origin, "run").withColumn("time_s", F.col("time_s") - F.col("_t0")).drop("_t0")
    moved = context.join(origin, "run").withColumn("time_s", F.col("time_s") - F.col("_t0")).drop("_t0")
    return interpolate_context(
        shifted, moved, ["spindle_rpm", "feed_per_tooth_m"], ("run",), "time_s", "sample_idx", span
    )


def inspect_run(sensors: DataFrame, context: DataFrame) -> DataFrame:
    """Validation rows (run, severity, message) of both clocks; a run without error rows is valid."""
    s = timebase_summary(sensors, Layout(("run",), "sample_idx", "sample_idx", 1_000_000.0), "time_s", ("run",))
    c = timebase_summary(context, Layout(("run",), "row", "row", 1_000_000.0), "time_s", ("run",))
    return timebase_findings(s, "sensor", ("run",)).unionByName(timebase_findings(c, "cnc", ("run",), 2).where("severity = 'error'"))


def read_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Label intervals of each run (run, start_time_s, end_time_s, label); a run without the file gets none."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "labels.csv").load(folder).select("path")
    if found.isEmpty():
        return spark.createDataFrame([], "run string, start_time_s double, end_time_s double, label string")
    return label_intervals(read_rows(spark, folder, "labels.csv", one_header=True), run_of().alias("run"))


def read_machine_run(spark: SparkSession, folder: str, span: float = 60.0) -> dict[str, DataFrame]:
    """The tables of all runs below a folder, keyed by ``run``: samples with context, label intervals on the same clock,
    metadata, findings."""
    metadata = read_run_metadata(spark, folder)
    sensors, context = read_sensors(spark, folder), read_context(spark, folder, metadata)
    origin = sensors.groupBy("run").agg(F.min_by("time_s", "sample_idx").alias("_t0"))
    moved = {n: F.col(n) - F.col("_t0") for n in ("start_time_s", "end_time_s")}
    labels = read_labels(spark, folder).join(origin, "run").withColumns(moved).drop("_t0")
    return {
        "samples": align_run(sensors, context, span),
        "labels": labels,
        "metadata": metadata,
        "findings": inspect_run(sensors, context),
    }
