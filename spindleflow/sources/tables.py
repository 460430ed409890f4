"""Typed scans of owned tables, run folders and intervals, and the sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindleflow.functions.labels import status_to_label, vote_to_label
from spindleflow.functions.physics import feed_from_inch_min, first_number, flute_count, inch_to_m
from spindleflow.operators.scan import Running, scan, with_position
from spindleflow.operators.staging import staged
from spindleflow.schema import RUN_METADATA_SCHEMA, SCHEMA_VERSION, WINDOW_SCHEMA


def read_windows(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType = WINDOW_SCHEMA) -> DataFrame:
    """The window table with its declared types; CSV columns are matched by header position."""
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def stem(path: Column) -> Column:
    """File name without directory and extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def read_rows(spark: SparkSession, path: str, pattern: str = "*.csv", one_header: bool = False) -> DataFrame:
    """All CSV files below a folder as text columns, with ``_path`` and the row's place in its file.

    With ``one_header`` a file whose header differs from the first one's fails instead of being read by position.
    """
    rows = (
        spark.read.option("header", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .option("maxCharsPerColumn", -1)
        .option("maxColumns", 100_000)
        .option("enforceSchema", not one_header)
        .csv(path)
    )
    return rows.select(
        "*",
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )


def in_file_order(rows: DataFrame, name: str, **of_path: Column) -> DataFrame:
    """1-based row number inside each file, for rows as ``read_rows`` gives them (filters may lie between).

    ``of_path`` are further columns made from ``_path`` alone, worked out once a block: patterns over long paths cost more
    than all else that is done with a short row.

    A task reads a block of a file in one go, so a row's number counts from the block's first row, and only the blocks,
    a row each, are ordered. The rows are staged: files are parsed once, and rows are neither exchanged nor sorted.
    """
    held = staged(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    blocks = held.groupBy("_path", "_block").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy("_path").orderBy("_block")) - F.col("_rows")
    shifts = staged(blocks.select("_path", "_block", (before - F.col("_first") + 1).alias("_shift"), *[c.alias(n) for n, c in of_path.items()]), "file-blocks")
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in ("_block", "_row")]
    return held.join(shifts, ["_path", "_block"]).select(*kept, (F.col("_row") + F.col("_shift")).alias(name), *of_path)


def discover_files(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """Files below a folder with size and the attributes written in their directories (contents are not read)."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(path)
        .select("path", "length")
    )
    return files.select(
        "path",
        "length",
        stem(F.col("path")).alias("scenario"),
        F.regexp_extract("path", r"/(M\d+)/(OP\d+)/(good|bad)/", 1).alias("machine"),
        F.regexp_extract("path", r"/(M\d+)/(OP\d+)/(good|bad)/", 2).alias("operation"),
        F.regexp_extract("path", r"/(M\d+)/(OP\d+)/(good|bad)/", 3).alias("quality"),
    )


def read_triaxial(spark: SparkSession, path: str, rate: float) -> DataFrame:
    """x, y, z sample files in M*/OP*/{good,bad} folders as the sample table."""
    parts = r"/(M\d+)/(OP\d+)/(good|bad)/"
    rows = in_file_order(
        read_rows(spark, path), "_n",
        _scenario=F.concat_ws("_", F.regexp_extract("_path", parts, 1), F.regexp_extract("_path", parts, 2)),
        _quality=F.regexp_extract("_path", parts, 3),
    )
    missing = {"x", "y", "z"} - set(rows.columns)
    if missing:
        raise ValueError(f"triaxial files are missing columns {sorted(missing)}")
    return rows.select(
        F.col("_scenario").alias("scenario"),
        F.col("_path").alias("recording"),
        F.col("_quality").alias("quality"),
        (F.col("_n") - 1).alias("sample_idx"),
        ((F.col("_n") - 1) / F.lit(rate)).alias("time_s"),
        F.array(*[F.col(c).cast("double") for c in ("x", "y", "z")]).alias("ch"),
    )


def read_controller_hf(spark: SparkSession, path: str, columns: tuple[str, ...], rate: float) -> DataFrame:
    """Selected controller signals (names may contain ``|``); rows with a non-numeric value are dropped."""
    raw = read_rows(spark, path)
    missing = [c for c in columns if c not in raw.columns]
    if missing:
        raise ValueError(f"controller files are missing signal columns {missing}")
    values = [F.col(f"`{c}`").try_cast("double") for c in columns]
    rows = raw.select("_path", "_block", "_row", F.array(*values).alias("ch")).where(
        ~F.exists("ch", lambda v: v.isNull())
    )
    ranked = in_file_order(rows, "_n", _recording=stem(F.col("_path")))
    return ranked.select(
        F.col("_recording").alias("recording"),
        (F.col("_n") - 1).alias("sample_idx"),
        ((F.col("_n") - 1) / F.lit(rate)).alias("time_s"),
        "ch",
    )


# Section titles of the trial sheet, and its columns with their alternative names.
SHEET_SECTIONS = ("Thermoforming mold", "Injection mold", "Impeller")
SHEET_COLUMNS = {
    "comment": ("Comment",),
    "nc_code": ("NC-Code",),
    "spindle_rpm": ("Spindle Speed [U/min]",),
    "feedrate_mm_min": ("Feedrate [mm/min]",),
    "feed_per_tooth_mm": ("fz [mm]",),
    "teeth": ("Number of teeth",),
    "axial_depth_mm": ("Cutting depth [mm]", "Optimal Cutting depth [mm]"),
    "overlap_mm": ("Overlap [mm]", "Optimal Overlap [mm]"),
    "material": ("Material",),
    "tool": ("Tools",),
}


def read_trial_sheet(rows: DataFrame, cells: str = "cells", place: str = "row") -> DataFrame:
    """Sectioned sheet (title row, header row, data rows) as one table; ``rows`` holds text cells and a row number."""
    first = F.trim(F.coalesce(F.get(F.col(cells), F.lit(0)), F.lit("")))
    # A title resets the header, so both are carried as the last title and the last header after it.
    header = F.when(first == "Trial", F.struct(F.col(place).alias("at"), F.col(cells).alias("names")))
    title = F.when(first.isin(*SHEET_SECTIONS), F.struct(F.col(place).alias("at"), first.alias("component")))
    filled = scan(
        rows.withColumn("_first", first),
        [],
        F.floor(F.col(place) / 4096).cast("long"),
        [place],
        {"_title": Running("last", title), "_header": Running("last", header)},
    )
    data = filled.where(
        (F.col("_first") != "") & (F.col("_first") != "Trial") & ~F.col("_first").isin(*SHEET_SECTIONS)
        & F.col("_title").isNotNull() & (F.col("_header.at") > F.col("_title.at"))
    )
    width = F.least(F.size("_header.names"), F.size(cells))
    named = F.map_from_entries(
        F.filter(
            F.arrays_zip(
                F.slice("_header.names", F.lit(1), width).alias("k"), F.slice(cells, F.lit(1), width).alias("v")
            ),
            lambda p: F.coalesce(p["k"], F.lit("")) != "",
        )
    )
    table = data.withColumn("_m", named)

    def text(name: str) -> Column:
        options = [F.nullif(F.trim(F.element_at("_m", F.lit(c))), F.lit("")) for c in SHEET_COLUMNS[name]]
        return F.coalesce(*options) if len(options) > 1 else options[0]

    def positive(name: str, default: float) -> Column:
        number = text(name).try_cast("double")
        return F.when(number > 0, number).otherwise(default)

    return table.select(
        F.col("_first").alias("trial"),
        F.col("_title.component").alias("component"),
        F.coalesce(text("comment"), F.lit("")).alias("comment"),
        F.coalesce(text("nc_code"), F.lit("")).alias("nc_code"),
        positive("spindle_rpm", 0.0).alias("spindle_rpm"),
        positive("feedrate_mm_min", 0.0).alias("feedrate_mm_min"),
        positive("feed_per_tooth_mm", 0.0).alias("feed_per_tooth_mm"),
        F.bround(positive("teeth", 1.0)).cast("int").alias("flutes"),
        positive("axial_depth_mm", 0.0).alias("axial_depth_mm"),
        text("overlap_mm").alias("overlap_mm"),
        F.coalesce(text("material"), F.lit("")).alias("material"),
        F.coalesce(text("tool"), F.lit("")).alias("tool"),
    )


def read_label_intervals(spark: SparkSession, path: str) -> DataFrame:
    """Label intervals; one that does not end after it starts fails the job."""
    return label_intervals(spark.read.option("header", True).csv(path))


def label_intervals(raw: DataFrame, *keys: Column) -> DataFrame:
    """Label intervals of rows as text; one that does not end after it starts fails the job."""
    start, end = F.col("start_time_s").cast("double"), F.col("end_time_s").cast("double")
    checked = F.when(end <= start, F.raise_error(F.lit("end_time_s must exceed start_time_s"))).otherwise(end)
    return raw.select(*keys, start.alias("start_time_s"), checked.alias("end_time_s"), status_to_label(F.col("label")).alias("label"))


def read_cutting_intervals(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """Cutting intervals under any of the header spellings; unusable rows are dropped; ``position`` is the row order."""
    raw = in_file_order(read_rows(spark, path, pattern), "_n")

    def either(*names: str) -> Column:
        present = [F.col(n) for n in names if n in raw.columns]
        return first_number(*present) if present else F.lit(None).cast("double")

    kept = raw.select("_path", "_n", either("start", "Start", "START").alias("start"), either("end", "End", "END").alias("end"))
    kept = kept.where(F.col("end") > F.col("start"))
    return with_position(kept, ["_path"], F.floor(F.col("_n") / 4096).cast("long"), ["_n"]).drop("_n")


def operator_labels(rows: DataFrame) -> DataFrame:
    """Exported operator label rows: votes to labels, tool text to flutes, inches to metres."""
    def number(name: str) -> Column:
        return F.col(f"`{name}`").try_cast("double")

    rpm = F.greatest(F.coalesce(number("Spindle speed [RPM]"), F.lit(1.0)), F.lit(1.0))
    flutes = flute_count(F.col("Tool"))
    return rows.where(F.trim(F.coalesce(F.col("`No.`"), F.lit(""))) != "").select(
        *[c for c in ("experiment", "position") if c in rows.columns],
        vote_to_label(F.col("`Chatter (operator 1)`"), F.col("`Chatter (operator 2)`")).alias("label"),
        flutes.alias("flutes"),
        rpm.alias("spindle_rpm"),
        feed_from_inch_min(number("Feedrate [IPM]"), rpm, flutes).alias("feed_per_tooth_m"),
        inch_to_m(number("Depth of cut [inch]")).alias("axial_depth_m"),
        inch_to_m(number("Width of cut [inch]")).alias("radial_depth_m"),
    )


# Defaults of absent metadata.
METADATA_DEFAULTS = {
    "tool": {"diameter_m": 0.010, "flute_count": 4, "overhang_m": 0.040, "runout_m": 1.0e-6},
    "process": {
        "axial_depth_m": 0.0006, "radial_depth_m": 0.004, "cutting_coeff_t_n_m2": 7.0e8, "cutting_coeff_r_n_m2": 2.1e8,
    },
    "modal": {
        "mass_x_kg": 0.8, "mass_y_kg": 0.8, "stiffness_x_n_m": 1.55e7, "stiffness_y_n_m": 1.25e7,
        "damping_x_n_s_m": 210.0, "damping_y_n_s_m": 190.0,
    },
}


def read_run_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Nested metadata of all ``metadata.json`` files below a folder, every missing value replaced by its default.

    One row per file; ``run`` is the folder that holds it.
    """
    found = spark.read.schema(RUN_METADATA_SCHEMA).option("recursiveFileLookup", True).option("pathGlobFilter", "metadata.json")
    raw = found.option("multiLine", True).json(path)
    fields = [
        F.coalesce(F.col(f"{group}.{name}"), F.lit(value)).alias(name)
        for group, values in METADATA_DEFAULTS.items()
        for name, value in values.items()
    ]
    run = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return raw.select(run.alias("run"), F.nullif(F.col("run_id"), F.lit("")).alias("run_id"), *fields)


def read_runs(
    spark: SparkSession, requested: DataFrame, pattern: str, schema: T.StructType
) -> tuple[DataFrame, DataFrame]:
    """Metrics of many runs, and the requested runs that have none.

    ``requested`` has ``run``; ``pattern`` is a path glob whose parent directory names are run names, ``schema`` the
    metrics that are read (absent ones become NULL).  Returns (runs tagged with ``run``, skipped with a reason).
    """
    found = spark.read.schema(schema).option("multiLine", True).json(pattern).select(
        "*", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("run")
    )
    rows = found.join(requested, "run")
    skipped = requested.join(found.select("run"), "run", "left_anti").withColumn("reason", F.lit("missing metrics.json"))
    return rows, skipped


# ---- sinks ----------------------------------------------------------------------------------------------------


def manifest(windows: DataFrame, window_s: float, stride_s: float) -> DataFrame:
    """One row describing a window dataset, with label counts as a map of at most five entries."""
    counts = windows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.lit(float(window_s)).alias("window_s"),
        F.lit(float(stride_s)).alias("stride_s"),
        F.sum("n").alias("total_windows"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("label_counts"),
    )


def write_window_dataset(windows: DataFrame, path: str, window_s: float, stride_s: float, mode: str = "errorifexists") -> None:
    """Windows partitioned by scenario, plus a one-row manifest.

    Waveforms are stored with them where the windows carry ``sensor_window`` (a plan with ``waveforms``); readers of the
    other columns do not touch them.
    """
    base = path.rstrip("/")
    windows.write.mode(mode).partitionBy("scenario").parquet(f"{base}/windows")
    stored = windows.sparkSession.read.parquet(f"{base}/windows")
    manifest(stored, window_s, stride_s).write.mode(mode).json(f"{base}/manifest")


def read_window_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A written window dataset; a filter on ``scenario`` prunes directories."""
    return spark.read.parquet(f"{path.rstrip('/')}/windows")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Predictions, recommendations and metric tables; arrays become ``;`` joined text in CSV."""
    if fmt == "csv":
        flat = []
        for f in df.schema.fields:
            column = F.col(f"`{f.name}`")
            is_list = isinstance(f.dataType, T.ArrayType)
            flat.append(F.array_join(column.cast("array<string>"), ";").alias(f.name) if is_list else column)
        df.select(*flat).write.mode(mode).option("header", True).csv(path)
    else:
        df.write.mode(mode).format(fmt).save(path)


def fresh_path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
