"""Waveform-per-row package files and sound files."""

from __future__ import annotations

import re
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindleflow.functions.labels import status_to_label
from spindleflow.operators.staging import staged
from spindleflow.sources.tables import in_file_order, read_rows, stem

# Accepted names of a vector column per axis, and the patterns of per-sample columns.
VECTOR_NAMES = {
    "x": ("xchannel", "x", "accelx"),
    "y": ("ychannel", "y", "accely"),
}
SAMPLE_PATTERNS = (r"^{axis}_?channel[_\s\[(]?(\d+)", r"^(?:accel[_\s]?)?{axis}[_\s\[(]?(\d+)$")


def sample_columns(columns: list[str], axis: str) -> list[str]:
    """Per-sample columns of an axis in sample order."""
    found = []
    for name in columns:
        for pattern in SAMPLE_PATTERNS:
            match = re.match(pattern.format(axis=axis), name.strip(), re.IGNORECASE)
            if match:
                found.append((int(match.group(1)), name))
                break
    return [name for _, name in sorted(found)]


def vector_column(columns: list[str], axis: str) -> str | None:
    plain = {re.sub(r"[^a-z0-9]+", "", c.lower()): c for c in columns}
    return next((plain[n] for n in VECTOR_NAMES[axis] if n in plain), None)


def parse_vector(text: Column) -> Column:
    """``[1, 2; 3]`` style cells to numbers; NULL when any item is not a number or there is none."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^[\[\]()]+|[\[\]()]+$", ""), "[;,]", " "))
    items = F.transform(F.filter(F.split(bare, r"\s+"), lambda s: s != ""), lambda s: s.try_cast("double"))
    bad = F.exists(items, lambda v: v.isNull())
    return F.when((F.size(items) > 0) & ~bad, items)


def channel(columns: list[str], axis: str) -> Column:
    """One axis as an array; per-sample columns win over a vector cell."""
    spread = sample_columns(columns, axis)
    if spread:
        values = F.array(*[F.col(f"`{c}`").try_cast("double") for c in spread])
        return F.when(~F.exists(values, lambda v: v.isNull()), values)
    name = vector_column(columns, axis)
    if name is None:
        raise ValueError(f"could not find a {axis} vibration channel column")
    return parse_vector(F.col(f"`{name}`"))


def positive_or(columns: list[str], name: str, default: float) -> Column:
    number = F.col(name).try_cast("double") if name in columns else F.lit(None).cast("double")
    return F.when(number > 0, number).otherwise(default)


def read_packages(
    spark: SparkSession,
    path: str,
    default_rate: float = 10_000.0,
    default_rpm: float = 9_000.0,
    include_unknown: bool = False,
    max_per_file: int | None = None,
) -> DataFrame:
    """Packages with ``kept`` marking the usable ones.

    The header decides the channel columns (one small read of the driver); all parsing runs in the scan.  A package
    is skipped when a channel cannot be parsed, holds fewer than four samples, or is labelled unknown.
    """
    raw = read_rows(spark, path)
    names = [c for c in raw.columns if not c.startswith("_")]
    rows = in_file_order(raw, "package_number", _scenario=stem(F.col("_path")))
    if max_per_file is not None:
        rows = rows.where(F.col("package_number") <= max_per_file)
    status = F.col("status") if "status" in names else F.lit("unknown")
    parsed = rows.select(
        F.col("_scenario").alias("scenario"),
        F.col("_path").alias("path"),
        "package_number",
        channel(names, "x").alias("_x"),
        channel(names, "y").alias("_y"),
        positive_or(names, "fs", default_rate).alias("fs"),
        positive_or(names, "spindlespeed", default_rpm).alias("spindle_rpm"),
        status_to_label(status).alias("label"),
    )
    length = F.least(F.size("_x"), F.size("_y"))
    signal = F.transform(
        F.arrays_zip(F.slice("_x", F.lit(1), length).alias("x"), F.slice("_y", F.lit(1), length).alias("y")),
        lambda s: F.array(s["x"], s["y"]),
    )
    usable = F.col("_x").isNotNull() & F.col("_y").isNotNull() & (length >= 4)
    known = F.lit(include_unknown) | (F.col("label") != "unknown")
    return parsed.withColumns(
        {"kept": F.coalesce(usable & known, F.lit(False)), "signal": F.when(usable, signal)}
    ).drop("_x", "_y")


# ---- sound ----------------------------------------------------------------------------------------------------

SOUND_BLOCK = 65_536
_BLOCKS_A_TASK = 64
_HEADER_TYPE = "experiment string, sensor int, path string, start long, frames long, width int, channels int, rate double"
_BLOCK_TYPE = "experiment string, sensor int, block long, samples array<double>, total double, count long"


def _open(path: str):
    """A file for random access; Spark names local ones ``file:/...``."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _headers(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What the header of each sound file says, and where its samples start; no sample is read."""
    for frame in files:
        rows = []
        for experiment, sensor, path, length in zip(frame["experiment"], frame["sensor"], frame["path"], frame["length"]):
            with _open(path) as raw, wave.open(raw) as sound:
                start, wide = raw.tell(), sound.getsampwidth() * sound.getnchannels()
                frames = max(0, min(sound.getnframes(), (length - start) // wide))
                rows.append((experiment, sensor, path, start, frames, sound.getsampwidth(), sound.getnchannels(), float(sound.getframerate())))
        yield pd.DataFrame(rows, columns=[part.split()[0] for part in _HEADER_TYPE.split(", ")])


def _mono(content: bytes, width: int, channels: int) -> np.ndarray:
    """PCM bytes to the mean of their channels, scaled by the largest magnitude of their type."""
    if width == 3:
        # Three bytes a sample: put them on top of an empty one, so that the sign comes along.
        wide = np.zeros((len(content) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(content, np.uint8).reshape(-1, 3)
        values = wide.view("<i4").reshape(-1) >> 8
    else:
        values = np.frombuffer(content, {1: np.uint8, 2: np.dtype("<i2"), 4: np.dtype("<i4")}[width])
    return values.reshape(-1, channels).mean(axis=1) / (255.0 if width == 1 else float(2 ** (8 * width - 1)))


def _decode(ranges: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The samples of each block, read from the block's own range of bytes."""
    for frame in ranges:
        for path, rows in frame.groupby("path", sort=False):
            with _open(path) as raw:
                for row in rows.itertuples():
                    wide = row.width * row.channels
                    raw.seek(row.start + row.first * wide)
                    samples = _mono(raw.read(row.take * wide), row.width, row.channels)
                    yield pd.DataFrame(
                        {
                            "experiment": [row.experiment], "sensor": np.array([row.sensor], np.int32), "block": [row.block],
                            "samples": [samples], "total": [samples.sum()], "count": [len(samples)],
                        }
                    )


def sound_headers(spark: SparkSession, path: str, sensors: tuple[int, ...], only: DataFrame | None = None) -> DataFrame:
    """One row per sensor file (``*_sensorN.wav`` in a folder per experiment); the first by name where several match.

    ``only`` (experiment) restricts the experiments. A missing sensor, unequal rates and fewer than four common samples
    fail the job. ``shortest`` is the number of samples that all sensors of the experiment have.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(path)
    )
    named = files.select(
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("experiment"),
        F.regexp_extract("path", r"_sensor(\d+)\.wav$", 1).try_cast("int").alias("sensor"),
        "path",
        "length",
    ).where(F.col("sensor").isin(*sensors))
    if only is not None:
        named = named.join(only.select("experiment").distinct(), "experiment", "left_semi")
    first = named.groupBy("experiment", "sensor").agg(F.min_by(F.struct("path", "length"), "path").alias("_f"))
    found = staged(first.select("experiment", "sensor", "_f.path", "_f.length").mapInPandas(_headers, _HEADER_TYPE), "sound-headers")
    facts = found.groupBy("experiment").agg(
        F.count(F.lit(1)).alias("_sensors"), F.min("frames").alias("_frames"), F.min("rate").alias("_low"), F.max("rate").alias("_high")
    )

    def fail(text: str) -> Column:
        return F.raise_error(F.concat(F.lit(text), F.col("experiment"))).cast("long")

    shortest = (
        F.when(F.col("_sensors") < len(sensors), fail("a sensor's sound file is missing in "))
        .when(F.col("_low") != F.col("_high"), fail("unequal sample rates in "))
        .when(F.col("_frames") < 4, fail("too short sound in "))
        .otherwise(F.col("_frames"))
    )
    return found.join(facts.select("experiment", shortest.alias("shortest")), "experiment")


def read_sound(
    spark: SparkSession, path: str, sensors: tuple[int, ...] = (0, 1, 2), only: DataFrame | None = None, frames: int = SOUND_BLOCK
) -> DataFrame:
    """Per-sensor sound files of each experiment as one multi-channel sample table.

    Headers are read first; then tasks read blocks of ``frames`` samples as ranges of bytes, so one long file is decoded
    by many of them. Blocks are decoded once and staged with their sums; the means of whole files are removed when the sensors' blocks meet, at most
    one block for each sensor in a group. Channels are cut to the shortest.
    """
    headers = sound_headers(spark, path, sensors, only)
    last = F.floor((F.col("frames") - 1) / frames)
    # The checks of ``shortest`` run here, as later steps do not read it.
    blocks, _ = headers.agg(F.coalesce(F.sum(last + 1), F.lit(0)), F.max("shortest")).first()
    tasks = max(1, min(blocks, spark.sparkContext.defaultParallelism), -(-blocks // _BLOCKS_A_TASK))
    ranges = headers.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("shortest")
    ranges = ranges.withColumn("first", F.col("block") * frames).withColumn("take", F.least(F.col("frames") - F.col("first"), F.lit(frames)))
    # The number of tasks is given: by the size of these few rows, adaptive execution would make one task of them.
    dealt = ranges.repartition(tasks, "path", "block").sortWithinPartitions("path", "block")
    decoded = staged(dealt.mapInPandas(_decode, _BLOCK_TYPE), "sound-blocks")
    means = decoded.groupBy("experiment", "sensor").agg((F.sum("total") / F.sum("count")).alias("_mean"))
    centred = decoded.join(means, ["experiment", "sensor"]).select(
        "experiment", "block", "sensor", F.transform("samples", lambda v: v - F.col("_mean")).alias("v")
    )
    met = centred.groupBy("experiment", "block").agg(F.array_sort(F.collect_list(F.struct("sensor", "v"))).alias("_s"))
    # Beyond the shortest file a block lacks a sensor, or one of its sensors ends earlier.
    listed = met.where(F.size("_s") == len(sensors)).select(
        "experiment", "block", *[F.col("_s")[j]["v"].alias(f"_v{j}") for j in range(len(sensors))]
    )
    common = F.array_min(F.array(*[F.size(f"_v{j}") for j in range(len(sensors))]))
    rows = F.transform(
        F.slice("_v0", F.lit(1), common), lambda _, i: F.array(*[F.col(f"_v{j}")[i] for j in range(len(sensors))])
    )
    rates = headers.groupBy("experiment").agg(F.min("rate").alias("rate"))
    samples = listed.select("experiment", "block", F.posexplode(rows).alias("_i", "ch"))
    return samples.join(rates, "experiment").select(
        "experiment", (F.col("block") * frames + F.col("_i")).alias("sample_idx"), "rate", "ch"
    )
