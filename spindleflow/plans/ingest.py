"""Raw sources to the window table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindleflow.functions import physics as phys
from spindleflow.functions import signal as sig
from spindleflow.functions.labels import comment_to_label, id_of_label
from spindleflow.functions.risk import RiskInputs, clip, risk_struct
from spindleflow.operators import sequence as seq
from spindleflow.operators.align import cut_by_interval, label_windows
from spindleflow.operators.quantiles import spread_of
from spindleflow.operators.scan import Layout, with_position
from spindleflow.operators.slicing import slice_arrays, slice_samples, window_samples
from spindleflow.operators.staging import staged, staged_in_buckets
from spindleflow.operators.timebase import dense_number
from spindleflow.schema import WINDOW_SCHEMA
from spindleflow.sources.machine_run import read_machine_run
from spindleflow.sources.packages import SOUND_BLOCK, read_packages, read_sound
from spindleflow.sources.tables import METADATA_DEFAULTS, read_controller_hf, read_cutting_intervals


@dataclass(frozen=True)
class WindowPlan:
    """Window, stride and look-ahead in seconds, and the chunk width of the sequence operators.

    With ``waveforms`` the window table keeps each window's samples (``sensor_window``), joined over ``buckets`` buckets.
    """

    window_s: float = 0.10
    stride_s: float = 0.05
    horizon_s: float = 0.25
    span_s: float = 60.0
    waveforms: bool = False
    buckets: int = 16

    def layout(self) -> Layout:
        return Layout(span=self.span_s)


# Window, stride, horizon and rate of each public source family.
PACKAGES = WindowPlan(0.10, 0.05, 0.25)
CONTROLLER = WindowPlan(1.0, 0.5, 2.0)
SOUND = WindowPlan(0.10, 0.05, 0.25)
TRIAXIAL = WindowPlan(0.25, 0.125, 0.50)
SCALES = (
    "spindle_scale", "feed_scale", "axial_depth_scale", "radial_depth_scale", "stiffness_scale", "damping_scale",
    "cutting_coeff_scale", "noise_scale",
)


def featurise(
    cut: DataFrame, rate: Column, rpm: Column, flutes: Column, modal_hz: Column | None, margin: Column, margin_width: float
) -> DataFrame:
    """Signal features and risk of each ``sensor_window``; the waveform stays beside them."""
    rows = sig.with_series(cut, "_series", sig.series_of_window(F.col("sensor_window")))
    mode = F.lit(None).cast("double") if modal_hz is None else modal_hz
    rows = rows.withColumns(
        {"_f": sig.time_features(F.col("_series")), "_p": sig.spectral_features("_series", rate, rpm, flutes, mode)}
    )
    risk = risk_struct(
        RiskInputs(
            F.col("_p.chatter_band_energy"), F.col("_p.tooth_band_energy"), F.col("_f.crest_factor"),
            F.col("_p.spectral_entropy"), margin, margin_uncertainty=margin_width,
        )
    )
    flat = {
        "rms": F.col("_f.rms"),
        **{
            name: F.col(f"_p.{name}")
            for name in (
                "tooth_frequency_hz", "tooth_band_energy", "chatter_band_energy", "non_tooth_harmonic_ratio",
                "dominant_frequency_hz",
            )
        },
        "margin_physics": margin,
        "risk_chatter_now": F.col("_k.risk_chatter_now"),
        "risk_chatter_horizon": F.col("_k.risk_chatter_horizon"),
        "margin_signal": F.col("_k.margin_signal"),
        "uncertainty": F.col("_k.uncertainty"),
        "_risk_label": F.col("_k.label"),
    }
    return rows.withColumn("_k", risk).withColumns(flat).drop("_series", "_f", "_p", "_k")


def finish(rows: DataFrame, plan: WindowPlan) -> DataFrame:
    """Ids, temporal features and look-ahead labels on the slim columns; returns the window table.

    The feature table is staged first, so waveforms are read once and never shuffled with the sequence columns. Where the
    plan keeps them they are staged in buckets of the window id, and the finished narrow columns come to them.
    """
    layout = plan.layout()
    numbered = with_position(
        rows,
        [],
        F.struct("scenario", "episode", F.floor(F.col("window_index_in_episode") / 100_000).alias("part")),
        ["scenario", "episode", "window_index_in_episode"],
        "window_id",
        coarse=F.struct(F.col("_fine.scenario"), F.floor(F.col("_fine.episode") / 1000).alias("block")),
    ).withColumn("window_id", F.col("window_id") - 1)
    base = numbered.withColumns(
        {
            "randomized": F.lit(False),
            **{name: F.lit(1.0) for name in SCALES if name not in rows.columns},
            "label_id": id_of_label(F.col("label")),
        }
    )
    if plan.waveforms:
        whole = staged_in_buckets(base, "window_id", plan.buckets, "features")
        slim = whole.drop("sensor_window")
    else:
        slim = staged(base.drop("sensor_window"), "features")
    deltas = seq.temporal_deltas(slim, layout)
    means = seq.ewma(slim.select(*layout.keys, layout.time, layout.tie, *seq.EWMA_FEATURES), layout).select(
        "window_id", *[f"{f}_ewma" for f in seq.EWMA_FEATURES]
    )
    joined = deltas.join(means, "window_id")
    ahead = seq.horizon_labels(joined, layout, plan.horizon_s)
    table = ahead.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in WINDOW_SCHEMA.fields])
    return table.join(whole.select("window_id", "sensor_window"), "window_id") if plan.waveforms else table


def _public(rows: DataFrame, plan: WindowPlan, rate: Column, rpm: Column, flutes: Column, modal_hz: float | None) -> DataFrame:
    """Public-data conventions: margin 0 with width 1, uncertainty at least 0.80, unit coefficients."""
    mode = None if modal_hz is None else F.lit(float(modal_hz))
    done = featurise(rows, rate, rpm, flutes, mode, F.lit(0.0), 1.0)
    filled = {
        "uncertainty": F.greatest(F.col("uncertainty"), F.lit(0.80)),
        "spindle_rpm": rpm,
        "limiting_frequency_hz": F.lit(float(modal_hz or 0.0)),
        "axial_depth_profile_scale": F.lit(1.0),
        "cutting_coeff_profile_scale": F.lit(1.0),
        "cutting_coeff_t_n_m2": F.lit(1.0),
        "cutting_coeff_r_n_m2": F.lit(1.0),
        "episode_progress": clip(F.col("start_time_s") / F.greatest(F.col("_duration"), F.lit(plan.window_s)), 0.0, 1.0),
    }
    for name, default in (("feed_per_tooth_m", 45.0e-6), ("axial_depth_m", 0.0), ("radial_depth_m", 0.0)):
        if name not in rows.columns:
            filled[name] = F.lit(default)
    return finish(done.withColumns(filled).drop("_duration"), plan)


def ingest_packages(
    spark: SparkSession, path: str, plan: WindowPlan = PACKAGES, flutes: int = 4, modal_hz: float | None = None, **options
) -> DataFrame:
    """Package CSV files to windows; each kept package is an episode, numbered in source order."""
    packages = read_packages(spark, path, **options).where("kept")
    numbered = with_position(
        packages,
        [],
        F.struct("path", F.floor(F.col("package_number") / 4096).alias("part")),
        ["path", "package_number"],
        "episode",
        coarse=F.col("_fine.path"),
    ).withColumn("episode", F.col("episode") - 1)
    sized = numbered.withColumn("_duration", F.size("signal") / F.col("fs"))
    cut = slice_arrays(sized, "signal", F.col("fs"), plan.window_s, plan.stride_s)
    return _public(cut, plan, F.col("fs"), F.col("spindle_rpm"), F.lit(flutes), modal_hz)


def ingest_samples(
    samples: DataFrame, plan: WindowPlan, rate: float | Column, rpm: float, flutes: int = 4, modal_hz: float | None = None, carry: tuple[str, ...] = ("label",)
) -> DataFrame:
    """One-row-per-sample recordings (scenario, episode, sample_idx, time_s, ch, label) to windows.

    Serves the triaxial, controller and sound families; columns in ``carry`` are constant per recording. ``rate`` may be
    one of them, for recordings of different rates.
    """
    if isinstance(rate, Column):
        short = F.raise_error(F.lit("a window needs at least four samples and a stride one")).cast("long")
        size, hop = (F.bround(F.lit(seconds) * rate).cast("long") for seconds in (plan.window_s, plan.stride_s))
        size = F.when((size < 4) | (hop < 1), short).otherwise(size)
    else:
        size, hop = window_samples(plan.window_s, plan.stride_s, rate)
        rate = F.lit(rate)
    lengths = samples.groupBy("scenario", "episode").agg((F.max("sample_idx") + 1).alias("_samples"))
    cut = slice_samples(samples, size, hop, carry)
    cut = cut.join(lengths, ["scenario", "episode"]).withColumn("_duration", F.col("_samples") / rate).drop("_samples")
    speed = F.col("spindle_rpm") if "spindle_rpm" in carry else F.lit(float(rpm))
    teeth = F.col("flutes") if "flutes" in carry else F.lit(flutes)
    return _public(cut, plan, rate, speed, teeth, modal_hz)


# What is known of a recording beside its samples.
CUT_FACTS = ("label", "flutes", "spindle_rpm", "feed_per_tooth_m", "axial_depth_m", "radial_depth_m")


def ingest_sound(
    spark: SparkSession, path: str, labels: DataFrame, plan: WindowPlan = SOUND, sensors: tuple[int, ...] = (0, 1, 2)
) -> DataFrame:
    """Sound files and ``cutting.csv`` in a folder per experiment, with operator labels, to windows.

    Cutting interval *i* of an experiment is an episode and takes label row *i* (``position`` from 1, columns of
    ``operator_labels``); without one it counts as stable, at one turn a minute. Experiments without label rows or
    intervals are left out, their sound is not read.
    """
    intervals = staged(
        read_cutting_intervals(spark, path, "cutting.csv")
        .withColumn("experiment", F.regexp_extract("_path", r"([^/]+)/[^/]+$", 1)).drop("_path")
        .join(labels.select("experiment").distinct(), "experiment", "left_semi"),
        "cutting",
    )
    samples = staged(read_sound(spark, path, sensors, intervals), "sound")
    rates = samples.groupBy("experiment").agg(F.min("rate").alias("rate"))
    placed = cut_by_interval(
        samples.drop("rate"), intervals.join(rates, "experiment"), labels, "experiment", F.col("rate"), SOUND_BLOCK, list(CUT_FACTS)
    )
    missing = dict(zip(CUT_FACTS, ("stable", 4, 1.0, 1.0e-9, 0.0, 0.0)))
    filled = placed.withColumns({n: F.coalesce(F.col(n), F.lit(v)) for n, v in missing.items()})
    filled = filled.withColumns({"scenario": F.col("experiment"), "time_s": F.col("sample_idx") / F.col("rate")})
    return ingest_samples(filled, plan, F.col("rate"), 1.0, carry=(*CUT_FACTS, "rate"))


def ingest_controller(
    spark: SparkSession,
    path: str,
    trials: DataFrame,
    columns: tuple[str, ...],
    rate: float,
    plan: WindowPlan = CONTROLLER,
    include_unknown: bool = False,
    robust: bool = False,
) -> DataFrame:
    """Controller files ``<trial>_hfdata.csv`` with their trial sheet (columns of ``read_trial_sheet``) to windows.

    The comment is the label; trials of other comments are dropped before their samples are joined unless
    ``include_unknown``. Episodes number the trials by name; ``robust`` replaces each signal by its robust z-score.
    """
    def at_least(name: str, low: float, scale: float = 1.0) -> Column:
        return F.greatest(F.coalesce(F.col(name), F.lit(0.0)) / F.lit(scale), F.lit(low))

    known = trials.select(
        "trial",
        comment_to_label(F.col("comment")).alias("label"),
        F.greatest(F.coalesce("flutes", F.lit(1)), F.lit(1)).alias("flutes"),
        at_least("spindle_rpm", 1.0).alias("spindle_rpm"),
        at_least("feed_per_tooth_mm", 1.0e-9, 1000.0).alias("feed_per_tooth_m"),
        at_least("axial_depth_mm", 0.0, 1000.0).alias("axial_depth_m"),
        (phys.mean_of_numbers(F.col("overlap_mm")) / 1000.0).alias("radial_depth_m"),
    )
    chosen = staged(known if include_unknown else known.where(F.col("label") != "unknown"), "trials")
    numbered = chosen.join(dense_number(chosen.select("trial").distinct(), "trial", "episode"), "trial")
    samples = read_controller_hf(spark, path, columns, rate)
    samples = samples.withColumn("trial", F.regexp_replace("recording", "_hfdata$", "")).join(numbered, "trial").withColumnRenamed("trial", "scenario")
    if robust:
        samples = standardised(staged(samples, "controller"), len(columns))
    return ingest_samples(samples, plan, rate, 1.0, carry=CUT_FACTS)


def standardised(samples: DataFrame, channels: int, by: tuple[str, ...] = ("scenario", "episode")) -> DataFrame:
    """Each channel of a recording as (x - median) / robust scale."""
    columns = {f"c{i}": F.col("ch")[i] for i in range(channels)}
    spread = spread_of(samples, columns, 1e-9, by)
    wide = spread.groupBy(*by).agg(
        *[F.max(F.when(F.col("name") == n, F.struct("median", "scale"))).alias(n) for n in columns]
    )
    fixed = F.array(*[(F.col("ch")[i] - F.col(f"c{i}.median")) / F.col(f"c{i}.scale") for i in range(channels)])
    return samples.join(wide, list(by)).withColumn("ch", fixed).drop(*columns)


def ingest_machine_run(
    spark: SparkSession, folder: str, plan: WindowPlan = WindowPlan(), default_label: str = "unknown"
) -> DataFrame:
    """All machine runs below a folder to windows: aligned context, stability margin, interval labels.

    A clock error in any run fails; the message names the first of them.
    """
    tables = read_machine_run(spark, folder, plan.span_s)
    # Findings are one row per kind and table of a run; equal ones are counted, and kinds of findings are few.
    errors = tables["findings"].where("severity = 'error'").groupBy("message").agg(F.count("*").alias("count"), F.min("run").alias("run"))
    found = errors.orderBy("message").limit(20).collect()
    if found:
        raise ValueError("; ".join(f"{row['message']} ({row['count']} times, first in {row['run']})" if row["count"] > 1 else row["message"] for row in found))
    return machine_windows(tables["samples"], tables["labels"], tables["metadata"], plan, default_label)


def run_facts(samples: DataFrame, metadata: DataFrame, plan: WindowPlan) -> DataFrame:
    """One row per run: metadata or its defaults, rate, duration, window and hop in samples, scenario and episode.

    The scenario is the run's id, or its folder where it has none; runs that share an id are its episodes, by folder.
    """
    clock = samples.groupBy("run").agg((F.max("time_s") - F.min("time_s")).alias("_duration"), F.count(F.lit(1)).alias("_samples"))
    rate = (F.col("_samples") - 1) / F.nullif(F.col("_duration"), F.lit(0.0))
    size, hop = (F.bround(F.lit(seconds) * F.col("_rate")).cast("long") for seconds in (plan.window_s, plan.stride_s))
    short = F.raise_error(F.concat(F.lit("a window needs at least four samples and a stride one: "), F.col("run")))
    filled = {n: F.coalesce(F.col(n), F.lit(v)) for group in METADATA_DEFAULTS.values() for n, v in group.items()}
    facts = clock.withColumn("_rate", rate).where("_rate IS NOT NULL").join(metadata, "run", "left").withColumns(filled)
    facts = facts.withColumn("scenario", F.coalesce("run_id", "run")).withColumn("_hop", hop)
    facts = facts.withColumn("_size", F.when((size < 4) | (F.col("_hop") < 1), short.cast("long")).otherwise(size))
    number = F.row_number().over(Window.partitionBy("scenario").orderBy("run")).cast("long")
    return facts.withColumn("episode", number - 1).drop("run_id", "_samples")


def machine_windows(
    aligned: DataFrame, labels: DataFrame, metadata: DataFrame, plan: WindowPlan, default_label: str = "unknown"
) -> DataFrame:
    """Aligned samples of runs (run, sample_idx, time_s, ch, spindle_rpm, feed_per_tooth_m) to windows.

    ``labels`` and ``metadata`` are keyed by run as well: rates, tools and cutting parameters reach the windows by a
    join, so runs of different machines are one job.
    """
    samples = staged(aligned, "samples")
    facts = staged(run_facts(samples, metadata, plan), "runs")
    cut = slice_samples(
        samples.join(facts.select("run", "_size", "_hop"), "run"), F.col("_size"), F.col("_hop"),
        mean=("spindle_rpm", "feed_per_tooth_m"), keys=("run",),
    )
    cut = cut.join(facts.drop("_size", "_hop"), "run")
    modal = phys.Modal(*[F.col(n) for n in METADATA_DEFAULTS["modal"]])
    tool = phys.Tool(*[F.col(n) for n in METADATA_DEFAULTS["tool"]])
    process = phys.Cut(F.col("spindle_rpm"), F.col("feed_per_tooth_m"), *[F.col(n) for n in METADATA_DEFAULTS["process"]])
    margins = cut.withColumn("_v", phys.stability(modal, tool, process))
    done = featurise(
        margins.withColumns(
            {"_margin": F.col("_v.signed_margin"), "limiting_frequency_hz": F.col("_v.limiting_frequency_hz")}
        ).drop("_v"),
        F.col("_rate"), F.col("spindle_rpm"), F.col("flute_count"), phys.natural_frequency(modal), F.col("_margin"), 0.20,
    )
    filled = done.withColumns(
        {
            "axial_depth_profile_scale": F.lit(1.0),
            "cutting_coeff_profile_scale": F.lit(1.0),
            "episode_progress": clip(F.col("start_time_s") / F.greatest(F.col("_duration"), F.lit(1e-12)), 0.0, 1.0),
        }
    )
    named = label_windows(filled, labels, ["run"], "window_index_in_episode", plan.span_s, default_label)
    return finish(named.drop("_margin", "_rate", "_duration", "run", *METADATA_DEFAULTS["modal"], *METADATA_DEFAULTS["tool"]), plan)
