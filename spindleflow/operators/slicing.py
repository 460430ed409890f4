"""Cutting signals into overlapping windows, and per-window context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindleflow.operators.quantiles import exact_quantiles
from spindleflow.operators.scan import Layout, Running, scan


def window_samples(window_s: float, stride_s: float, rate: float) -> tuple[int, int]:
    """Window and hop in samples, rounded half to even; at least four samples and one."""
    if window_s <= 0 or stride_s <= 0:
        raise ValueError("window and stride must be positive")
    size, hop = int(round(window_s * rate)), int(round(stride_s * rate))
    if size < 4:
        raise ValueError("a window needs at least four samples")
    if hop < 1:
        raise ValueError("a stride needs at least one sample")
    return size, hop


def slice_arrays(df: DataFrame, signal: str, rate: Column, window_s: float, stride_s: float) -> DataFrame:
    """Waveform-per-row input: one row per full window, with index, start sample, times and the window itself."""
    size = F.bround(F.lit(window_s) * rate).cast("int")
    hop = F.bround(F.lit(stride_s) * rate).cast("int")
    length = F.size(signal)
    starts = F.when(
        (length >= size) & (size >= 4) & (hop >= 1), F.sequence(F.lit(0), length - size, hop)
    ).otherwise(F.array().cast("array<int>"))
    cut = df.withColumns({"_size": size, "_rate": rate}).select("*", F.posexplode(starts).alias("window_index", "start_idx"))
    cut = cut.withColumn("sensor_window", F.slice(signal, F.col("start_idx") + 1, F.col("_size")))
    return cut.withColumns(
        {
            "start_time_s": F.col("start_idx") / F.col("_rate"),
            "end_time_s": (F.col("start_idx") + F.col("_size") - 1) / F.col("_rate"),
            "window_index_in_episode": F.col("window_index").cast("long"),
        }
    ).drop(signal, "window_index", "_size", "_rate")


# A block of windows is cut from one row: at least this many samples, and eight times what neighbours share.
BLOCK_SAMPLES = 1024
BLOCK_OVERLAPS = 8


def slice_samples(
    samples: DataFrame,
    size: int | Column,
    hop: int | Column,
    carry: tuple[str, ...] = (),
    mean: tuple[str, ...] = (),
    keys: tuple[str, ...] = ("scenario", "episode"),
) -> DataFrame:
    """One-row-per-sample input: samples are collected in blocks of consecutive windows, then cut inside the block's row.

    Only the samples that a block shares with its neighbour (window minus hop) are copied, at most an eighth of the
    block, so about the input itself is exchanged whatever the overlap of the windows. A block is bounded by the window,
    not by the recording. ``size`` and ``hop`` may be columns that are constant per recording. ``carry`` names columns
    constant per recording, ``mean`` columns to average over each window.
    """
    size, hop = (v if isinstance(v, Column) else F.lit(v) for v in (size, hop))
    idx = F.col("sample_idx")
    per = F.greatest(
        F.ceil(F.lit(BLOCK_OVERLAPS) * (size - hop) / hop), F.ceil(F.lit(BLOCK_SAMPLES) / hop), F.lit(1).cast("long")
    )
    last = F.floor(idx / hop)
    first = F.greatest(F.lit(0), F.ceil((idx - size + 1) / hop))
    blocks = F.sequence(F.floor(first / per), F.floor(last / per))
    grouped = samples.where(first <= last).withColumn("_block", F.explode(blocks)).groupBy(*keys, "_block").agg(
        F.array_sort(F.collect_list(F.struct("sample_idx", "time_s", "ch", *mean))).alias("_s"),
        F.first(size).cast("long").alias("_size"),
        F.first(hop).cast("long").alias("_hop"),
        F.first(per).alias("_per"),
        *[F.first(c).alias(c) for c in carry],
    )
    # A field of an array of structs is the array of that field.
    lists = [F.col("_s")[n].alias(f"_l_{n}") for n in ("sample_idx", "time_s", "ch", *mean)]
    listed = grouped.select(*keys, *carry, "_block", "_size", "_hop", "_per", *lists)
    held = F.col("_l_sample_idx")
    whole = F.element_at(held, -1) - held[0] + 1 == F.size(held)

    def window(w: Column) -> Column:
        at, size = w * F.col("_hop"), F.col("_size")
        before = F.when(whole, at - held[0]).otherwise(F.size(F.filter(held, lambda i: i < at)))
        inside = F.size(F.filter(held, lambda i: (i >= at) & (i < at + size))) == size
        full = F.when(whole, (at >= held[0]) & (at + size <= held[0] + F.size(held))).otherwise(inside)
        begin = F.when(full, before + 1).cast("int")
        cuts = [F.slice(f"_l_{n}", begin, size.cast("int")).alias(f"_l_{n}") for n in ("time_s", "ch", *mean)]
        return F.struct(w.alias("window_index_in_episode"), *cuts)

    numbers = F.sequence(F.col("_block") * F.col("_per"), (F.col("_block") + 1) * F.col("_per") - 1)
    cut = listed.select(*keys, *carry, F.inline(F.transform(numbers, window))).where(F.col("_l_ch").isNotNull())

    def average(name: str) -> Column:
        known = F.filter(f"_l_{name}", lambda v: v.isNotNull())
        return F.aggregate(known, F.lit(0.0), lambda a, v: a + v.cast("double")) / F.nullif(F.size(known), F.lit(0))

    return cut.select(
        *keys,
        "window_index_in_episode",
        F.array_min("_l_time_s").alias("start_time_s"),
        F.array_max("_l_time_s").alias("end_time_s"),
        F.col("_l_ch").alias("sensor_window"),
        *carry,
        *[average(name).alias(name) for name in mean],
    )


def effective_cut(samples_mean: DataFrame, base: dict[str, float]) -> DataFrame:
    """Profile scales of the per-window mean depth and coefficient against the recording's nominal cut."""
    return samples_mean.withColumns(
        {
            "axial_depth_profile_scale": F.col("axial_depth_m") / F.lit(max(base["axial_depth_m"], 1e-18)),
            "cutting_coeff_profile_scale": F.col("cutting_coeff_t_n_m2")
            / F.lit(max(base["cutting_coeff_t_n_m2"], 1e-18)),
        }
    )


def override_profile(recs: DataFrame, layout: Layout, rate: float, columns: tuple[str, ...], end_step: str) -> DataFrame:
    """Hold each recommendation on the sample clock until the next one starts; one row per sample step."""
    start = F.least(
        F.greatest(F.bround(F.col(layout.time) * F.lit(rate)).cast("long"), F.lit(0).cast("long")), F.col(end_step) - 1
    )
    held = scan(
        recs.withColumn("_start", start),
        list(layout.keys),
        layout.chunk(),
        layout.order,
        {"_next": Running("last", F.col("_start"), inclusive=False, reverse=True)},
    )
    stop = F.coalesce(F.col("_next"), F.col(end_step))
    return held.where(F.col("_start") < stop).select(
        *layout.keys, F.explode(F.sequence(F.col("_start"), stop - 1)).alias("step"), *columns
    )


def infer_window_spec(df: DataFrame, layout: Layout, rate: float) -> DataFrame:
    """Median window length and median positive stride; the length stands in when there is no stride."""
    gaps = scan(
        df,
        list(layout.keys),
        layout.chunk(),
        layout.order,
        {"_prev": Running("last", F.col(layout.time), inclusive=False)},
    ).select(
        (F.col("end_time_s") - F.col(layout.time) + 1.0 / rate).alias("length"),
        F.when(F.col(layout.time) > F.col("_prev"), F.col(layout.time) - F.col("_prev")).alias("stride"),
    )
    medians = exact_quantiles(gaps, {"length": F.col("length"), "stride": F.col("stride")}, [0.5])
    wide = medians.agg(
        F.max(F.when(F.col("name") == "length", F.col("value"))).alias("window_s"),
        F.max(F.when(F.col("name") == "stride", F.col("value"))).alias("stride_s"),
    )
    return wide.withColumn("stride_s", F.coalesce("stride_s", "window_s"))
