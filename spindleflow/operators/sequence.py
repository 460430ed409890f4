"""Per-episode sequence operators: deltas, EWMA, progress, look-ahead labels, hysteresis, rate limiting."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindleflow.functions.labels import id_of_label, severity_of_label
from spindleflow.operators.scan import Layout, Running, scan
from spindleflow.schema import SEVERITY

# Features with deltas, features with EWMA, smoothing factor.
DELTA_FEATURES = {
    "dominant_frequency_hz": "dominant_frequency_delta_hz",
    "rms": "rms_delta",
    "chatter_band_energy": "chatter_band_energy_delta",
    "tooth_band_energy": "tooth_band_energy_delta",
    "non_tooth_harmonic_ratio": "non_tooth_harmonic_ratio_delta",
}
EWMA_FEATURES = ("rms", "chatter_band_energy", "non_tooth_harmonic_ratio")
EWMA_ALPHA = 0.35

_FAR = 80.0  # a value e**-80 of its former size no longer shows in a double


def _reach(decay: float) -> int:
    """Rows after which a value has faded beyond the precision of a double."""
    return max(1, math.ceil(_FAR / -math.log(decay))) if decay > 0 else 1


def temporal_deltas(df: DataFrame, layout: Layout, features: dict[str, str] | None = None) -> DataFrame:
    """Change and growth rate of each feature against the previous window; zero on an episode's first window."""
    features = features or DELTA_FEATURES
    earlier = F.struct(F.col(layout.time).alias("t"), *[F.col(name) for name in features])
    paired = scan(
        df, list(layout.keys), layout.chunk(), layout.order, {"_prev": Running("last", earlier, inclusive=False)}
    )
    gap = F.greatest(F.col(layout.time) - F.col("_prev.t"), F.lit(1e-12))
    added = {}
    for name, delta in features.items():
        change = F.coalesce(F.col(name) - F.col(f"_prev.{name}"), F.lit(0.0))
        added[delta] = change
        if name != "dominant_frequency_hz":
            added[f"{name}_growth_rate"] = F.coalesce(change / gap, F.lit(0.0))
    return paired.withColumns(added).drop("_prev")


def ewma(
    df: DataFrame, layout: Layout, features: tuple[str, ...] = EWMA_FEATURES, alpha: float = EWMA_ALPHA
) -> DataFrame:
    """Exponentially weighted mean seeded with the episode's first value, exact to double precision for any ``alpha``.

    Blocks hold as many rows as a value takes to fade below double precision. Inside a block the recurrence is a running
    sum of ``x * decay**-k``, whose weights stay far from overflow, and only the block before still counts. The ends of
    the chunks, one row each, are summed in the same way along the rows they stand for: nothing is cut off by a number
    of chunks, and no list of them is built.
    """
    if not 0.0 < alpha <= 1.0:
        raise ValueError("alpha must lie in (0, 1]")
    decay = 1.0 - alpha
    reach = _reach(decay)
    keys = [*layout.keys, "_chunk"]
    rows = df.withColumn("_key", F.struct(*[F.col(c) for c in layout.keys], layout.chunk().alias("_chunk")))
    in_chunk = Window.partitionBy("_key").orderBy(*layout.order)
    rows = (
        rows.withColumn("_i", F.row_number().over(in_chunk) - 1)
        .withColumn("_block", F.floor(F.col("_i") / reach))
        .withColumn("_k", (F.col("_i") % reach).cast("double"))
    )
    in_block = Window.partitionBy("_key", "_block").orderBy(*layout.order).rowsBetween(Window.unboundedPreceding, 0)

    def faded(steps):
        return F.pow(F.lit(decay), steps)

    weight = faded(F.col("_k"))
    partial = rows.withColumns(
        {f"_p_{f}": F.lit(alpha) * weight * F.sum(F.col(f) / weight).over(in_block) for f in features}
    ) if decay else rows.withColumns({f"_p_{f}": F.col(f) for f in features})
    before = in_chunk.rowsBetween(Window.unboundedPreceding, -1)

    def block_end(f: str):
        return F.last(F.when(F.col("_k") == reach - 1, F.col(f"_p_{f}")), ignorenulls=True).over(before)

    chunked = partial.withColumns(
        {f"_l_{f}": F.col(f"_p_{f}") + weight * decay * F.coalesce(block_end(f), F.lit(0.0)) for f in features}
    )
    position = F.struct(*[F.col(c) for c in layout.order])
    ends = chunked.groupBy("_key").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *[F.min_by(F.col(f), position).alias(f"first_{f}") for f in features],
        *[F.max_by(F.col(f"_l_{f}"), position).alias(f"tail_{f}") for f in features],
    )
    chunks = Window.partitionBy(*layout.keys).orderBy("_chunk")
    earlier = chunks.rowsBetween(Window.unboundedPreceding, -1)
    # Rows up to a chunk's end, and the stretch of ``reach`` rows in which it ends.
    ends = ends.select("_key.*", "n", *[f"first_{f}" for f in features], *[f"tail_{f}" for f in features])
    ends = ends.withColumn("_end", F.sum("n").over(chunks)).withColumn("_part", F.floor(F.col("_end") / reach))
    into = F.col("_end") - F.col("_part") * reach
    in_part = Window.partitionBy(*layout.keys, "_part").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
    summed = ends.withColumns({f"_sum_{f}": F.sum(F.col(f"tail_{f}") / faded(into)).over(in_part) for f in features})
    closes = F.coalesce(F.lead("_part").over(chunks) != F.col("_part"), F.lit(True))
    closed = summed.withColumn("_closes", F.when(closes, F.struct("_part", *[f"_sum_{f}" for f in features])))
    closed = closed.withColumn("_past", F.last("_closes", ignorenulls=True).over(earlier))

    def leaving(f: str):
        near = F.col("_past._part") == F.col("_part") - 1
        past = F.when(near, F.col(f"_past._sum_{f}") * faded(into + reach))
        return F.col(f"_sum_{f}") * faded(into) + F.coalesce(past, F.lit(0.0))

    def seed(f: str):
        return F.first(f"first_{f}").over(chunks) * faded(F.col("_end") - F.col("n"))

    left = closed.withColumns({f"_out_{f}": leaving(f) for f in features})
    handed = left.select(
        F.struct(*keys).alias("_key"),
        *[(seed(f) + F.coalesce(F.lag(f"_out_{f}").over(chunks), F.lit(0.0))).alias(f"_in_{f}") for f in features],
    )
    joined = chunked.join(handed, "_key", "left")
    return joined.select(
        *df.columns,
        *[(F.col(f"_l_{f}") + faded(F.col("_i") + 1) * F.col(f"_in_{f}")).alias(f"{f}_ewma") for f in features],
    )


def episode_progress(df: DataFrame, layout: Layout) -> DataFrame:
    """Start time over the episode's time span, kept in [0, 1]."""
    spans = scan(
        df,
        list(layout.keys),
        layout.chunk(),
        layout.order,
        {
            "_t0": Running("min", F.col(layout.time), whole=True),
            "_t1": Running("max", F.col(layout.time), whole=True),
        },
    )
    length = F.greatest(F.col("_t1") - F.col("_t0"), F.lit(1e-12))
    progress = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(layout.time) - F.col("_t0")) / length))
    return spans.withColumn("episode_progress", progress).drop("_t0", "_t1")


def horizon_labels(df: DataFrame, layout: Layout, horizon_s: float) -> DataFrame:
    """Worst label, positive flags and time to the first positive within ``[t, t + horizon]``.

    Each row is copied into the earlier segments whose horizon reaches it, so one exchange suffices and a segment
    is as small as ``max(span, horizon)``.  In a segment, one backward pass keeps the next time of each severity.
    """
    reach = int(round(horizon_s * 1e9))
    width = max(int(round(layout.span * 1e9)), reach, 1)
    clock = F.round(F.col(layout.time) * F.lit(1e9)).cast("long")
    rows = df.withColumns({"_ns": clock, "_sev": severity_of_label(F.col("label"))})
    home = F.floor(F.col("_ns") / F.lit(width))
    first = F.floor((F.col("_ns") - F.lit(reach)) / F.lit(width))
    copies = rows.withColumn("_home", home).withColumn("_seg", F.explode(F.sequence(first, home)))
    backward = Window.partitionBy(*layout.keys, "_seg").orderBy(F.col("_ns").desc(), F.col(layout.tie).desc())
    here = backward.rowsBetween(Window.unboundedPreceding, 0)
    later = backward.rowsBetween(Window.unboundedPreceding, -1)

    def next_time(rank: int, window):
        return F.min(F.when(F.col("_sev") >= rank, F.col("_ns"))).over(window)

    seen = copies.withColumns(
        {**{f"_n{rank}": next_time(rank, here) for rank in (0, 1, 2, 3)}, "_after": next_time(2, later)}
    ).where(F.col("_seg") == F.col("_home"))
    limit = F.col("_ns") + F.lit(reach)
    by_rank = {rank: label for label, rank in SEVERITY.items()}
    worst = F.lit("unknown")
    for rank in (0, 1, 2, 3):
        worst = F.when(F.col(f"_n{rank}") <= limit, F.lit(by_rank[rank])).otherwise(worst)
    within = F.coalesce(F.col("_n2") <= limit, F.lit(False))
    return seen.withColumns(
        {
            "horizon_label": worst,
            "horizon_label_id": id_of_label(worst),
            "horizon_s": F.lit(float(horizon_s)),
            "chatter_within_horizon": within,
            "future_chatter_within_horizon": F.coalesce(F.col("_after") <= limit, F.lit(False)),
            "time_to_chatter_s": F.when(within, (F.col("_n2") - F.col("_ns")) / F.lit(1e9)).otherwise(F.lit(-1.0)),
        }
    ).drop("_ns", "_sev", "_home", "_seg", "_n0", "_n1", "_n2", "_n3", "_after")


def hysteresis(
    df: DataFrame, layout: Layout, score: str, threshold: float, clear: float | None = None, name: str = "shadow_warning"
) -> DataFrame:
    """On at ``score >= threshold``, off at ``score <= clear`` (default 0.75 of the threshold), else unchanged."""
    clear = max(0.0, threshold * 0.75) if clear is None else clear
    switch = F.when(F.col(score) >= F.lit(threshold), F.lit(True)).when(F.col(score) <= F.lit(clear), F.lit(False))
    held = scan(df, list(layout.keys), layout.chunk(), layout.order, {name: Running("last", switch)})
    return held.withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def rate_limit(
    df: DataFrame,
    layout: Layout,
    active: str,
    outputs: dict[str, tuple[float, float, float, float]],
) -> DataFrame:
    """Move each override towards its target by at most ``delta`` per window, from 1.0 at an episode's start.

    ``outputs`` maps a column to ``(active target, low, high, delta)``.  With the two targets A (active) and 1.0
    every step is ``y -> min(max(y + s, low), high)``, and such steps compose to three numbers.  So each chunk is
    summed up by three numbers per column, the summaries of an episode (one row per chunk) are folded in order, and
    the rows of each chunk are walked once from their entry value.
    """
    keys = [*layout.keys, "_chunk"]
    limits = {}
    for name, (target, low, high, delta) in outputs.items():
        if not low <= 1.0 <= high:
            raise ValueError(f"{name}: bounds must include 1.0")
        goal = min(max(target, low), high)
        limits[name] = (min(goal, 1.0), max(goal, 1.0), delta if goal >= 1.0 else -delta)
    rows = df.withColumn("_chunk", layout.chunk())
    order, kept = list(layout.order), [*df.columns, *outputs]

    def fold(low: float, high: float, step: float):
        def clip(x):
            return F.least(F.greatest(x, F.lit(low)), F.lit(high))

        def advance(acc, on):
            s = F.when(on, F.lit(step)).otherwise(F.lit(-step))
            return F.struct((acc["a"] + s).alias("a"), clip(acc["lo"] + s).alias("lo"), clip(acc["hi"] + s).alias("hi"))

        start = F.struct(F.lit(0.0).alias("a"), F.lit(low).alias("lo"), F.lit(high).alias("hi"))
        return F.aggregate("_on", start, advance)

    flags = F.array_sort(F.collect_list(F.struct(*order, F.col(active).alias("on"))))
    summary = (
        rows.groupBy(*keys)
        .agg(F.transform(flags, lambda s: s["on"]).alias("_on"))
        .select(*keys, *[fold(*limits[name]).alias(name) for name in outputs])
        .select(*keys, *[F.col(f"{n}.{p}").alias(f"{n}_{p}") for n in outputs for p in ("a", "lo", "hi")])
    )

    def enter(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Chunk summaries in episode order -> the value each chunk starts from."""
        episode, now = None, {}
        for frame in frames:
            entered = {name: [] for name in limits}
            for row in frame.to_dict("records"):
                key = tuple(row[k] for k in keys[:-1])
                if key != episode:
                    episode, now = key, dict.fromkeys(limits, 1.0)
                for name in limits:
                    entered[name].append(now[name])
                    now[name] = min(max(now[name] + row[f"{name}_a"], row[f"{name}_lo"]), row[f"{name}_hi"])
            yield frame[keys].assign(**{f"_in_{name}": values for name, values in entered.items()})

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows in chunk order -> the override after each row."""
        chunk, y = None, {}
        for frame in frames:
            heads = list(zip(*[frame[k] for k in keys]))
            starts = list(zip(*[frame[f"_in_{name}"] for name in limits]))
            values = {name: [] for name in limits}
            for head, start, on in zip(heads, starts, frame[active]):
                if head != chunk:
                    chunk, y = head, dict(zip(limits, start))
                for name, (low, high, step) in limits.items():
                    y[name] = min(max(y[name] + (step if on else -step), low), high)
                    values[name].append(y[name])
            yield frame.assign(**values)[kept]

    entry_schema = summary.select(*keys, *[F.col(f"{n}_a").alias(f"_in_{n}") for n in outputs]).schema
    entries = (
        summary.repartition(*layout.keys).sortWithinPartitions(*keys).mapInPandas(enter, entry_schema)
    )
    row_schema = df.select("*", *[F.lit(1.0).alias(n) for n in outputs]).schema
    return (
        rows.join(entries, keys).repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(walk, row_schema)
    )
