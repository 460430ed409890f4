"""Seeded scale tables and candidate selection, from hashes so that any partition gives the same numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindleflow.operators.metrics import count_if
from spindleflow.operators.scan import seeded, unit_interval

# Randomisation ranges of episodes and of calibration families.
EPISODE_RANGES = {
    "spindle_scale": (0.85, 1.15), "feed_scale": (0.70, 1.30), "axial_depth_scale": (0.60, 1.80),
    "radial_depth_scale": (0.70, 1.30), "stiffness_scale": (0.80, 1.20), "damping_scale": (0.70, 1.35),
    "cutting_coeff_scale": (0.75, 1.35), "noise_scale": (0.50, 2.00),
}
DEPTH_SCALES = (0.25, 0.50, 0.75, 1.00, 1.25, 1.50, 1.75, 2.00, 2.50, 3.00)
SPINDLE_SCALES = (0.86, 0.90, 0.94, 0.98, 1.02, 1.06, 1.10, 1.14)
FAMILY_RANGES = {
    "stiffness_x_scale": (0.75, 1.25), "stiffness_y_scale": (0.75, 1.25), "damping_x_scale": (0.70, 1.30),
    "damping_y_scale": (0.70, 1.30), "cutting_coeff_t_scale": (0.75, 1.35), "cutting_coeff_r_scale": (0.75, 1.35),
    "radial_depth_scale": (0.70, 1.25), "feed_scale": (0.80, 1.20), "runout_scale": (0.50, 2.00),
}


def check_ranges(ranges: dict[str, tuple[float, float]]) -> None:
    for name, (low, high) in ranges.items():
        if low <= 0 or high <= 0:
            raise ValueError(f"{name} bounds must be positive")
        if low > high:
            raise ValueError(f"{name} lower bound exceeds upper bound")


def uniform_scale(seed: int, name: str, bounds: tuple[float, float], *key: Column) -> Column:
    low, high = bounds
    return F.lit(low) + F.lit(high - low) * unit_interval(seeded(seed, *key, F.lit(name)))


def episode_scales(
    episodes: DataFrame, seed: int, keys: tuple[str, ...], ranges: dict[str, tuple[float, float]] | None = None
) -> DataFrame:
    """One uniform scale column per parameter and episode."""
    ranges = ranges or EPISODE_RANGES
    check_ranges(ranges)
    columns = [F.col(k) for k in keys]
    return episodes.withColumns({name: uniform_scale(seed, name, r, *columns) for name, r in ranges.items()}).withColumn(
        "randomized", F.lit(True)
    )


def apply_scales(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Multiply parameter columns by their scale columns."""
    return df.withColumns({column: F.col(column) * F.col(scale) for column, scale in pairs.items()})


def calibration_grid(
    scenarios: DataFrame, families: int, holdout: int | None, seed: int, ranges: dict[str, tuple[float, float]] | None = None
) -> DataFrame:
    """scenarios x depth scales x spindle scales x families, with family scales and a train/holdout tag.

    The three small axes are literal arrays exploded inside each scenario row; a single family keeps scale 1.
    """
    ranges = ranges or FAMILY_RANGES
    check_ranges(ranges)
    grid = (
        scenarios.withColumn("family", F.explode(F.sequence(F.lit(0), F.lit(families - 1))))
        .withColumn("axial_depth_scale", F.explode(F.array(*[F.lit(v) for v in DEPTH_SCALES])))
        .withColumn("spindle_scale", F.explode(F.array(*[F.lit(v) for v in SPINDLE_SCALES])))
    )
    scales = {
        name: F.lit(1.0) if families == 1 else uniform_scale(seed, name, r, F.col("family")) for name, r in ranges.items()
    }
    tag = F.lit("train") if holdout is None else F.when(F.col("family") == holdout, "holdout").otherwise("train")
    return grid.withColumns({**scales, "split": tag})


def candidate_scores(df: DataFrame, keys: tuple[str, ...], candidate: str) -> DataFrame:
    """Transitions and score of each candidate episode: lead windows, transitions, closeness to the boundaries."""
    c = F.col
    lead = c("future_chatter_within_horizon") & ~c("label").isin("slight", "severe")
    return df.groupBy(*keys, candidate).agg(
        count_if(c("label") == "transition").alias("transitions"),
        (
            10.0 * count_if(lead)
            + 5.0 * count_if(c("label") == "transition")
            + F.sum(1.0 - F.least(F.abs(c("risk_chatter_now") - 0.425) / 0.425, F.lit(1.0)))
            + 0.25 * F.sum(F.greatest(F.lit(0.0), 1.0 - F.abs(c("margin_physics"))))
        ).alias("score"),
    )


def pick_candidate(scored: DataFrame, keys: tuple[str, ...], candidate: str, wanted: int) -> DataFrame:
    """The search stops at the first candidate with enough transitions; of those seen, most transitions, then score."""
    enough = F.min(F.when(F.col("transitions") >= wanted, F.col(candidate)))
    order = F.struct(F.col("transitions"), F.round("score", 9), -F.col(candidate))
    picked = scored.groupBy(*keys).agg(
        enough.alias("_first"), F.max_by(candidate, order).alias("_best")
    )
    return picked.select(*keys, F.coalesce("_first", "_best").alias(candidate))
