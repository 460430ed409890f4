"""Robust quantile pseudo-labels: baseline on stable rows, score, thresholds, relabelling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindleflow.functions.features import require_columns
from spindleflow.functions.labels import is_positive, set_label
from spindleflow.functions.risk import safe_log10
from spindleflow.operators.quantiles import exact_quantiles, spread_of
from spindleflow.operators.scan import Layout, one_row
from spindleflow.operators.staging import staged
from spindleflow.operators.sequence import horizon_labels

# Default score columns and the log-scaled ones.
SCORE_COLUMNS = (
    "rms", "chatter_band_energy", "non_tooth_harmonic_ratio", "chatter_band_energy_ewma",
    "non_tooth_harmonic_ratio_ewma", "chatter_band_energy_growth_rate",
)
LOG_SCORED = frozenset(
    {
        "rms", "chatter_band_energy", "tooth_band_energy", "non_tooth_harmonic_ratio", "rms_ewma",
        "chatter_band_energy_ewma", "non_tooth_harmonic_ratio_ewma",
    }
)


@dataclass(frozen=True)
class PseudoLabels:
    columns: tuple[str, ...] = SCORE_COLUMNS
    scenarios: tuple[str, ...] = ()
    mode: str = "scenario"
    quantiles: tuple[float, float, float] = (0.95, 0.99, 0.997)
    floors: tuple[float, float, float] = (1.0, 2.0, 3.5)

    def __post_init__(self):
        if not self.columns:
            raise ValueError("score columns cannot be empty")
        if self.mode not in ("scenario", "episode", "label"):
            raise ValueError("mode must be scenario, episode or label")
        if list(self.quantiles) != sorted(self.quantiles) or not all(0 <= q <= 1 for q in self.quantiles):
            raise ValueError("quantiles must be ordered and lie in [0, 1]")


def score_inputs(columns: tuple[str, ...]) -> dict[str, Column]:
    def value(c: str) -> Column:
        filled = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        return safe_log10(filled) if c in LOG_SCORED else filled

    return {c: value(c) for c in columns}


def robust_baseline(df: DataFrame, columns: tuple[str, ...] = SCORE_COLUMNS) -> DataFrame:
    """(name, median, scale) over the stable rows; the scale is at least 1."""
    return spread_of(df.where(F.col("label") == "stable"), score_inputs(columns), 1.0)


def pseudo_score(df: DataFrame, baseline: DataFrame, columns: tuple[str, ...] = SCORE_COLUMNS) -> DataFrame:
    """Mean of max(0, (value - median) / scale); the baseline is one row of 2 x len(columns) numbers."""
    wide = baseline.agg(
        *[F.max(F.when(F.col("name") == c, F.struct("median", "scale"))).alias(c) for c in columns]
    )
    parts = [
        F.greatest(F.lit(0.0), (value - F.col(f"_b.{c}.median")) / F.col(f"_b.{c}.scale"))
        for c, value in score_inputs(columns).items()
    ]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return df.withColumn("_b", one_row(wide)).withColumn("pseudo_label_score", total / len(parts)).drop("_b")


def pseudo_thresholds(stable_scores: DataFrame, config: PseudoLabels) -> DataFrame:
    """One row (transition, slight, severe), each at its floor or above and 1e-6 apart."""
    cuts = exact_quantiles(stable_scores, {"s": F.col("pseudo_label_score")}, list(config.quantiles))
    q = cuts.agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(f"q{i}") for i, p in enumerate(config.quantiles)]
    )
    low, mid, high = config.floors
    q = q.withColumn("transition", F.greatest("q0", F.lit(low)))
    q = q.withColumn("slight", F.greatest("q1", F.lit(mid), F.col("transition") + 1e-6))
    q = q.withColumn("severe", F.greatest("q2", F.lit(high), F.col("slight") + 1e-6))
    return q.select("transition", "slight", "severe")


def mark_candidates(df: DataFrame, config: PseudoLabels) -> DataFrame:
    """``pseudo_label_candidate`` by scenario, episode or label membership; semi-joins on pre-aggregated keys."""
    positive = is_positive(F.col("label"))
    if config.scenarios:
        hot_scenarios = df.where(F.col("scenario").isin(*config.scenarios)).select("scenario").distinct()
    else:
        hot_scenarios = df.where(positive).select("scenario").distinct()
    marked = df.join(hot_scenarios.withColumn("_hot", F.lit(True)), "scenario", "left")
    in_scenario = F.coalesce("_hot", F.lit(False))
    if config.mode == "scenario":
        return marked.withColumn("pseudo_label_candidate", in_scenario).drop("_hot")
    if config.mode == "label":
        return marked.withColumn("pseudo_label_candidate", in_scenario & positive).drop("_hot")
    hot_episodes = df.where(positive).select("scenario", "episode").distinct().withColumn("_ep", F.lit(True))
    marked = marked.join(hot_episodes, ["scenario", "episode"], "left")
    return marked.withColumn(
        "pseudo_label_candidate", in_scenario & F.coalesce("_ep", F.lit(False))
    ).drop("_hot", "_ep")


def relabel(df: DataFrame, config: PseudoLabels, layout: Layout, horizon_s: float) -> DataFrame:
    """Score, threshold and relabel candidates, keep the source label once, rebuild the look-ahead labels."""
    require_columns(df, set(config.columns), "the window table")
    source = {
        "source_label": F.coalesce(F.col("source_label"), F.col("label")) if "source_label" in df.columns else F.col("label"),
    }
    baseline = staged(robust_baseline(df, config.columns), "baseline")
    scored = pseudo_score(df.withColumns(source), baseline, config.columns)
    cuts = staged(pseudo_thresholds(scored.where(F.col("label") == "stable"), config), "cuts")
    placed = mark_candidates(scored, config).withColumn("_cuts", one_row(cuts))
    s = F.col("pseudo_label_score")
    fresh = (
        F.when(s >= F.col("_cuts.severe"), "severe")
        .when(s >= F.col("_cuts.slight"), "slight")
        .when(s >= F.col("_cuts.transition"), "transition")
        .otherwise("stable")
    )
    label = F.when(F.col("pseudo_label_candidate"), fresh).otherwise(F.col("label"))
    named = placed.withColumn("_before", F.col("label"))
    changed = set_label(named, label).withColumn("pseudo_label_changed", F.col("label") != F.col("_before"))
    return horizon_labels(changed.drop("_cuts", "_before"), layout, horizon_s)


def relabel_report(df: DataFrame) -> DataFrame:
    """Windows per (label before, label after) with candidate and change counts."""
    return df.groupBy("source_label", "label").agg(
        F.count(F.lit(1)).alias("windows"),
        F.sum(F.col("pseudo_label_candidate").cast("long")).alias("candidates"),
        F.sum(F.col("pseudo_label_changed").cast("long")).alias("changed"),
    )
