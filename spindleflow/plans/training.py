"""Train and evaluate a risk model under a leak-free split, then run its shadow policy."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindleflow.functions.features import project_features
from spindleflow.operators import learning, metrics, shadow, splits
from spindleflow.operators.scan import Layout
from spindleflow.operators.staging import staged
from spindleflow.schema import EPISODE


@dataclass(frozen=True)
class Training:
    # Defaults of the training job.
    model: str = "softmax"
    calibration: str = "none"
    features: str | tuple[str, ...] = "base"
    target: str = "current"
    l2: float = 1e-3
    test_fraction: float = 0.30
    validation_fraction: float = 0.0
    seed: int = 303
    split: str = "row"
    holdout_column: str = "axial_depth_scale"
    holdout_tail: str = "high"
    iterations: int | None = None

    def __post_init__(self):
        allowed = {
            "model": ("softmax", "trees"),
            "calibration": ("none", "sigmoid", "isotonic"),
            "target": ("current", "horizon"),
            "split": ("row", "episode", "scenario", "time_block", "parameter_family"),
        }
        for name, values in allowed.items():
            if getattr(self, name) not in values:
                raise ValueError(f"{name} must be one of {values}")
        if not 0 <= self.test_fraction < 1 or not 0 <= self.validation_fraction < 1:
            raise ValueError("fractions must be in [0, 1)")


def split_windows(df: DataFrame, config: Training, layout: Layout) -> DataFrame:
    """``split`` in fit, validation, test."""
    label = "label" if config.target == "current" else "horizon_label"

    def once(rows: DataFrame, fraction: float, seed: int, mode: str) -> DataFrame:
        if mode == "row":
            return splits.row_split(rows, label, "window_id", fraction, seed)
        if mode == "episode":
            return splits.grouped_split(rows, fraction, seed)
        if mode == "scenario":
            return splits.scenario_split(rows, fraction, seed)
        if mode == "time_block":
            return splits.time_block_split(rows, layout, fraction)
        return splits.parameter_family_split(rows, config.holdout_column, fraction, config.holdout_tail)

    outer = once(df, config.test_fraction, config.seed, config.split)
    if config.validation_fraction <= 0:
        return outer.withColumn("split", F.when(F.col("split") == "train", "fit").otherwise("test"))
    # A parameter family is validated on whole episodes of the training side.
    inner = "episode" if config.split == "parameter_family" else config.split
    return splits.validation_split(
        outer, lambda d: once(d, config.validation_fraction, config.seed + 911, inner), label
    )


class Results(dict):
    """Results by name; what ``later`` names is computed when it is first asked for, and kept."""

    def __init__(self, found: dict[str, object], later: dict[str, Callable[[], object]]):
        super().__init__(found)
        self.later = later

    def __missing__(self, name: str) -> object:
        self[name] = self.later[name]()
        return self[name]


def train_risk(windows: DataFrame, config: Training, layout: Layout) -> Results:
    """Model, predictions and metric tables.

    Windows are split and projected once and staged; predictions are staged once; all metrics read the predictions.
    Threshold sweeps are computed when they are read.
    """
    target = "label_id" if config.target == "current" else "horizon_label_id"
    keep = tuple(
        c
        for c in (
            *EPISODE, "window_id", "start_time_s", "label", "label_id", "horizon_label", "horizon_label_id",
            "risk_chatter_now", "future_chatter_within_horizon", "time_to_chatter_s",
        )
        if c in windows.columns
    )
    tagged = split_windows(windows, config, layout)
    named = tagged.withColumns({f"_keep_{c}": F.col(c) for c in keep})
    rows = staged(
        project_features(named, config.features, tuple(f"_keep_{c}" for c in keep) + ("split",)), "training"
    )
    features = tuple(c for c in rows.columns if not c.startswith("_keep_") and c != "split")
    goal = f"_keep_{target}"

    def fit(part: DataFrame) -> learning.RiskModel:
        if config.model == "softmax":
            return learning.train_softmax(part, features, goal, config.l2, config.iterations or 100)
        return learning.train_trees(part, features, goal, max_iter=config.iterations or 250, seed=config.seed)

    training = rows.where("split = 'fit'")
    plan = learning.calibration_plan(training, goal, config.calibration)
    if plan["status"] == "enabled":
        model = learning.calibrate_scores(
            training, fit, goal, "_keep_window_id", config.calibration, int(plan["folds"]), config.seed
        )
    else:
        model = fit(training)

    scored = model.transform(rows)
    outputs = ["split", "probability", "predicted_id", "predicted_label", "predicted_chatter_score"]
    predictions = staged(scored.select(*[F.col(f"_keep_{c}").alias(c) for c in keep], *outputs), "predictions")
    if config.test_fraction == 0:
        predictions = splits.with_fallback_test(
            predictions.withColumn("split", F.when(F.col("split") == "fit", "train").otherwise(F.col("split")))
        )
    score = F.col("predicted_chatter_score")
    found = {
        "model": model,
        "calibration": plan,
        "predictions": predictions,
        "classification": metrics.classification_metrics(predictions, target, "predicted_id", ("split",)),
    }
    later: dict[str, Callable[[], object]] = {
        "event_sweep": lambda: staged(metrics.event_sweep(predictions, score, EPISODE, ("split",)), "event-sweep"),
        "event_best": lambda: metrics.best_threshold(result["event_sweep"], ("split",)),
    }
    if "future_chatter_within_horizon" in keep:
        later["lead_sweep"] = lambda: staged(metrics.lead_time_sweep(predictions, score, ("split",)), "lead-sweep")
        later["lead_best"] = lambda: metrics.best_threshold(result["lead_sweep"], ("split",))
    result = Results(found, later)
    return result


def warning_threshold(run: dict[str, object], source: str = "event", default: float = 0.5) -> float:
    """The selected threshold as one number: from validation when it has positives, else from training."""
    if source == "default":
        return default
    best = run[f"{source}_best"]
    chosen = metrics.select_threshold(best, "event_episodes" if source == "event" else "positive_windows").first()
    return default if chosen is None or chosen["threshold"] is None else float(chosen["threshold"])


def shadow_evaluation(
    run: dict[str, object], layout: Layout, policy: shadow.ShadowPolicy = shadow.ShadowPolicy(), source: str = "event"
) -> dict[str, DataFrame]:
    """Recommendations of a trained model on its test rows, their burden and their episode outcome."""
    policy = replace(policy, threshold=warning_threshold(run, source, policy.threshold))
    test = run["predictions"].where("split = 'test'").drop("probability", "split")
    recs = staged(shadow.recommend(test, layout, "predicted_chatter_score", policy), "recommendations")
    return {
        "recommendations": recs,
        "burden": shadow.burden(recs),
        "events": metrics.event_warning_metrics(recs, F.col("shadow_warning"), EPISODE, any_quiet_warning=True),
    }
