"""Learning queries (M1-M6).  Fitted numbers have no SQL twin; their ranking metrics are what is returned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindleflow.functions.labels import id_of_label
from spindleflow.functions.physics import calibrated
from spindleflow.operators import learning, metrics
from spindleflow.operators import sequence as seq
from spindleflow.operators.staging import staged
from spindleflow.plans.catalog import query
from spindleflow.plans.inputs import HORIZON_S, LAYOUT, windows
from spindleflow.plans.training import Training, shadow_evaluation, train_risk

_FEATURES = ("rms", "margin_physics", "non_tooth_harmonic_ratio", "chatter_band_energy", "crest_factor")


def learnable(spark: SparkSession, folder: str) -> DataFrame:
    """Windows whose label follows their risk and level, so that there is something to learn."""
    level = F.col("k") / 100.0 * 0.7 + F.col("score") * 0.3
    label = F.when(level < 0.3, "stable").when(level < 0.5, "transition").when(level < 0.7, "slight").otherwise("severe")
    rows = windows(spark, folder).withColumn("label", label).withColumn("label_id", id_of_label(F.col("label")))
    return staged(seq.horizon_labels(rows, LAYOUT, HORIZON_S), "learnable")


def _run(spark: SparkSession, folder: str, **options) -> dict:
    return train_risk(learnable(spark, folder), Training(features=_FEATURES, **options), LAYOUT)


@query("m1_softmax")
def m1(spark: SparkSession, folder: str) -> DataFrame:
    return _run(spark, folder, split="episode")["classification"]


@query("m2_trees")
def m2(spark: SparkSession, folder: str) -> DataFrame:
    return _run(spark, folder, model="trees", split="time_block")["classification"]


@query("m3_calibrated_scores")
def m3(spark: SparkSession, folder: str) -> DataFrame:
    return _run(spark, folder, calibration="sigmoid")["classification"]


@query("m4_margin_calibration")
def m4(spark: SparkSession, folder: str) -> DataFrame:
    rows = learnable(spark, folder).select(
        "margin_physics", "spindle_rpm", "axial_depth_m", "radial_depth_m", "cutting_coeff_t_n_m2",
        (F.col("label_id") >= 2).alias("positive"), F.col("score").alias("target"),
        F.when(F.col("episode") % 5 == 0, "holdout").otherwise("train").alias("split"),
    )
    fitted = learning.fit_margin_calibration(rows.where("split = 'train'"), "margin_physics", "positive", context=True)
    scored = rows.withColumns(calibrated(fitted, rows.columns, F.col("margin_physics")))
    return metrics.calibration_quality(scored, "calibrated_probability", "positive", "margin_physics", "target")


@query("m5_score")
def m5(spark: SparkSession, folder: str) -> DataFrame:
    rows = learnable(spark, folder)
    model = learning.train_softmax(rows, _FEATURES, "label_id")
    return model.transform(rows).select("window_id", "predicted_label", "predicted_chatter_score")


@query("m6_train_risk")
def m6(spark: SparkSession, folder: str) -> DataFrame:
    run = _run(
        spark, folder, target="horizon", split="parameter_family", validation_fraction=0.25
    )
    outcome = shadow_evaluation(run, LAYOUT, source="event")
    return outcome["events"]
