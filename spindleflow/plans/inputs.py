"""The shared tables seen as this engine's logical inputs, with the same view as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindleflow.functions.labels import id_of_label, label_of_id, status_to_label
from spindleflow.operators.scan import Layout
from spindleflow.plans.catalog import read

EPOCH_US = 1704067200000000  # 2024-01-01, so that start times are small
TICK_US = 3e6  # a clock unit of three seconds: times are not short decimals, so no rounding ties
HORIZON_S = 7200.0
HORIZON_US = int(HORIZON_S * TICK_US)
LAYOUT = Layout(span=144000.0)

_STATUS = {"error": "severe", "purchase": "chatter", "click": "warning", "view": "0", "signup": "unknown"}
_SCENARIOS = ("stable", "near_boundary", "onset", "unstable")


def choose(column: Column, table: dict) -> Column:
    result = None
    for key, value in table.items():
        result = F.when(column == key, F.lit(value)) if result is None else result.when(column == key, F.lit(value))
    return result


def scenario_of(number: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in _SCENARIOS]), (number % 4).cast("int"))


SCENARIO_SQL = "CASE {0} % 4 WHEN 0 THEN 'stable' WHEN 1 THEN 'near_boundary' WHEN 2 THEN 'onset' ELSE 'unstable' END"


def windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events as the window table: one episode per user, one window per event."""
    k = F.get_json_object("props", "$.k").cast("double")
    base = read(spark, folder, "events").select(
        F.col("event_id").alias("window_id"),
        scenario_of(F.col("user_id")).alias("scenario"),
        F.col("user_id").alias("episode"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("time_us"),
        status_to_label(choose(F.col("event_type"), _STATUS)).alias("label"),
        F.col("value"),
        k.alias("k"),
    )
    return base.select(
        "window_id",
        "scenario",
        "episode",
        "time_us",
        ((F.col("time_us") - EPOCH_US) / F.lit(TICK_US)).alias("start_time_s"),
        ((F.col("time_us") - EPOCH_US) / F.lit(TICK_US) + 60.0).alias("end_time_s"),
        "label",
        id_of_label(F.col("label")).alias("label_id"),
        "k",
        "value",
        F.sqrt("value").alias("rms"),
        (F.sqrt("value") * (1.0 + F.col("k") / 97.0)).alias("chatter_band_energy"),
        (F.sqrt("value") / 7.0 + 1.0).alias("tooth_band_energy"),
        F.sqrt(1.0 + F.col("k")).alias("non_tooth_harmonic_ratio"),
        (100.0 + F.col("k")).alias("dominant_frequency_hz"),
        (2.0 + F.col("k") / 20.0).alias("crest_factor"),
        (F.col("k") / 100.0).alias("spectral_entropy"),
        ((F.col("k") - 50.0) / 51.0).alias("margin_physics"),
        (F.col("k") / 101.0).alias("risk_chatter_now"),
        (0.12 + 0.006 * F.col("k")).alias("uncertainty"),
        (F.col("value") / 500.0).alias("score"),
        (0.6 + (F.col("episode") % 13) / 10.0).alias("axial_depth_scale"),
        (0.0006 * F.sqrt(0.6 + (F.col("episode") % 13) / 10.0)).alias("axial_depth_m"),
        F.lit(45.0e-6).alias("feed_per_tooth_m"),
        F.lit(0.004).alias("radial_depth_m"),
        (6000.0 + 50.0 * F.col("k")).alias("spindle_rpm"),
        (7.0e8 * (1.0 + F.col("k") / 200.0)).alias("cutting_coeff_t_n_m2"),
        (2.1e8 * (1.0 + F.col("k") / 200.0)).alias("cutting_coeff_r_n_m2"),
        (0.5 + F.col("k") / 100.0).alias("axial_depth_profile_scale"),
        (1.0 + F.col("k") / 200.0).alias("cutting_coeff_profile_scale"),
    )


LABEL_CASE = (
    "CASE event_type WHEN 'error' THEN 'severe' WHEN 'purchase' THEN 'slight' WHEN 'click' THEN 'transition'"
    " WHEN 'view' THEN 'stable' ELSE 'unknown' END"
)
ID_CASE = "CASE {0} WHEN 'stable' THEN 0 WHEN 'transition' THEN 1 WHEN 'slight' THEN 2 WHEN 'severe' THEN 3 ELSE 4 END"
SEV_CASE = "CASE {0} WHEN 'stable' THEN 0 WHEN 'transition' THEN 1 WHEN 'slight' THEN 2 WHEN 'severe' THEN 3 ELSE -1 END"

WIN_SQL = f"""
win0 AS (
  SELECT event_id AS window_id, {SCENARIO_SQL.format('user_id')} AS scenario, user_id AS episode,
         epoch_us(ts) AS time_us, {LABEL_CASE} AS label, value,
         CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k
  FROM events),
win AS (
  SELECT window_id, scenario, episode, time_us,
         (time_us - {EPOCH_US}) / 3e6 AS start_time_s, (time_us - {EPOCH_US}) / 3e6 + 60e0 AS end_time_s,
         label, {ID_CASE.format('label')} AS label_id, {SEV_CASE.format('label')} AS sev, k, value,
         sqrt(value) AS rms, sqrt(value) * (1e0 + k / 97e0) AS chatter_band_energy, sqrt(value) / 7e0 + 1e0 AS tooth_band_energy,
         sqrt(1e0 + k) AS non_tooth_harmonic_ratio, 100e0 + k AS dominant_frequency_hz,
         2e0 + k / 20e0 AS crest_factor, k / 100e0 AS spectral_entropy, (k - 50e0) / 51e0 AS margin_physics,
         k / 101e0 AS risk_chatter_now, 0.12e0 + 0.006e0 * k AS uncertainty, value / 500e0 AS score,
         0.6e0 + (episode % 13) / 10e0 AS axial_depth_scale,
         0.0006e0 * sqrt(0.6e0 + (episode % 13) / 10e0) AS axial_depth_m, 45e-6 AS feed_per_tooth_m,
         0.004e0 AS radial_depth_m, 6000e0 + 50e0 * k AS spindle_rpm,
         7e8 * (1e0 + k / 200e0) AS cutting_coeff_t_n_m2, 2.1e8 * (1e0 + k / 200e0) AS cutting_coeff_r_n_m2,
         0.5e0 + k / 100e0 AS axial_depth_profile_scale, 1e0 + k / 200e0 AS cutting_coeff_profile_scale
  FROM win0)"""

HZ_SQL = f"""
hz0 AS (
  SELECT *, max(sev) OVER f AS hsev, min(CASE WHEN sev >= 2 THEN time_us END) OVER f AS first_us,
         min(CASE WHEN sev >= 2 THEN time_us END) OVER (
           PARTITION BY scenario, episode ORDER BY time_us, window_id
           ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after_us
  FROM win
  WINDOW f AS (PARTITION BY scenario, episode ORDER BY time_us
               RANGE BETWEEN CURRENT ROW AND {HORIZON_US} FOLLOWING)),
hz AS (
  SELECT *, CASE hsev WHEN 0 THEN 'stable' WHEN 1 THEN 'transition' WHEN 2 THEN 'slight' WHEN 3 THEN 'severe'
              ELSE 'unknown' END AS horizon_label,
         CASE hsev WHEN -1 THEN 4 ELSE hsev END AS horizon_label_id,
         first_us IS NOT NULL AS chatter_within_horizon,
         coalesce(after_us <= time_us + {HORIZON_US}, FALSE) AS future_chatter_within_horizon,
         CASE WHEN first_us IS NULL THEN -1e0 ELSE (first_us - time_us) / 3e6 END AS time_to_chatter_s
  FROM hz0)"""


def with_probabilities(df: DataFrame) -> DataFrame:
    """Class probabilities from the score: slight + severe = score, transition from k, the rest stable."""
    s = F.col("score")
    mid = (1.0 - s) * F.col("k") / 200.0
    return df.withColumns(
        {
            "probability": F.array(1.0 - s - mid, mid, s * 0.6, s * 0.4, F.lit(0.0)),
            "predicted_label": label_of_id(
                F.when(F.col("k") < 40, F.col("label_id"))
                .otherwise(F.least(F.floor(F.col("value") / 125.0), F.lit(3)))
                .cast("int")
            ),
        }
    )


PRED_SQL = """
pred AS (
  SELECT *, (1e0 - score) * k / 200e0 AS p_mid,
         CASE CASE WHEN k < 40 THEN label_id ELSE least(CAST(floor(value / 125e0) AS INTEGER), 3) END
           WHEN 0 THEN 'stable' WHEN 1 THEN 'transition' WHEN 2 THEN 'slight' WHEN 3 THEN 'severe'
           ELSE 'unknown' END AS predicted_label
  FROM hz)"""


def trace(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as logged decision steps of evaluation runs."""
    line = read(spark, folder, "lineitem")
    qty, disc, tax = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    raw_feed = 0.75 + F.sqrt(qty) / 23.0
    raw_spindle = 0.87 + F.sqrt(disc + tax) / 1.7
    guard_feed = F.least(F.greatest(raw_feed, F.lit(0.80)), F.lit(1.05))
    guard_spindle = F.least(F.greatest(raw_spindle, F.lit(0.90)), F.lit(1.10))
    rows = line.select(
        F.col("l_returnflag").alias("training_algorithm"),
        F.when(F.col("l_linestatus") == "F", F.col("l_returnflag")).otherwise(F.lit("fixed")).alias("controller"),
        scenario_of(F.col("l_linenumber").cast("long")).alias("scenario"),
        (F.col("l_suppkey") % 5).alias("seed"),
        F.col("l_orderkey").alias("episode"),
        # one number that orders the lines of an order: the table has no unique line key
        (
            ((F.col("l_linenumber") * F.lit(1 << 28) + F.col("l_partkey")) * F.lit(1 << 22) + F.col("l_suppkey")) * 64
            + qty.cast("long")
        ).alias("step"),
        "l_partkey",
        (F.sqrt(disc) * 2.53).alias("risk_now"),
        F.least(F.sqrt(disc) * 2.53 + tax, F.lit(1.0)).alias("risk_horizon"),
        (qty / 50.0).alias("risk_uncertainty"),
        (0.5 - disc * 10.0).alias("current_margin"),
        (1.0 - tax).alias("previous_feed_override"),
        (1.0 + disc).alias("previous_spindle_override"),
        raw_feed.alias("raw_feed_override"),
        raw_spindle.alias("raw_spindle_override"),
        guard_feed.alias("guard_feed_override"),
        guard_spindle.alias("guard_spindle_override"),
        F.least(guard_feed, F.lit(1.0)).alias("shield_feed_override"),
        guard_spindle.alias("shield_spindle_override"),
        F.when(qty / 50.0 > 0.9, F.lit(1)).otherwise(F.lit(0)).alias("guard_fallback"),
        F.when(disc >= 0.1, F.lit(1)).otherwise(F.lit(0)).alias("shield_rejected"),
        F.when(tax > 0.02, disc * 9.0).alias("guard_candidate_risk"),
        F.when(tax > 0.02, qty / 60.0).alias("guard_candidate_uncertainty"),
        (F.sqrt("l_extendedprice") / 300.0 - disc * 10.0).alias("reward"),
        F.array_compact(
            F.array(
                F.when(qty / 50.0 > 0.9, F.lit("high_uncertainty")),
                F.when(raw_feed != guard_feed, F.lit("feed_clipped")),
                F.when(raw_spindle != guard_spindle, F.lit("spindle_clipped")),
            )
        ).alias("guard_reasons"),
        F.array_compact(
            F.array(
                F.when(disc >= 0.1, F.lit("high_uncertainty")),
                F.when(guard_feed > 1.0, F.lit("feed_rate_limited")),
            )
        ).alias("shield_reasons"),
    )
    return rows.withColumn(
        "risk_label",
        F.when(F.col("risk_now") < 0.30, "stable")
        .when(F.col("risk_now") < 0.55, "transition")
        .when(F.col("risk_now") < 0.80, "slight")
        .otherwise("severe"),
    )


TRACE_SQL = f"""
tr0 AS (
  SELECT l_returnflag AS training_algorithm,
         CASE WHEN l_linestatus = 'F' THEN l_returnflag ELSE 'fixed' END AS controller,
         {SCENARIO_SQL.format('l_linenumber')} AS scenario, l_suppkey % 5 AS seed, l_orderkey AS episode,
         ((CAST(l_linenumber AS BIGINT) * 268435456 + l_partkey) * 4194304 + l_suppkey) * 64 + CAST(l_quantity AS BIGINT) AS step, l_partkey,
         sqrt(l_discount) * 2.53e0 AS risk_now, least(sqrt(l_discount) * 2.53e0 + l_tax, 1e0) AS risk_horizon,
         l_quantity / 50e0 AS risk_uncertainty, 0.5e0 - l_discount * 10e0 AS current_margin,
         1e0 - l_tax AS previous_feed_override, 1e0 + l_discount AS previous_spindle_override,
         0.75e0 + sqrt(l_quantity) / 23e0 AS raw_feed_override, 0.87e0 + sqrt(l_discount + l_tax) / 1.7e0 AS raw_spindle_override,
         least(greatest(0.75e0 + sqrt(l_quantity) / 23e0, 0.8e0), 1.05e0) AS guard_feed_override,
         least(greatest(0.87e0 + sqrt(l_discount + l_tax) / 1.7e0, 0.9e0), 1.1e0) AS guard_spindle_override,
         CASE WHEN l_quantity / 50e0 > 0.9e0 THEN 1 ELSE 0 END AS guard_fallback,
         CASE WHEN l_discount >= 0.1e0 THEN 1 ELSE 0 END AS shield_rejected,
         CASE WHEN l_tax > 0.02e0 THEN l_discount * 9e0 END AS guard_candidate_risk,
         CASE WHEN l_tax > 0.02e0 THEN l_quantity / 60e0 END AS guard_candidate_uncertainty,
         sqrt(l_extendedprice) / 300e0 - l_discount * 10e0 AS reward
  FROM lineitem),
tr AS (
  SELECT *, least(guard_feed_override, 1e0) AS shield_feed_override, guard_spindle_override AS shield_spindle_override,
         CASE WHEN risk_now < 0.30e0 THEN 'stable' WHEN risk_now < 0.55e0 THEN 'transition'
              WHEN risk_now < 0.80e0 THEN 'slight' ELSE 'severe' END AS risk_label,
         concat_ws(';', CASE WHEN risk_uncertainty > 0.9e0 THEN 'high_uncertainty' END,
                   CASE WHEN raw_feed_override <> guard_feed_override THEN 'feed_clipped' END,
                   CASE WHEN raw_spindle_override <> guard_spindle_override THEN 'spindle_clipped' END) AS guard_reasons,
         concat_ws(';', CASE WHEN shield_rejected = 1 THEN 'high_uncertainty' END,
                   CASE WHEN guard_feed_override > 1e0 THEN 'feed_rate_limited' END) AS shield_reasons
  FROM tr0)"""
