"""Window-table sequence queries (W2-W6) and the flagship early-warning query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindleflow.operators import sequence as seq
from spindleflow.plans.catalog import pick, query
from spindleflow.plans.inputs import HORIZON_S, HZ_SQL, LAYOUT, WIN_SQL, windows

_DELTAS = (
    "dominant_frequency_delta_hz rms_delta rms_growth_rate chatter_band_energy_delta chatter_band_energy_growth_rate"
    " tooth_band_energy_delta tooth_band_energy_growth_rate non_tooth_harmonic_ratio_delta"
    " non_tooth_harmonic_ratio_growth_rate"
)


def _lag_sql(feature: str, delta: str, rate: bool) -> str:
    change = f"coalesce({feature} - lag({feature}) OVER e, 0e0)"
    text = f"{change} AS {delta}"
    if rate:
        gap = "greatest(start_time_s - lag(start_time_s) OVER e, 1e-12)"
        text += f", coalesce({change} / {gap}, 0e0) AS {feature}_growth_rate"
    return text


_DELTA_SELECT = ", ".join(_lag_sql(f, d, f != "dominant_frequency_hz") for f, d in seq.DELTA_FEATURES.items())
_EP = "e AS (PARTITION BY scenario, episode ORDER BY start_time_s, window_id)"


@query(
    "w2_deltas",
    f"WITH {WIN_SQL}, d AS (SELECT window_id, {_DELTA_SELECT} FROM win WINDOW {_EP})"
    f" SELECT {pick('window_id', _DELTAS)} FROM d",
)
def w2(spark: SparkSession, folder: str) -> DataFrame:
    return seq.temporal_deltas(windows(spark, folder), LAYOUT).select("window_id", *_DELTAS.split())


_EWMA_SQL = f"""
WITH RECURSIVE {WIN_SQL},
o AS (SELECT *, row_number() OVER {_EP[5:]} AS rn FROM win),
r AS (
  SELECT scenario, episode, rn, window_id, rms AS a, chatter_band_energy AS b, non_tooth_harmonic_ratio AS c
  FROM o WHERE rn = 1
  UNION ALL
  SELECT o.scenario, o.episode, o.rn, o.window_id, 0.35e0 * o.rms + 0.65e0 * r.a,
         0.35e0 * o.chatter_band_energy + 0.65e0 * r.b, 0.35e0 * o.non_tooth_harmonic_ratio + 0.65e0 * r.c
  FROM o JOIN r ON o.scenario = r.scenario AND o.episode = r.episode AND o.rn = r.rn + 1)
SELECT window_id, round(a, 6) + 0.0 AS rms_ewma, round(b, 6) + 0.0 AS chatter_band_energy_ewma,
       round(c, 6) + 0.0 AS non_tooth_harmonic_ratio_ewma
FROM r"""


@query("w3_ewma_slow", _EWMA_SQL.replace("0.35e0", "0.01e0").replace("0.65e0", "0.99e0"))
def w3_slow(spark: SparkSession, folder: str) -> DataFrame:
    """A factor that remembers some hundreds of windows."""
    return seq.ewma(windows(spark, folder), LAYOUT, alpha=0.01).select("window_id", *[f"{f}_ewma" for f in seq.EWMA_FEATURES])


@query("w3_ewma", _EWMA_SQL)
def w3(spark: SparkSession, folder: str) -> DataFrame:
    return seq.ewma(windows(spark, folder), LAYOUT).select("window_id", *[f"{f}_ewma" for f in seq.EWMA_FEATURES])


@query(
    "w4_progress",
    f"""WITH {WIN_SQL}, p AS (
      SELECT window_id, greatest(0e0, least(1e0, (start_time_s - min(start_time_s) OVER e)
             / greatest(max(start_time_s) OVER e - min(start_time_s) OVER e, 1e-12))) AS episode_progress
      FROM win WINDOW e AS (PARTITION BY scenario, episode))
    SELECT {pick('window_id', 'episode_progress')} FROM p""",
)
def w4(spark: SparkSession, folder: str) -> DataFrame:
    return seq.episode_progress(windows(spark, folder), LAYOUT).select("window_id", "episode_progress")


@query(
    "w5_horizon_labels",
    f"""WITH {WIN_SQL}, {HZ_SQL}
    SELECT {pick('window_id horizon_label chatter_within_horizon future_chatter_within_horizon',
                 'time_to_chatter_s', 'horizon_label_id')} FROM hz""",
)
def w5(spark: SparkSession, folder: str) -> DataFrame:
    return seq.horizon_labels(windows(spark, folder), LAYOUT, HORIZON_S).select(
        "window_id",
        "horizon_label",
        "chatter_within_horizon",
        "future_chatter_within_horizon",
        "time_to_chatter_s",
        "horizon_label_id",
    )


HYST_SQL = f"""
hy AS (
  SELECT *, coalesce(last_value(CASE WHEN score >= 0.6e0 THEN TRUE WHEN score <= 0.45e0 THEN FALSE END IGNORE NULLS)
    OVER (PARTITION BY scenario, episode ORDER BY start_time_s, window_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), FALSE) AS shadow_warning
  FROM win)"""


@query("w6_hysteresis", f"WITH {WIN_SQL}, {HYST_SQL} SELECT window_id, shadow_warning FROM hy")
def w6(spark: SparkSession, folder: str) -> DataFrame:
    return seq.hysteresis(windows(spark, folder), LAYOUT, "score", 0.6, 0.45).select("window_id", "shadow_warning")


# Default warning overrides, bounds and step sizes.
SHADOW_TARGETS = {
    "feed_override": (0.92, 0.80, 1.05, 0.05),
    "spindle_override": (1.04, 0.90, 1.10, 0.05),
}

RATE_SQL = f"""
ho AS (SELECT *, row_number() OVER (PARTITION BY scenario, episode ORDER BY start_time_s, window_id) AS rn FROM hy),
rl AS (
  SELECT scenario, episode, rn, window_id,
         CASE WHEN shadow_warning THEN greatest(0.92e0, 1e0 - 0.05e0) ELSE 1e0 END AS feed_override,
         CASE WHEN shadow_warning THEN least(1.04e0, 1e0 + 0.05e0) ELSE 1e0 END AS spindle_override
  FROM ho WHERE rn = 1
  UNION ALL
  SELECT ho.scenario, ho.episode, ho.rn, ho.window_id,
         greatest(least(CASE WHEN ho.shadow_warning THEN 0.92e0 ELSE 1e0 END, rl.feed_override + 0.05e0),
                  rl.feed_override - 0.05e0),
         greatest(least(CASE WHEN ho.shadow_warning THEN 1.04e0 ELSE 1e0 END, rl.spindle_override + 0.05e0),
                  rl.spindle_override - 0.05e0)
  FROM ho JOIN rl ON ho.scenario = rl.scenario AND ho.episode = rl.episode AND ho.rn = rl.rn + 1)"""


@query(
    "w7_rate_limit",
    f"WITH RECURSIVE {WIN_SQL}, {HYST_SQL}, {RATE_SQL}"
    f" SELECT {pick('window_id', 'feed_override spindle_override')} FROM rl",
)
def w7(spark: SparkSession, folder: str) -> DataFrame:
    warned = seq.hysteresis(windows(spark, folder), LAYOUT, "score", 0.6, 0.45)
    slim = warned.select("scenario", "episode", "start_time_s", "window_id", "shadow_warning")
    return seq.rate_limit(slim, LAYOUT, "shadow_warning", SHADOW_TARGETS).select(
        "window_id", "feed_override", "spindle_override"
    )
