"""Feature sets, derived process features and the log-scaled projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindleflow.functions.risk import safe_log10

# Feature names per set, in model order.
BASE = (
    "margin_physics", "margin_signal", "uncertainty", "spindle_rpm", "feed_per_tooth_m", "axial_depth_m",
    "radial_depth_m", "tooth_frequency_hz", "limiting_frequency_hz", "dominant_frequency_hz", "rms",
    "chatter_band_energy", "tooth_band_energy", "non_tooth_harmonic_ratio",
)
PROFILE = (
    "axial_depth_profile_scale", "cutting_coeff_profile_scale", "cutting_coeff_t_n_m2", "cutting_coeff_r_n_m2",
)
INTERACTION = (
    "depth_to_critical_ratio", "critical_depth_proxy_m", "distance_to_boundary_m", "process_force_proxy_n",
    "process_severity_proxy", "profile_progress", "margin_chatter_energy_interaction", "margin_rms_interaction",
    "chatter_growth_pressure", "rms_growth_pressure",
)
TEMPORAL = (
    "episode_progress", "dominant_frequency_delta_hz", "rms_delta", "rms_growth_rate", "chatter_band_energy_delta",
    "chatter_band_energy_growth_rate", "tooth_band_energy_delta", "tooth_band_energy_growth_rate",
    "non_tooth_harmonic_ratio_delta", "non_tooth_harmonic_ratio_growth_rate", "rms_ewma", "chatter_band_energy_ewma",
    "non_tooth_harmonic_ratio_ewma",
)
FEATURE_SETS = {
    "base": BASE,
    "temporal": BASE + TEMPORAL,
    "profile": BASE + PROFILE,
    "profile_temporal": BASE + PROFILE + TEMPORAL,
    "interaction": BASE + PROFILE + INTERACTION,
    "interaction_temporal": BASE + PROFILE + TEMPORAL + INTERACTION,
}
LOG_SCALED = frozenset(
    {
        "rms", "chatter_band_energy", "tooth_band_energy", "non_tooth_harmonic_ratio", "rms_ewma",
        "chatter_band_energy_ewma", "non_tooth_harmonic_ratio_ewma", "cutting_coeff_t_n_m2", "cutting_coeff_r_n_m2",
    }
)

# What each derived feature reads, and how it is computed from the named columns.


def _remaining() -> Column:
    return F.lit(1.0) - F.col("margin_physics")


def _critical() -> Column:
    return F.col("axial_depth_m") / F.greatest(_remaining(), F.lit(1e-6))


DERIVED = {
    "depth_to_critical_ratio": (("margin_physics",), _remaining),
    "critical_depth_proxy_m": (("margin_physics", "axial_depth_m"), _critical),
    "distance_to_boundary_m": (("margin_physics", "axial_depth_m"), lambda: _critical() - F.col("axial_depth_m")),
    "process_force_proxy_n": (
        ("axial_depth_m", "feed_per_tooth_m", "cutting_coeff_t_n_m2", "cutting_coeff_r_n_m2"),
        lambda: (F.col("cutting_coeff_t_n_m2") + F.col("cutting_coeff_r_n_m2"))
        * F.col("axial_depth_m")
        * F.col("feed_per_tooth_m"),
    ),
    "process_severity_proxy": (
        ("axial_depth_profile_scale", "cutting_coeff_profile_scale"),
        lambda: F.col("axial_depth_profile_scale") * F.col("cutting_coeff_profile_scale"),
    ),
    "profile_progress": (
        ("episode_progress", "axial_depth_profile_scale"),
        lambda: F.col("episode_progress") * F.col("axial_depth_profile_scale"),
    ),
    "margin_chatter_energy_interaction": (
        ("margin_physics", "chatter_band_energy"),
        lambda: _remaining() * F.col("chatter_band_energy"),
    ),
    "margin_rms_interaction": (("margin_physics", "rms"), lambda: _remaining() * F.col("rms")),
    "chatter_growth_pressure": (
        ("margin_physics", "chatter_band_energy_growth_rate"),
        lambda: _remaining() * F.col("chatter_band_energy_growth_rate"),
    ),
    "rms_growth_pressure": (
        ("margin_physics", "rms_growth_rate"),
        lambda: _remaining() * F.col("rms_growth_rate"),
    ),
}


def require_columns(df: DataFrame, needed: set[str], what: str) -> None:
    missing = sorted(needed - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing required columns {missing}")


def feature(name: str) -> Column:
    """A feature by name: a stored column or a derived expression, not log-scaled."""
    return DERIVED[name][1]() if name in DERIVED else F.col(name)


def derived_features(df: DataFrame, names: tuple[str, ...] = INTERACTION) -> DataFrame:
    return df.withColumns({name: feature(name) for name in names})


def project_features(df: DataFrame, feature_set: str | tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """Select a feature set (by name, or the columns themselves) with log10 on the log-scaled columns."""
    if isinstance(feature_set, str) and feature_set not in FEATURE_SETS:
        raise ValueError(f"unknown feature set {feature_set!r}; choose from {sorted(FEATURE_SETS)}")
    names = FEATURE_SETS[feature_set] if isinstance(feature_set, str) else tuple(feature_set)
    needed = {column for name in names for column in (DERIVED[name][0] if name in DERIVED else (name,))}
    require_columns(df, needed | set(keep), "the window table")
    return df.select(
        *keep, *[(safe_log10(feature(n)) if n in LOG_SCALED else feature(n)).alias(n) for n in names]
    )
