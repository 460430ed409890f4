"""Promotion gates: metrics rows against profile limits, decisions, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits per gate profile, evidence each profile needs, promotion level reached.
PROFILES = {
    "shadow_review": (1, 0.55, 0.80, 0.60, 1.0, 0.20, 0.80, 0, False, False),
    "live_shadow": (300, 0.45, 0.70, 0.50, 1.0, 0.10, 0.65, 0, True, False),
    "hardware_actuation": (1000, 0.30, 0.50, 0.35, 1.0, 0.02, 0.50, 0, True, True),
}
LIMITS = (
    "min_windows", "max_mean_risk", "max_max_risk", "max_unstable_mean_risk", "min_relative_mrr", "max_fallback_fraction",
    "max_action_fraction", "max_rejections", "needs_machine_evidence", "needs_interlock",
)
PROMOTION = {
    "shadow_review": "shadow_review_candidate",
    "live_shadow": "live_shadow_candidate",
    "hardware_actuation": "hardware_actuation_review_candidate",
}
# check, metric column, comparator, limit
NUMERIC_CHECKS = (
    ("minimum_recommendation_windows", "recommendation_windows", ">=", "min_windows"),
    ("mean_risk", "mean_risk", "<=", "max_mean_risk"),
    ("max_risk", "max_risk", "<=", "max_max_risk"),
    ("unstable_mean_risk", "unstable_mean_risk", "<=", "max_unstable_mean_risk"),
    ("relative_mrr_proxy", "relative_mrr_proxy", ">=", "min_relative_mrr"),
    ("guard_fallback_fraction", "guard_fallback_fraction", "<=", "max_fallback_fraction"),
    ("action_fraction", "action_fraction", "<=", "max_action_fraction"),
    ("shield_rejections", "shield_rejections", "<=", "max_rejections"),
)


def profile_values(profile: str, **overrides) -> dict:
    """Limits of a profile; keyword overrides replace single limits."""
    if profile not in PROFILES:
        raise ValueError(f"profile must be one of {', '.join(PROFILES)}")
    values = dict(zip(LIMITS, PROFILES[profile]))
    unknown = set(overrides) - set(values)
    if unknown:
        raise ValueError(f"unknown limits {sorted(unknown)}")
    values.update({k: v for k, v in overrides.items() if v is not None})
    if values["min_windows"] < 1 or any(values[k] < 0 for k in LIMITS[1:8]):
        raise ValueError("limits cannot be negative and at least one window is needed")
    return values


def gate_checks(metrics: DataFrame, profiles: tuple[str, ...] = tuple(PROFILES), **overrides) -> DataFrame:
    """One row per (metrics row, profile, check).

    ``metrics`` has a ``run`` column, the numeric metric columns, ``mode``, ``cnc_writes_enabled``,
    ``real_machine_data``, ``operator_approval`` and ``hardware_interlock``.  A missing number fails; a missing
    write flag counts as enabled; missing evidence counts as absent.
    """

    def check(profile: str, name: str, actual: Column, how: str, limit: Column, passed: Column) -> Column:
        return F.struct(
            F.lit(profile).alias("profile"),
            F.lit(name).alias("check"),
            actual.cast("string").alias("actual"),
            F.lit(how).alias("comparator"),
            limit.cast("string").alias("threshold"),
            F.coalesce(passed, F.lit(False)).alias("passed"),
        )

    rows = []
    for profile in profiles:
        limits = profile_values(profile, **overrides)
        for name, column, how, limit in NUMERIC_CHECKS:
            actual, bound = F.col(column).cast("double"), F.lit(float(limits[limit]))
            rows.append(check(profile, name, actual, how, bound, actual >= bound if how == ">=" else actual <= bound))
        flags = [
            ("deployment_mode_shadow_only", F.coalesce("mode", F.lit("")), F.lit("shadow_only")),
            ("cnc_writes_disabled", F.coalesce("cnc_writes_enabled", F.lit(True)), F.lit(False)),
        ]
        if limits["needs_machine_evidence"]:
            flags.append(("real_machine_data", F.coalesce("real_machine_data", F.lit(False)), F.lit(True)))
            flags.append(("operator_approval_evidence", F.coalesce("operator_approval", F.lit(False)), F.lit(True)))
        if limits["needs_interlock"]:
            flags.append(("hardware_interlock_evidence", F.coalesce("hardware_interlock", F.lit(False)), F.lit(True)))
        rows += [check(profile, name, actual, "==", wanted, actual == wanted) for name, actual, wanted in flags]
    return metrics.select("run", F.inline(F.array(*rows)))


def gate_decisions(checks: DataFrame) -> DataFrame:
    """All checks passed, the failed ones by name, and the promotion level; actuation is never allowed."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("check"))))
    level = F.create_map(*[F.lit(x) for item in PROMOTION.items() for x in item])
    out = checks.groupBy("run", "profile").agg(F.bool_and("passed").alias("passed"), failed.alias("failed_checks"))
    return out.withColumns(
        {
            "status": F.when(F.col("passed"), "pass").otherwise("blocked"),
            "promotion_level": F.when(F.col("passed"), F.element_at(level, F.col("profile"))).otherwise("do_not_promote"),
            "hardware_actuation_allowed": F.lit(False),
        }
    )


def readiness(decisions: DataFrame) -> DataFrame:
    """Complete only when review passes and the two stricter profiles block."""
    wide = decisions.groupBy("run").pivot("profile", list(PROFILES)).agg(F.first("status"))
    good = (
        (F.col("shadow_review") == "pass")
        & (F.col("live_shadow") == "blocked")
        & (F.col("hardware_actuation") == "blocked")
    )
    return wide.withColumn(
        "readiness",
        F.when(F.coalesce(good, F.lit(False)), "good_internal_demo_complete").otherwise("needs_attention"),
    )
