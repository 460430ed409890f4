"""Shield, action mapping, guard, reward and productivity as column expressions over rows with previous overrides."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindleflow.functions.risk import clip


@dataclass(frozen=True)
class Shield:
    """Bounds, step sizes and rejection rules."""

    # Default limits.
    min_feed: float = 0.80
    max_feed: float = 1.05
    min_spindle: float = 0.90
    max_spindle: float = 1.10
    max_feed_delta: float = 0.05
    max_spindle_delta: float = 0.05
    max_uncertainty: float = 0.65
    uncertainty_mode: str = "reject"
    allow_unknown: bool = False
    modes: tuple[str, ...] = ("auto", "mdi")

    def __post_init__(self):
        if self.uncertainty_mode not in ("reject", "hold", "advisory"):
            raise ValueError("uncertainty_mode must be reject, hold or advisory")


def reasons_of(*pairs: tuple[Column, str]) -> Column:
    """Ordered array of the reasons whose condition holds."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(reason)) for condition, reason in pairs]))


def apply_shield(
    df: DataFrame,
    config: Shield,
    feed: str,
    spindle: str,
    previous_feed: str,
    previous_spindle: str,
    label: str,
    uncertainty: str,
    mode: str | None = None,
    healthy: str | None = None,
    in_cut: str | None = None,
) -> DataFrame:
    """Clip then rate-limit an action, or keep the previous overrides on rejection or hold."""
    yes = F.lit(True)
    blocked = ~F.col(mode).isin(*config.modes) if mode else F.lit(False)
    sick = ~(F.col(healthy) if healthy else yes)
    idle = ~(F.col(in_cut) if in_cut else yes)
    unknown = (F.col(label) == "unknown") & F.lit(not config.allow_unknown)
    unsure = F.col(uncertainty) > config.max_uncertainty
    reject = blocked | sick | idle | unknown | (unsure & F.lit(config.uncertainty_mode == "reject"))
    hold = ~reject & unsure & F.lit(config.uncertainty_mode == "hold")
    moving = ~reject & ~hold

    clipped_feed = clip(F.col(feed), config.min_feed, config.max_feed)
    clipped_spindle = clip(F.col(spindle), config.min_spindle, config.max_spindle)

    def near(value: Column, previous: Column, delta: float) -> Column:
        return clip(value, previous - delta, previous + delta)

    limited_feed = near(clipped_feed, F.col(previous_feed), config.max_feed_delta)
    limited_spindle = near(clipped_spindle, F.col(previous_spindle), config.max_spindle_delta)
    reasons = reasons_of(
        (blocked, "controller_mode_blocked"),
        (sick, "sensor_unhealthy"),
        (idle, "not_in_cut"),
        (unknown, "unknown_chatter_state"),
        (unsure, "high_uncertainty"),
        (hold, "uncertainty_hold"),
        (moving & (clipped_feed != F.col(feed)), "feed_clipped"),
        (moving & (clipped_spindle != F.col(spindle)), "spindle_clipped"),
        (moving & (limited_feed != clipped_feed), "feed_rate_limited"),
        (moving & (limited_spindle != clipped_spindle), "spindle_rate_limited"),
    )
    return df.withColumns(
        {
            "shield_feed_override": F.when(moving, limited_feed).otherwise(F.col(previous_feed)),
            "shield_spindle_override": F.when(moving, limited_spindle).otherwise(F.col(previous_spindle)),
            "shield_accepted": ~reject,
            "shield_rejected": reject,
            "shield_reasons": reasons,
        }
    )


def map_action(
    action: Column, previous: Column, low: float, high: float, delta: float, mapping: str = "absolute", scale: float = 1.0
) -> Column:
    """Policy action to override: ``absolute``, ``fixed`` delta, or ``headroom`` delta."""
    if mapping == "absolute":
        return action
    if mapping == "fixed":
        return previous + action * delta
    if mapping != "headroom":
        raise ValueError(f"unsupported mapping {mapping!r}")
    if scale <= 0:
        raise ValueError("action scale must be positive")
    share = clip(action / scale, -1.0, 1.0)
    up = F.least(F.lit(delta * scale), F.greatest(F.lit(0.0), high - previous))
    down = F.least(F.lit(delta * scale), F.greatest(F.lit(0.0), previous - low))
    return previous + share * F.when(share >= 0, up).otherwise(down)


def guard_action(
    df: DataFrame,
    config: Shield,
    raw_feed: str,
    raw_spindle: str,
    previous_feed: str,
    previous_spindle: str,
    candidate_label: str,
    candidate_uncertainty: str,
    enabled: bool = True,
) -> DataFrame:
    """Re-decide an action from its candidate outcome: fall back when uncertain or unknown, else clip."""
    if not enabled:
        return df.withColumns(
            {
                "guard_feed_override": F.col(raw_feed),
                "guard_spindle_override": F.col(raw_spindle),
                "guard_fallback": F.lit(0),
                "guard_reasons": F.array().cast("array<string>"),
            }
        )
    feed = clip(F.col(raw_feed), config.min_feed, config.max_feed)
    spindle = clip(F.col(raw_spindle), config.min_spindle, config.max_spindle)
    unsure = F.col(candidate_uncertainty) > config.max_uncertainty
    unknown = F.col(candidate_label) == "unknown"
    fallback = unsure | unknown
    return df.withColumns(
        {
            "guard_feed_override": F.when(fallback, F.col(previous_feed)).otherwise(feed),
            "guard_spindle_override": F.when(fallback, F.col(previous_spindle)).otherwise(spindle),
            "guard_fallback": fallback.cast("int"),
            "guard_reasons": reasons_of(
                (unsure, "high_uncertainty"),
                (unknown, "unknown_risk"),
                (feed != F.col(raw_feed), "feed_clipped"),
                (spindle != F.col(raw_spindle), "spindle_clipped"),
            ),
        }
    )


@dataclass(frozen=True)
class Reward:
    # Default weights.
    productivity_weight: float = 1.0
    productivity_mode: str = "feed"
    risk_now_weight: float = 3.0
    risk_horizon_weight: float = 1.5
    severe_penalty: float = 2.0
    smoothness_weight: float = 0.5
    rejection_penalty: float = 0.75
    clip_penalty: float = 0.0
    rate_limit_penalty: float = 0.0


def count_in(reasons: Column, *wanted: str) -> Column:
    return F.size(F.filter(reasons, lambda r: r.isin(*wanted)))


def control_reward(
    config: Reward,
    feed: Column,
    spindle: Column,
    previous_feed: Column,
    previous_spindle: Column,
    risk_now: Column,
    risk_horizon: Column,
    label: Column,
    rejected: Column,
    reasons: Column,
) -> dict[str, Column]:
    """The eight reward terms and their total."""
    raw = feed * spindle if config.productivity_mode == "mrr" else feed
    move = F.abs(feed - previous_feed) + F.abs(spindle - previous_spindle)
    terms = {
        "productivity": config.productivity_weight * raw,
        "risk_now_penalty": config.risk_now_weight * risk_now,
        "risk_horizon_penalty": config.risk_horizon_weight * risk_horizon,
        "severe_penalty": F.when(label == "severe", config.severe_penalty).otherwise(0.0),
        "smoothness_penalty": config.smoothness_weight * move,
        "rejection_penalty": F.when(rejected, config.rejection_penalty).otherwise(0.0),
        "clip_penalty": config.clip_penalty * count_in(reasons, "feed_clipped", "spindle_clipped"),
        "rate_limit_penalty": config.rate_limit_penalty
        * count_in(reasons, "feed_rate_limited", "spindle_rate_limited"),
    }
    total = terms["productivity"]
    for name, term in terms.items():
        if name != "productivity":
            total = total - term
    return {**terms, "control_reward": total}


def guard_penalty(config: Reward, enabled: Column, reasons: Column) -> Column:
    """Extra clip penalty of an enabled guard."""
    return F.when(enabled, config.clip_penalty * count_in(reasons, "feed_clipped", "spindle_clipped")).otherwise(0.0)


def productivity_proxy(feed: Column, spindle: Column) -> Column:
    return feed * spindle


def action_active(feed: Column, spindle: Column, base_feed=1.0, base_spindle=1.0) -> Column:
    """Whether an override differs from its base by more than 1e-9."""
    return (F.abs(feed - base_feed) > 1e-9) | (F.abs(spindle - base_spindle) > 1e-9)


def trace_to_recommendations(df: DataFrame, profile: str, source: str) -> DataFrame:
    """Action-trace rows as shadow recommendations; nothing here can write to a machine."""
    active = action_active(
        F.col("shield_feed_override"),
        F.col("shield_spindle_override"),
        F.col("previous_feed_override"),
        F.col("previous_spindle_override"),
    )
    same = [
        "scenario", "episode", "step", "controller", "risk_label", "risk_uncertainty", "current_margin",
        "current_uncertainty", "previous_feed_override", "previous_spindle_override", "raw_feed_override",
        "raw_spindle_override", "guard_feed_override", "guard_spindle_override", "candidate_guard_enabled",
        "guard_fallback", "guard_reasons", "shield_rejected", "shield_reasons",
    ]
    return df.select(
        F.lit(profile).alias("profile_label"),
        F.lit(source).alias("source_model_path"),
        *[c for c in same if c in df.columns],
        F.col("risk_now").alias("risk_chatter_now"),
        F.col("risk_horizon").alias("risk_chatter_horizon"),
        F.col("shield_feed_override").alias("feed_override"),
        F.col("shield_spindle_override").alias("spindle_override"),
        productivity_proxy(F.col("shield_feed_override"), F.col("shield_spindle_override")).alias("relative_mrr_proxy"),
        active.alias("action_active"),
        active.alias("shadow_warning"),
        F.lit(False).alias("cnc_write_enabled"),
        F.lit(True).alias("shadow_only"),
    )
