"""Shadow-mode recommendation tables: burden, outcome summaries, candidate grids and selection policies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindleflow.functions.control import Shield, action_active
from spindleflow.functions.physics import Cut, MarginCalibration, Modal, Tool, calibrated, margins_at
from spindleflow.functions.risk import clip, sigmoid
from spindleflow.operators.metrics import count_if, ratio
from spindleflow.operators.scan import Layout
from spindleflow.operators.sequence import hysteresis, rate_limit


@dataclass(frozen=True)
class ShadowPolicy:
    # Default overrides, bounds and steps.
    threshold: float = 0.5
    clear: float | None = None
    warning_feed: float = 0.92
    warning_spindle: float = 1.04
    feed_bounds: tuple[float, float] = (0.80, 1.05)
    spindle_bounds: tuple[float, float] = (0.90, 1.10)
    max_feed_delta: float = 0.05
    max_spindle_delta: float = 0.05

    def __post_init__(self):
        if not 0 <= self.threshold <= 1:
            raise ValueError("threshold must be in [0, 1]")
        if self.feed_bounds[0] > self.feed_bounds[1] or self.spindle_bounds[0] > self.spindle_bounds[1]:
            raise ValueError("lower bound exceeds upper bound")
        if min(self.warning_feed, self.warning_spindle, self.max_feed_delta, self.max_spindle_delta) <= 0:
            raise ValueError("overrides and steps must be positive")


def recommend(df: DataFrame, layout: Layout, score: str, policy: ShadowPolicy) -> DataFrame:
    """Warnings with hysteresis, then rate-limited overrides, activity and productivity."""
    warned = hysteresis(df, layout, score, policy.threshold, policy.clear)
    moved = rate_limit(
        warned,
        layout,
        "shadow_warning",
        {
            "feed_override": (policy.warning_feed, *policy.feed_bounds, policy.max_feed_delta),
            "spindle_override": (policy.warning_spindle, *policy.spindle_bounds, policy.max_spindle_delta),
        },
    )
    feed, spindle = F.col("feed_override"), F.col("spindle_override")
    return moved.withColumns({"action_active": action_active(feed, spindle), "relative_mrr_proxy": feed * spindle})


def burden(recs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """How often the policy warns and acts, and what it costs."""
    out = recs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("windows"),
        count_if(F.col("shadow_warning")).alias("warning_windows"),
        count_if(F.col("action_active")).alias("action_windows"),
        F.avg("feed_override").alias("mean_feed_override"),
        F.avg("spindle_override").alias("mean_spindle_override"),
        F.avg("relative_mrr_proxy").alias("relative_mrr_proxy"),
    )
    return out.withColumns(
        {
            "warning_fraction": ratio(F.col("warning_windows"), F.col("windows")),
            "action_fraction": ratio(F.col("action_windows"), F.col("windows")),
            "relative_mrr_loss_proxy": F.greatest(F.lit(0.0), 1.0 - F.col("relative_mrr_proxy")),
        }
    )


def outcome_summary(outcomes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Baseline against shadow risk over windows."""
    c = F.col
    return outcomes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("windows"),
        F.avg(c("action_active").cast("double")).alias("action_fraction"),
        F.avg("relative_mrr_proxy").alias("relative_mrr_proxy"),
        F.avg("baseline_risk").alias("mean_baseline_risk"),
        F.avg("shadow_risk").alias("mean_shadow_risk"),
        F.avg("risk_reduction").alias("mean_risk_reduction"),
        F.avg((c("risk_reduction") > 0).cast("double")).alias("positive_risk_reduction_fraction"),
        F.avg(c("baseline_chatter").cast("double")).alias("baseline_chatter_fraction"),
        F.avg(c("shadow_chatter").cast("double")).alias("shadow_chatter_fraction"),
    )


def outcome_episodes(outcomes: DataFrame, keys: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Events before and after, mitigated and worsened episodes, mean of episode means."""
    c = F.col
    episodes = outcomes.groupBy(*by, *keys).agg(
        F.bool_or("baseline_chatter").alias("before"),
        F.bool_or("shadow_chatter").alias("after"),
        F.avg("risk_reduction").alias("gain"),
    )
    return episodes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("episode_count"),
        count_if(c("before")).alias("baseline_event_episodes"),
        count_if(c("after")).alias("shadow_event_episodes"),
        count_if(c("before") & ~c("after")).alias("mitigated_event_episodes"),
        count_if(c("after") & ~c("before")).alias("worsened_event_episodes"),
        F.avg("gain").alias("mean_episode_risk_reduction"),
    )


def policy_summary(rows: DataFrame, measure: str, over: str = "shadow_warning", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of a selection policy and the mean of its gain over warnings (or over actions), 0 when none."""
    c = F.col
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("windows"),
        count_if(c("shadow_warning")).alias("warning_windows"),
        count_if(c("action_active")).alias("action_windows"),
        F.avg("relative_mrr_proxy").alias("mean_relative_mrr_proxy"),
        F.coalesce(F.avg(F.when(c(over), c(measure))), F.lit(0.0)).alias(f"mean_{measure}"),
    )
    return out.withColumns(
        {
            "warning_fraction": ratio(c("warning_windows"), c("windows")),
            "action_fraction": ratio(c("action_windows"), c("windows")),
        }
    )


def replay_summary(recs: DataFrame) -> DataFrame:
    """Replay statistics of all recommendations (scenario NULL) and per scenario, in one grouping."""
    c = F.col
    # Episodes are counted exactly by aggregating to episodes first; sums and maxima then combine.
    episodes = recs.groupBy("scenario", "episode").agg(
        F.count(F.lit(1)).alias("n"),
        count_if(c("action_active")).alias("a"),
        F.sum(c("guard_fallback").cast("long")).alias("g"),
        F.sum(c("shield_rejected").cast("long")).alias("r"),
        F.max("risk_chatter_now").alias("top"),
        *[
            F.sum(x).alias(f"s_{x}")
            for x in ("risk_chatter_now", "risk_chatter_horizon", "feed_override", "spindle_override", "relative_mrr_proxy")
        ],
    )
    out = episodes.rollup("scenario").agg(
        F.sum("n").alias("recommendation_windows"),
        F.count(F.lit(1)).alias("episodes"),
        F.sum("a").alias("action_windows"),
        F.sum("g").alias("guard_fallbacks"),
        F.sum("r").alias("shield_rejections"),
        F.max("top").alias("max_risk"),
        (F.sum("s_risk_chatter_now") / F.sum("n")).alias("mean_risk"),
        (F.sum("s_risk_chatter_horizon") / F.sum("n")).alias("mean_horizon_risk"),
        (F.sum("s_feed_override") / F.sum("n")).alias("mean_feed_override"),
        (F.sum("s_spindle_override") / F.sum("n")).alias("mean_spindle_override"),
        (F.sum("s_relative_mrr_proxy") / F.sum("n")).alias("relative_mrr_proxy"),
    )
    return out.withColumns(
        {
            "action_fraction": ratio(c("action_windows"), c("recommendation_windows")),
            "guard_fallback_fraction": ratio(c("guard_fallbacks"), c("recommendation_windows")),
        }
    )


# ---- candidate grids ------------------------------------------------------------------------------------------


def grid_values(values: tuple[float, ...]) -> list[float]:
    """Candidate values with 1.0 added, distinct, ascending."""
    if any(v <= 0 for v in values):
        raise ValueError("candidate values must be positive")
    return sorted({1.0, *values})


def candidate_grid(df: DataFrame, feeds: tuple[float, ...], spindles: tuple[float, ...], warning: str) -> DataFrame:
    """Each window with every (feed, spindle) of the grid; windows without a warning keep 1.0.

    The grid is a literal array exploded inside the row, so nothing is joined or broadcast.
    """
    pairs = [(f, s) for f in grid_values(feeds) for s in grid_values(spindles)]
    grid = F.array(
        *[
            F.struct(F.lit(i).alias("candidate"), F.lit(f).alias("candidate_feed"), F.lit(s).alias("candidate_spindle"))
            for i, (f, s) in enumerate(pairs)
        ]
    )
    on, one = F.col(warning), F.lit(1.0)
    return df.select("*", F.inline(grid)).withColumns(
        {
            "applied_feed": F.when(on, F.col("candidate_feed")).otherwise(one),
            "applied_spindle": F.when(on, F.col("candidate_spindle")).otherwise(one),
        }
    )


def sweep_best(sweep: DataFrame) -> DataFrame:
    """Best grid point: mean reduction, then productivity, then fewest worsened episodes, then grid order."""
    order = F.struct(
        F.round("mean_risk_reduction", 12),
        F.round("relative_mrr_proxy", 12),
        -F.col("worsened_event_episodes"),
        -F.col("candidate"),
    )
    return sweep.agg(F.max_by(F.struct(*sweep.columns), order).alias("b")).select("b.*")




def _in_row(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later expressions may use many times without being copied into them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def margin_policy(
    df: DataFrame,
    warning: str,
    modal: Modal,
    tool: Tool,
    cut: Cut,
    bounds: tuple[float, float] = (0.90, 1.10),
    count: int = 21,
    feed: float = 1.0,
    min_gain: float = 0.05,
    weights: tuple[float, float, float] = (1.0, 0.03, 0.08),
) -> DataFrame:
    """Pick a spindle override by stability margin for warning windows; a row-wise job without any exchange.

    Staying at 1.0 is the first candidate, so a later one must score strictly higher.  The score is kept even when
    the gain is too small to act.  Quiet windows have the one candidate 1.0, so only warnings pay for the scan.
    """
    step = (bounds[1] - bounds[0]) / (count - 1)
    spindles = F.array(*[F.lit(bounds[0] + step * i) for i in range(count)])
    w_gain, w_prod, w_move = weights
    stay = F.array(F.lit(1.0))
    rows = _in_row(df, _o=F.when(F.col(warning), F.concat(stay, spindles)).otherwise(stay))
    rows = rows.withColumn("_m", margins_at(modal, tool, cut, F.col("_o")))
    base = F.col("_m")[0]

    def scored(x: Column, i: Column) -> Column:
        score = w_gain * (x["_m"] - base) + w_prod * feed * x["_o"] - w_move * F.abs(x["_o"] - 1.0)
        return F.struct(score.alias("score"), (-i).alias("i"), x["_o"].alias("s"), x["_m"].alias("m"))

    rows = _in_row(rows, _b=F.array_max(F.transform(F.arrays_zip("_o", "_m"), scored)), baseline_margin_physics=base)
    improvement = F.col("_b.m") - F.col("baseline_margin_physics")
    act = F.col(warning) & (improvement >= min_gain) & (F.abs(F.col("_b.s") - 1.0) > 1e-12)
    out = rows.withColumns(
        {
            "selected_action_score": F.col("_b.score"),
            "action_active": act,
            "feed_override": F.when(act, F.lit(feed)).otherwise(1.0),
            "spindle_override": F.when(act, F.col("_b.s")).otherwise(1.0),
            "selected_margin_physics": F.when(act, F.col("_b.m")).otherwise(F.col("baseline_margin_physics")),
            "selected_margin_improvement": F.when(act, improvement).otherwise(0.0),
        }
    )
    return out.withColumn("relative_mrr_proxy", F.col("feed_override") * F.col("spindle_override")).drop("_o", "_m", "_b")


def margin_uncertainty(margin: Column, width: float = 0.22) -> Column:
    return F.least(F.lit(0.95), 0.12 + 0.55 * F.exp(-F.abs(margin) / max(width, 1e-6)))


def _reach(current: Column, delta: float, low: float, high: float, count: int) -> Column:
    """``count`` evenly spaced values within one step of the current override and inside the bounds."""
    lo, hi = F.greatest(F.lit(low), current - delta), F.least(F.lit(high), current + delta)
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: lo + (hi - lo) * i / float(count - 1))


def _candidates(df: DataFrame, options: Column, modal: Modal, tool: Tool, cut: Cut) -> DataFrame:
    """Candidate spindle overrides ``_o`` of each row with their raw margins ``_m``."""
    return _in_row(df, _o=options).withColumn("_m", margins_at(modal, tool, cut, F.col("_o")))


def _margin_and_uncertainty(raw: Column, calibration: MarginCalibration | None, columns, floor: Column | None):
    """Margin, and the largest of its own, the calibrated and a floor uncertainty."""
    if calibration is None:
        own = margin_uncertainty(raw)
        return raw, own if floor is None else F.greatest(floor, own)
    values = calibrated(calibration, columns, raw)
    margin = values["calibrated_margin"]
    return margin, F.greatest(values["calibrated_uncertainty"], margin_uncertainty(margin))


def lobe_schedule(
    df: DataFrame,
    key: str,
    modal: Modal,
    tool: Tool,
    cut: Cut,
    shield: Shield | None = None,
    calibration: MarginCalibration | None = None,
    feed: str = "last_feed_override",
    spindle: str = "last_spindle_override",
    risk: str = "risk_chatter_now",
) -> DataFrame:
    """Schedule the spindle by margin within one step, skip too uncertain moves, step the feed by risk."""
    shield = shield or Shield()
    current = F.col(spindle)
    rows = _candidates(
        df, _reach(current, shield.max_spindle_delta, shield.min_spindle, shield.max_spindle, 17), modal, tool, cut
    )

    def scored(x: Column, i: Column) -> Column:
        margin, unsure = _margin_and_uncertainty(x["_m"], calibration, df.columns, None)
        score = margin - 0.80 * unsure - 0.05 * F.abs(x["_o"] - current) - 0.01 * F.abs(x["_o"] - 1.0)
        allowed = (unsure <= shield.max_uncertainty) | (x["_o"] == current)
        return F.when(allowed, F.struct(score.alias("score"), (-i).alias("i"), x["_o"].alias("c")))

    rows = _in_row(rows, _b=F.array_max(F.transform(F.arrays_zip("_o", "_m"), scored)))
    last, now = F.col(feed), F.col(risk)
    next_feed = (
        F.when(now >= 0.80, F.greatest(F.lit(0.90), last - 0.03))
        .when(now < 0.35, F.least(F.lit(1.0), last + 0.5 * 0.03))
        .otherwise(last)
    )
    return rows.select(
        key,
        next_feed.alias("feed_override"),
        F.coalesce(F.col("_b.c"), current).alias("spindle_override"),
        F.col("_b.score").alias("schedule_score"),
    )


def lookahead_schedule(
    df: DataFrame,
    key: str,
    modal: Modal,
    tool: Tool,
    cut: Cut,
    shield: Shield | None = None,
    calibration: MarginCalibration | None = None,
    feed: str = "last_feed_override",
    spindle: str = "last_spindle_override",
    risk: str = "risk_chatter_now",
    uncertainty: str = "uncertainty",
) -> DataFrame:
    """Best of a 7 x 9 grid by expected risk, productivity, smoothness and uncertainty.

    The margin depends on the spindle only, so nine margins per row are solved and the seven feeds reuse them.
    """
    shield = shield or Shield()
    c = F.col
    rows = _candidates(
        df, _reach(c(spindle), shield.max_spindle_delta, shield.min_spindle, shield.max_spindle, 9), modal, tool, cut
    )
    rows = _in_row(
        rows,
        _g=_reach(c(feed), shield.max_feed_delta, shield.min_feed, shield.max_feed, 7),
        _z=F.transform(
            F.arrays_zip("_o", "_m"),
            lambda x: F.struct(
                x["_o"].alias("s"),
                *[
                    value.alias(name)
                    for name, value in zip(("m", "u"), _margin_and_uncertainty(x["_m"], calibration, df.columns, c(uncertainty)))
                ],
            ),
        ),
    )

    def scored(f: Column, k: Column):
        def at(z: Column, j: Column) -> Column:
            s, margin, unsure = z["s"], z["m"], z["u"]
            expected = clip(
                0.65 * sigmoid(-margin / 0.22) + 0.35 * c(risk) - 0.25 * F.greatest(F.lit(0.0), 1.0 - f), 0.0, 1.0
            )
            climb = F.when((c(risk) > 0.70) & (f > c(feed)), 4.0 * (f - c(feed))).otherwise(0.0)
            score = (
                f * s
                - 2.8 * expected
                - 0.45 * (F.abs(f - c(feed)) + F.abs(s - c(spindle)))
                - 0.35 * c(uncertainty)
                - 0.90 * unsure
                - 3.0 * F.greatest(F.lit(0.0), unsure - shield.max_uncertainty)
                - F.when(margin < -1.0, 0.75).otherwise(0.0)
                - climb
            )
            allowed = (unsure <= shield.max_uncertainty) | ((f == c(feed)) & (s == c(spindle)))
            return F.when(
                allowed,
                F.struct(score.alias("score"), (-(k * 9 + j)).alias("i"), f.alias("f"), s.alias("s")),
            )

        return at

    options = F.flatten(F.transform("_g", lambda f, k: F.transform("_z", scored(f, k))))
    rows = _in_row(rows, _b=F.array_max(options))
    return rows.select(
        key,
        F.coalesce(c("_b.f"), c(feed)).alias("feed_override"),
        F.coalesce(c("_b.s"), c(spindle)).alias("spindle_override"),
        F.col("_b.score").alias("lookahead_score"),
    )


def outcome_policy(
    windows: DataFrame,
    outcomes: DataFrame,
    warning: str,
    min_reduction: float = 0.005,
    weights: tuple[float, float, float] = (1.0, 0.02, 0.04),
    margin_weight: float = 0.0,
    max_worsening: float | None = None,
    min_margin_gain: float = 0.05,
) -> DataFrame:
    """Choose among candidate outcomes per window by reduction, productivity and move.

    ``windows``: window_id, baseline_risk, warning flag.  ``outcomes``: window_id, candidate (grid order), feed,
    spindle, risk, and ``margin_gain`` for the hybrid form (``margin_weight`` > 0, with a veto on worsening).
    """
    c = F.col
    w_red, w_prod, w_move = weights
    hybrid = margin_weight > 0
    rows = windows.select("window_id", "baseline_risk", F.col(warning).alias("_on")).join(outcomes, "window_id")
    reduction = c("baseline_risk") - c("risk")
    score = (
        w_red * reduction
        + w_prod * c("feed") * c("spindle")
        - w_move * (F.abs(c("feed") - 1.0) + F.abs(c("spindle") - 1.0))
    )
    if hybrid:
        score = score + margin_weight * c("margin_gain")
    allowed = F.lit(True) if max_worsening is None else reduction >= -max_worsening
    stay = w_red * 0.0 + w_prod * 1.0
    fields = [score.alias("score"), (-c("candidate")).alias("i"), c("feed"), c("spindle"), reduction.alias("reduction")]
    if hybrid:
        fields.append(c("margin_gain"))
    best = rows.groupBy("window_id").agg(
        F.max(F.when(c("_on") & allowed & (score > stay), F.struct(*fields))).alias("_b")
    )
    out = windows.join(best, "window_id", "left")
    strong = c("_b.reduction") >= min_reduction
    if hybrid:
        strong = strong | (c("_b.margin_gain") >= min_margin_gain)
    moved = (F.abs(c("_b.feed") - 1.0) > 1e-12) | (F.abs(c("_b.spindle") - 1.0) > 1e-12)
    act = F.coalesce(c(warning) & strong & moved, F.lit(False))
    gain = F.when(act, c("_b.reduction")).otherwise(0.0)
    return out.withColumns(
        {
            "action_active": act,
            "feed_override": F.when(act, c("_b.feed")).otherwise(1.0),
            "spindle_override": F.when(act, c("_b.spindle")).otherwise(1.0),
            "selected_risk_reduction": gain,
            "selected_risk": c("baseline_risk") - gain,
            "selected_action_score": F.coalesce(c("_b.score"), F.lit(stay)),
        }
    ).withColumn("relative_mrr_proxy", c("feed_override") * c("spindle_override")).drop("_b")


def rule_schedule(risk: Column, feed: Column, spindle: Column) -> dict[str, Column]:
    """Threshold rules: high risk slows the feed and speeds the spindle, low risk recovers."""
    high, mid = risk >= 0.70, risk >= 0.45
    return {
        "rule_feed": F.when(high, F.greatest(F.lit(0.82), feed - 0.04)).when(mid, feed).otherwise(F.least(F.lit(1.0), feed + 0.02)),
        "rule_spindle": F.when(high, F.least(F.lit(1.10), spindle + 0.04))
        .when(mid, F.least(F.lit(1.08), spindle + 0.02))
        .otherwise(spindle + 0.25 * (1.0 - spindle)),
    }


# State bin edges and action steps of the table policy.
STATE_BINS = {
    "feed_override": (0.85, 0.95, 1.00, 1.05),
    "spindle_override": (0.92, 0.98, 1.02, 1.08),
    "risk_now": (0.35, 0.45, 0.60, 0.75),
    "risk_horizon": (0.35, 0.45, 0.60, 0.75),
    "margin_physics": (-0.30, -0.05, 0.05, 0.30),
    "uncertainty": (0.35, 0.55, 0.65),
}
ACTION_STEPS = tuple((f, s) for f in (-0.05, 0.0, 0.05) for s in (-0.05, 0.0, 0.05))


def state_key(columns: dict[str, Column]) -> Column:
    """Bin numbers of the six state columns joined with ':'."""

    def bin_of(value: Column, edges: tuple[float, ...]) -> Column:
        return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: value >= e)).cast("string")

    return F.concat_ws(":", *[bin_of(columns[name], edges) for name, edges in STATE_BINS.items()])


def table_policy(df: DataFrame, table: DataFrame, columns: dict[str, Column], shield: Shield | None = None) -> DataFrame:
    """First-best action of a policy table (state_key, action_values); an unknown state counts as all zeros."""
    shield = shield or Shield()
    zeros = F.array(*[F.lit(0.0)] * len(ACTION_STEPS))
    keyed = df.withColumn("state_key", state_key(columns)).join(table, "state_key", "left")
    values = F.coalesce("action_values", zeros)
    # Equal up to relative 1e-5 and absolute 1e-8 counts as equal to the best.
    top = F.array_max(values)
    near = F.transform(values, lambda v: F.abs(v - top) <= 1e-8 + 1e-5 * F.abs(top))
    action = (F.array_position(near, F.lit(True)) - 1).cast("int")
    steps = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(s).alias("s")) for f, s in ACTION_STEPS])
    step = F.get(steps, F.col("action"))
    return keyed.withColumn("action", action).withColumns(
        {
            "policy_feed": clip(columns["feed_override"] + step["f"], shield.min_feed, shield.max_feed),
            "policy_spindle": clip(columns["spindle_override"] + step["s"], shield.min_spindle, shield.max_spindle),
        }
    ).drop("action_values")
