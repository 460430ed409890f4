"""Analytics over logged decision traces and many evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindleflow.functions.labels import id_of_label, label_of_id
from spindleflow.operators.metrics import count_if, ratio
from spindleflow.operators.scan import Running, one_row, scan
from spindleflow.operators.staging import staged


def episode_metrics(trace: DataFrame, keys: tuple[str, ...], step: str = "step") -> DataFrame:
    """Totals and means of each episode, with the last risk and label by step order."""
    # Numbers only in the aggregation buffers: labels travel as ids, so this stays a hash aggregation.
    out = trace.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("steps"),
        F.sum("reward").alias("total_reward"),
        F.avg("risk_now").alias("mean_risk"),
        F.max("risk_now").alias("max_risk"),
        F.max_by("risk_now", step).alias("final_risk"),
        F.max_by(id_of_label(F.col("risk_label")), F.col(step)).alias("_last"),
        count_if(F.col("risk_label") == "severe").alias("severe_steps"),
        F.avg("shield_feed_override").alias("mean_feed_override"),
        F.avg("shield_spindle_override").alias("mean_spindle_override"),
        F.sum(F.col("shield_rejected").cast("long")).alias("shield_rejections"),
    )
    return out.withColumns(
        {
            "final_label": label_of_id(F.col("_last")),
            "severe_fraction": ratio(F.col("severe_steps"), F.col("steps")),
            "relative_mrr_proxy": F.col("mean_feed_override") * F.col("mean_spindle_override"),
        }
    ).drop("_last")


def summary_metrics(episodes: DataFrame, by: tuple[str, ...] = ("controller", "scenario")) -> DataFrame:
    return episodes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("episodes"),
        F.avg("total_reward").alias("mean_total_reward"),
        F.avg("mean_risk").alias("mean_risk"),
        F.max("max_risk").alias("max_risk"),
        F.avg("final_risk").alias("mean_final_risk"),
        F.avg("severe_fraction").alias("severe_fraction"),
        F.avg("mean_feed_override").alias("mean_feed_override"),
        F.avg("mean_spindle_override").alias("mean_spindle_override"),
        F.sum("shield_rejections").alias("shield_rejections"),
        F.avg("relative_mrr_proxy").alias("relative_mrr_proxy"),
    )


SEED_MEASURES = ("mean_total_reward", "mean_risk", "mean_final_risk", "severe_fraction", "relative_mrr_proxy")


def seed_aggregate(
    summaries: DataFrame, by: tuple[str, ...] = ("training_algorithm", "controller", "scenario")
) -> DataFrame:
    """Mean and sample deviation over seeds; a single seed has deviation 0."""
    return summaries.groupBy(*by).agg(
        F.count_distinct("seed").alias("seeds"),
        F.sum("episodes").alias("episodes"),
        *[F.avg(m).alias(f"{m}_mean") for m in SEED_MEASURES],
        *[F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_std") for m in SEED_MEASURES],
        F.sum("shield_rejections").alias("shield_rejections_sum"),
        F.avg("shield_rejections").alias("shield_rejections_mean"),
    )


# Mean of each of these columns; blanks are NULL and do not count.
def _trace_means() -> dict[str, Column]:
    c = F.col
    return {
        "mean_raw_feed_override": c("raw_feed_override"),
        "mean_raw_spindle_override": c("raw_spindle_override"),
        "mean_guard_feed_override": c("guard_feed_override"),
        "mean_guard_spindle_override": c("guard_spindle_override"),
        "mean_shield_feed_override": c("shield_feed_override"),
        "mean_shield_spindle_override": c("shield_spindle_override"),
        "mean_abs_guard_feed_delta": F.abs(c("guard_feed_override") - c("raw_feed_override")),
        "mean_abs_guard_spindle_delta": F.abs(c("guard_spindle_override") - c("raw_spindle_override")),
        "mean_abs_shield_feed_delta": F.abs(c("shield_feed_override") - c("guard_feed_override")),
        "mean_abs_shield_spindle_delta": F.abs(c("shield_spindle_override") - c("guard_spindle_override")),
        "mean_guard_candidate_risk": c("guard_candidate_risk"),
        "mean_guard_candidate_uncertainty": c("guard_candidate_uncertainty"),
        "mean_current_risk": c("risk_now"),
        "mean_current_uncertainty": c("risk_uncertainty"),
    }


def trace_diagnostics(trace: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Fallback, rejection and override statistics of each group of steps; means of nothing are 0."""
    return trace.groupBy(*by).agg(
        F.count(F.lit(1)).alias("steps"),
        F.sum(F.col("guard_fallback").cast("long")).alias("guard_fallbacks"),
        F.avg(F.col("guard_fallback").cast("double")).alias("guard_fallback_fraction"),
        F.sum(F.col("shield_rejected").cast("long")).alias("shield_rejections"),
        F.avg(F.col("shield_rejected").cast("double")).alias("shield_rejection_fraction"),
        *[F.coalesce(F.avg(expr), F.lit(0.0)).alias(name) for name, expr in _trace_means().items()],
    )


def pooled_diagnostics(
    diagnostics: DataFrame, by: tuple[str, ...] = ("training_algorithm", "controller", "scenario")
) -> DataFrame:
    """Second level: counts summed, fractions recomputed, means averaged over seeds."""
    out = diagnostics.groupBy(*by).agg(
        F.count_distinct("seed").alias("seeds"),
        *[F.sum(c).alias(c) for c in ("steps", "guard_fallbacks", "shield_rejections")],
        *[F.avg(name).alias(name) for name in _trace_means()],
    )
    return out.withColumns(
        {
            "guard_fallback_fraction": ratio(F.col("guard_fallbacks"), F.col("steps")),
            "shield_rejection_fraction": ratio(F.col("shield_rejections"), F.col("steps")),
        }
    )


def _joined_counts(counts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``a:2;b:1`` per group: one entry per distinct reason, so the list stays as short as the vocabulary."""
    pairs = F.array_sort(F.collect_list(F.struct("reason", "n")))
    text = F.transform(pairs, lambda p: F.concat(p["reason"], F.lit(":"), p["n"].cast("string")))
    return counts.groupBy(*by).agg(F.array_join(text, ";").alias("reason_counts"))


def reason_counts(df: DataFrame, reasons: Column, by: tuple[str, ...]) -> DataFrame:
    """Count reasons given as an array; groups without any reason are kept with an empty text."""
    items = df.select(*by, F.explode_outer(reasons).alias("reason"))
    items = items.withColumn("reason", F.nullif(F.trim("reason"), F.lit("")))
    counts = items.groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("n"))
    named = counts.where(F.col("reason").isNotNull())
    every = counts.select(*by).distinct()
    return every.join(_joined_counts(named, by), list(by), "left").na.fill("", ["reason_counts"])


def merge_reason_counts(df: DataFrame, text: str, by: tuple[str, ...]) -> DataFrame:
    """Add up ``a:2;b:1`` texts; malformed items are skipped."""
    items = df.select(*by, F.explode(F.split(F.col(text), ";")).alias("item"))
    parts = items.select(
        *by,
        F.regexp_extract(F.trim("item"), r"^(.*):([^:]*)$", 1).alias("reason"),
        F.regexp_extract(F.trim("item"), r"^(.*):([^:]*)$", 2).try_cast("long").alias("n"),
    ).where((F.col("n").isNotNull()) & (F.col("reason") != ""))
    summed = parts.groupBy(*by, "reason").agg(F.sum("n").alias("n"))
    return df.select(*by).distinct().join(_joined_counts(summed, by), list(by), "left").na.fill("", ["reason_counts"])


def pareto_front(
    df: DataFrame, by: list[str], low: str, high: str, parts: int = 65_536, name: str = "pareto_efficient"
) -> DataFrame:
    """Keep ``low`` small and ``high`` large: a row is efficient when no other is at least as good on both and
    better on one.  Sort by ``low`` and compare with the running best ``high``; equal rows do not dominate."""
    df = staged(df, "front")
    best = df.groupBy(*by, low).agg(F.max(high).alias("_top"))
    ranked = scan(
        best,
        by,
        F.floor(F.col(low) * parts).cast("long"),
        [low],
        {"_better": Running("max", F.col("_top"), inclusive=False)},
    )
    joined = df.join(ranked, [*by, low])
    dominated = (F.col(high) < F.col("_top")) | F.coalesce(F.col("_better") >= F.col(high), F.lit(False))
    return joined.withColumn(name, ~dominated).drop("_top", "_better")


def pareto_front3(
    df: DataFrame, key: list[str], low: str, high: str, count: str, parts: int = 65_536, name: str = "pareto_efficient"
) -> DataFrame:
    """Three-way front: ``low`` and the whole number ``count`` small, ``high`` large.

    Row r is beaten by rows with a count at most r's.  Every count range 0..c splits into binary blocks, one for
    each bit of the largest count; a row offers itself to the blocks that contain its count and asks the blocks that make up 0..c.  Inside a block
    the question is the two-way one: the running best ``high`` along ``low``.  No pair of rows is ever formed.
    """
    df = staged(df, "front")
    base = df.select(*key, F.col(low).alias("_l"), F.col(high).alias("_h"), F.col(count).cast("long").alias("_c"))
    base = base.withColumn("_c", F.when(F.col("_c") < 0, F.raise_error(F.lit(f"{count} must not be negative"))).otherwise(F.col("_c")))
    # Bits of the largest count plus one: no block above them is ever asked.
    top = df.agg(F.coalesce(F.length(F.bin(F.max(F.col(count).cast("long")) + 1)), F.lit(1)).alias("bits"))
    base = base.withColumn("_bits", one_row(top)["bits"])
    levels = F.sequence(F.lit(0), F.col("_bits"))
    n = F.col("_c") + 1  # the prefix 0..c as the half-open range [0, n)

    def block(size_bit: Column, start: Column) -> Column:
        return F.struct(size_bit.alias("bit"), start.alias("at"))

    holds = F.transform(levels, lambda b: block(b, F.call_function("shiftright", F.col("_c"), b)))
    asks = F.transform(
        F.filter(levels, lambda b: F.call_function("shiftright", n, b) % 2 == 1),
        lambda b: block(b, F.call_function("shiftright", n, b) - 1),
    )
    # Best (high, then smallest count) a block can offer at each low.
    offers = (
        base.groupBy("_l", "_c")
        .agg(F.max("_h").alias("_h"), F.max("_bits").alias("_bits"))
        .select("_l", F.inline(holds), F.struct(F.col("_h"), (-F.col("_c")).alias("_c")).alias("_offer"))
        .groupBy("bit", "at", "_l")
        .agg(F.max("_offer").alias("_offer"))
    )
    offers = scan(
        offers,
        ["bit", "at"],
        F.floor(F.col("_l") * parts).cast("long"),
        ["_l"],
        {"_before": Running("max", F.col("_offer"), inclusive=False)},
    )
    # Rows alike in all three measures share a verdict, and questions at one low of a block share what they meet there:
    # each (block, low) is looked up once, so a low that many rows have in common does not fill a task.
    questions = base.groupBy("_l", "_h", "_c").agg(F.max("_bits").alias("_bits")).select("_l", "_h", "_c", F.inline(asks))
    # An offer at the same low must be strictly better; one from a smaller low may also be equal.
    both = questions.select("bit", "at", "_l").distinct().withColumn("_ask", F.lit(1)).unionByName(
        offers.select("bit", "at", "_l", F.struct("_l", "_offer", "_before").alias("_seen"), F.lit(0).alias("_ask")),
        allowMissingColumns=True,
    )
    answered = scan(
        both,
        ["bit", "at"],
        F.floor(F.col("_l") * parts).cast("long"),
        ["_l", "_ask"],
        {"_near": Running("last", F.col("_seen"))},
    ).where((F.col("_ask") == 1) & F.col("_near").isNotNull())
    mine, near = F.struct(F.col("q._h"), (-F.col("q._c")).alias("_c")), F.col("a._near")
    at_same = near["_l"] == F.col("q._l")
    beaten = (
        (near["_offer"] > mine)
        | (~at_same & (near["_offer"] >= mine))
        | F.coalesce(near["_before"] >= mine, F.lit(False))
    )
    same_low = [F.col(f"q.{c}").eqNullSafe(F.col(f"a.{c}")) for c in ("bit", "at", "_l")]
    losers = questions.alias("q").join(answered.alias("a"), same_low).where(F.coalesce(beaten, F.lit(False)))
    losers = losers.select("q._l", "q._h", "q._c").distinct().withColumn("_beaten", F.lit(True))
    same = [F.col(c).eqNullSafe(losers[k]) for c, k in ((low, "_l"), (high, "_h"))] + [F.col(count).cast("long").eqNullSafe(losers["_c"])]
    return df.join(losers, same, "left").withColumn(name, F.col("_beaten").isNull()).drop("_beaten", "_l", "_h", "_c")


def delta_vs_baseline(summary: DataFrame, baseline: str, profile: str = "profile") -> DataFrame:
    """Each profile's change against the baseline profile on the same algorithm, controller and scenario."""
    keys = ["training_algorithm", "controller", "scenario"]
    measures = {
        "delta_mean_risk": "mean_risk_mean",
        "delta_relative_mrr_proxy": "relative_mrr_proxy_mean",
        "delta_mean_reward": "mean_total_reward_mean",
        "delta_shield_rejections": "shield_rejections_sum",
    }
    base = summary.where(F.col(profile) == baseline).select(*keys, *[F.col(c).alias(f"_b_{c}") for c in measures.values()])
    rest = summary.where(F.col(profile) != baseline).join(base, keys)
    return rest.select(
        profile,
        F.lit(baseline).alias("baseline_profile"),
        *keys,
        *[(F.col(c) - F.col(f"_b_{c}")).cast("double").alias(name) for name, c in measures.items()],
    )


def mean_where(condition: Column, value: Column) -> Column:
    """Mean over the rows that satisfy a condition, 0 when there is none."""
    return F.coalesce(F.avg(F.when(condition, value)), F.lit(0.0))


def candidate_summary(learned: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """One row per (profile, algorithm, controller): risk and productivity over scenarios, plus diagnostics."""
    keys = ["profile", "training_algorithm", "controller"]
    c = F.col
    side = learned.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_set("scenario")), ",").alias("scenarios"),
        F.count_distinct("scenario").alias("scenario_count"),
        F.avg("mean_risk_mean").alias("mean_risk_avg"),
        F.max("mean_risk_mean").alias("mean_risk_worst"),
        mean_where(c("scenario") == "unstable", c("mean_risk_mean")).alias("unstable_risk"),
        mean_where(c("scenario") == "near_boundary", c("mean_risk_mean")).alias("near_boundary_risk"),
        F.avg("relative_mrr_proxy_mean").alias("relative_mrr_avg"),
        F.min("relative_mrr_proxy_mean").alias("relative_mrr_min"),
        mean_where(c("scenario") == "unstable", c("relative_mrr_proxy_mean")).alias("unstable_relative_mrr"),
        F.avg("mean_total_reward_mean").alias("mean_reward_avg"),
        F.sum("shield_rejections_sum").alias("shield_rejections_sum"),
    )
    means = (
        "mean_raw_feed_override", "mean_shield_feed_override", "mean_raw_spindle_override", "mean_shield_spindle_override",
    )
    extra = diagnostics.groupBy(*keys).agg(
        F.sum("guard_fallbacks").alias("guard_fallbacks_sum"), *[F.avg(m).alias(m) for m in means]
    )
    return side.join(extra, keys, "left").na.fill(0, ["guard_fallbacks_sum", *means])


POLICY_WEIGHTS = {
    # Default selection weights and the productivity floor.
    "risk": 1.0, "worst": 0.5, "unstable": 0.5, "shortfall": 3.0, "fallback": 0.15, "rejection": 10.0, "mrr": 0.05,
    "min_relative_mrr": 1.0,
}


def policy_score(
    summaries: DataFrame, diagnostics: DataFrame, keys: tuple[str, ...], weights: dict[str, float] | None = None
) -> DataFrame:
    """Weighted selection score of each policy run; lower is better.  Runs without a summary do not appear."""
    w = {**POLICY_WEIGHTS, **(weights or {})}
    c = F.col
    side = summaries.groupBy(*keys).agg(
        F.avg("mean_risk").alias("mean_risk_avg"),
        F.max("mean_risk").alias("worst_scenario_risk"),
        F.max("max_risk").alias("max_window_risk"),
        mean_where(c("scenario") == "unstable", c("mean_risk")).alias("unstable_risk"),
        mean_where(c("scenario") == "near_boundary", c("mean_risk")).alias("near_boundary_risk"),
        F.avg("relative_mrr_proxy").alias("relative_mrr_avg"),
        F.min("relative_mrr_proxy").alias("relative_mrr_min"),
        mean_where(c("scenario") == "unstable", c("relative_mrr_proxy")).alias("unstable_relative_mrr"),
        F.sum("shield_rejections").alias("shield_rejections"),
    )
    extra = diagnostics.groupBy(*keys).agg(
        F.sum("guard_fallbacks").alias("guard_fallbacks"), F.sum("steps").alias("guard_steps")
    )
    out = side.join(extra, list(keys), "left").na.fill(0, ["guard_fallbacks", "guard_steps"])
    out = out.withColumns(
        {
            "guard_fallback_fraction": ratio(c("guard_fallbacks"), c("guard_steps")),
            "mrr_shortfall": F.greatest(F.lit(0.0), w["min_relative_mrr"] - c("relative_mrr_min")),
        }
    )
    return out.withColumn(
        "selection_score",
        w["risk"] * c("mean_risk_avg")
        + w["worst"] * c("worst_scenario_risk")
        + w["unstable"] * c("unstable_risk")
        + w["shortfall"] * c("mrr_shortfall")
        + w["fallback"] * c("guard_fallback_fraction")
        + w["rejection"] * c("shield_rejections")
        - w["mrr"] * c("relative_mrr_avg"),
    ).drop("guard_steps")


def rank_policies(scored: DataFrame) -> DataFrame:
    """``selected`` marks every run that shares the winner's seed (lowest score, then lowest seed)."""
    winner = scored.agg(F.min_by("seed", F.struct("selection_score", "seed")).alias("seed"))
    return scored.withColumn("selected", F.col("seed") == winner.scalar())


def controller_rollup(summary: DataFrame) -> DataFrame:
    """Per controller over scenarios, with the lowest-risk controller marked."""
    rolled = summary.groupBy("controller").agg(
        F.count(F.lit(1)).alias("scenario_count"),
        F.avg("mean_risk").alias("mean_risk_avg"),
        F.max("mean_risk").alias("mean_risk_worst"),
        F.avg("relative_mrr_proxy").alias("relative_mrr_avg"),
        F.sum("shield_rejections").alias("shield_rejections_sum"),
    )
    best = rolled.agg(F.min_by("controller", F.struct("mean_risk_avg", "controller")).alias("b"))
    return rolled.withColumn("best_by_risk", F.col("controller") == best.scalar())


def profile_rows(runs: DataFrame, aggregate: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Per profile: algorithms seen, run configuration, row counts (``runs`` holds profile and config columns)."""
    learned = F.col("controller") == F.col("training_algorithm")
    side = aggregate.groupBy("profile").agg(
        F.array_join(F.array_sort(F.collect_set("training_algorithm")), ",").alias("algorithms"),
        F.count(F.lit(1)).alias("summary_rows"),
        count_if(learned).alias("learned_rows"),
    )
    extra = diagnostics.groupBy("profile").agg(F.count(F.lit(1)).alias("action_diagnostic_rows"))
    out = runs.join(side, "profile", "left").join(extra, "profile", "left")
    return out.na.fill(0, ["summary_rows", "learned_rows", "action_diagnostic_rows"]).na.fill("", ["algorithms"])


def benchmark_row(runs: DataFrame) -> DataFrame:
    """Nested run metrics to flat columns, six digits, NULL where a run lacks the metric.

    Expects the structs ``split``, ``target``, ``test``, ``lead_time`` and ``event_warning`` as read from run files.
    """
    six = {
        "test_accuracy": "test.accuracy",
        "chatter_f1": "test.binary_chatter_f1",
        "intervention_f1": "test.intervention_f1",
        "lead_time_f1": "lead_time.test.f1",
        "selected_lead_time_f1": "lead_time.threshold_selection.test_at_selected_threshold.f1",
        "event_warning_f1": "event_warning.test.f1",
    }
    tags = [c for c in ("run", "dataset", "sensor_modality", "result_dir", "claim_allowed", "note") if c in runs.columns]
    return runs.select(
        *tags,
        F.col("split.mode").alias("split_type"),
        F.col("target.mode").alias("target"),
        *[F.round(F.col(path).cast("double"), 6).alias(name) for name, path in six.items()],
    )

