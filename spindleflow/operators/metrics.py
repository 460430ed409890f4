"""Evaluation metrics over prediction tables: window level, lead time, episode events, thresholds, calibration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindleflow.functions.labels import id_of_label
from spindleflow.operators.scan import Running, scan
from spindleflow.schema import CHATTER_ID, LABEL_ID, LABELS, POSITIVE_LABELS

# Warning thresholds 0.05 .. 0.95.
THRESHOLDS = tuple(round(0.05 * i, 2) for i in range(1, 20))


def count_if(condition: Column) -> Column:
    """How many rows satisfy a condition; NULL counts as no."""
    return F.count(F.when(condition, F.lit(1)))


def ratio(part: Column, whole: Column) -> Column:
    """``part / max(whole, 1)`` for counts."""
    return part / F.greatest(whole, F.lit(1))


def f1_of(precision: Column, recall: Column) -> Column:
    return 2.0 * precision * recall / F.greatest(precision + recall, F.lit(1e-12))


def add_scores(df: DataFrame, tp: str, fp: str, fn: str, prefix: str = "") -> DataFrame:
    df = df.withColumn(f"{prefix}precision", ratio(F.col(tp), F.col(tp) + F.col(fp)))
    df = df.withColumn(f"{prefix}recall", ratio(F.col(tp), F.col(tp) + F.col(fn)))
    return df.withColumn(f"{prefix}f1", f1_of(F.col(f"{prefix}precision"), F.col(f"{prefix}recall")))


def chatter_score(probability: str = "probability") -> Column:
    return F.col(probability)[LABEL_ID["slight"]] + F.col(probability)[LABEL_ID["severe"]]


def intervention_score(probability: str = "probability") -> Column:
    return F.col(probability)[LABEL_ID["transition"]] + chatter_score(probability)


def label_counts(df: DataFrame, by: tuple[str, ...] = ("label",)) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("windows"))


def confusion_matrix(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Five rows by five columns, zeros included; row = truth."""
    counts = df.groupBy(F.col(truth).alias("truth")).pivot(predicted, list(LABELS)).agg(F.count(F.lit(1)))
    spine = df.sparkSession.createDataFrame([(label,) for label in LABELS], "truth string")
    return spine.join(counts, "truth", "left").na.fill(0, list(LABELS))


def confusion_seen(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Long form (truth, predicted, windows) of the matrix over labels seen on either side."""
    pairs = df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("windows")
    )
    seen = pairs.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array("truth", "predicted"))))).alias("l"))
    grid = seen.select(F.explode("l").alias("truth"), "l").select("truth", F.explode("l").alias("predicted"))
    return grid.join(pairs, ["truth", "predicted"], "left").na.fill(0, ["windows"])


def confusion_pairs(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Off-diagonal pairs, most frequent first."""
    return (
        df.where(F.col(truth) != F.col(predicted))
        .groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted"))
        .agg(F.count(F.lit(1)).alias("windows"))
        .orderBy(F.col("windows").desc(), "truth", "predicted")
    )


def label_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Support, precision, recall, F1 per label seen, plus the pooled ``chatter_binary`` row; one pass."""
    t, p = F.col(truth), F.col(predicted)
    tests = {label: (t == label, p == label) for label in LABELS}
    tests["chatter_binary"] = (t.isin(*POSITIVE_LABELS), p.isin(*POSITIVE_LABELS))
    aggs = []
    for name, (is_t, is_p) in tests.items():
        aggs += [
            count_if(is_t & is_p).alias(f"{name}_tp"),
            count_if(~is_t & is_p).alias(f"{name}_fp"),
            count_if(is_t & ~is_p).alias(f"{name}_fn"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("label"),
                F.col(f"{name}_tp").alias("tp"),
                F.col(f"{name}_fp").alias("fp"),
                F.col(f"{name}_fn").alias("fn"),
            )
            for name in tests
        ]
    )
    long = df.agg(*aggs).select(F.inline(rows))
    long = long.where((F.col("label") == "chatter_binary") | (F.col("tp") + F.col("fp") + F.col("fn") > 0))
    return add_scores(long, "tp", "fp", "fn").select(
        "label", (F.col("tp") + F.col("fn")).alias("support"), "precision", "recall", "f1"
    )


def group_metrics(df: DataFrame, group: str, truth: str, predicted: str) -> DataFrame:
    """Accuracy, chatter scores and label counts per value of any column."""
    t, p = F.col(truth), F.col(predicted)
    hot_t, hot_p = t.isin(*POSITIVE_LABELS), p.isin(*POSITIVE_LABELS)
    out = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("windows"),
        F.avg((t == p).cast("double")).alias("accuracy"),
        count_if(hot_t).alias("chatter_support"),
        count_if(hot_t & hot_p).alias("_tp"),
        count_if(~hot_t & hot_p).alias("false_positive_windows"),
        count_if(hot_t & ~hot_p).alias("false_negative_windows"),
        *[count_if(t == label).alias(f"{label}_support") for label in ("stable", "slight", "severe")],
        *[count_if(p == label).alias(f"predicted_{label}") for label in ("stable", "slight", "severe")],
    )
    return add_scores(out, "_tp", "false_positive_windows", "false_negative_windows", "chatter_").drop("_tp")


def worst_groups(groups: DataFrame, group: str, k: int = 10) -> DataFrame:
    """The k groups with chatter that score lowest: F1 ascending, then support descending."""
    return (
        groups.where(F.col("chatter_support") > 0)
        .orderBy("chatter_f1", F.col("chatter_support").desc(), group)
        .limit(k)
    )


def classification_metrics(df: DataFrame, truth_id: str, predicted_id: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy, macro F1, and binary scores with Brier for chatter and for intervention, per ``by`` group.

    Chatter truth is ``id >= 2`` and so counts ``unknown``; intervention truth is ids 1 to 3.
    """
    t, p = F.col(truth_id), F.col(predicted_id)
    sides = {
        "binary_chatter": (t >= CHATTER_ID, chatter_score()),
        "intervention": ((t >= 1) & (t <= 3), intervention_score()),
    }
    aggs = [F.count(F.lit(1)).alias("windows"), F.avg((t == p).cast("double")).alias("accuracy")]
    for i in range(len(LABELS)):
        aggs += [
            count_if((t == i) & (p == i)).alias(f"_tp{i}"),
            count_if(t == i).alias(f"_t{i}"),
            count_if(p == i).alias(f"_p{i}"),
        ]
    for name, (truth, score) in sides.items():
        hot = score >= 0.5
        aggs += [
            count_if(truth & hot).alias(f"_{name}_tp"),
            count_if(~truth & hot).alias(f"_{name}_fp"),
            count_if(truth & ~hot).alias(f"_{name}_fn"),
            F.avg(F.pow(score - truth.cast("double"), 2)).alias(f"{name}_brier"),
        ]
    out = df.groupBy(*by).agg(*aggs)

    def label_f1(i: int) -> Column:
        tp = F.col(f"_tp{i}")
        return F.when(F.col(f"_t{i}") > 0, f1_of(ratio(tp, F.col(f"_p{i}")), ratio(tp, F.col(f"_t{i}"))))

    scores = F.array_compact(F.array(*[label_f1(i) for i in range(len(LABELS))]))
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(scores), F.lit(1))
    out = out.withColumn("macro_f1", mean)
    for name in sides:
        out = add_scores(out, f"_{name}_tp", f"_{name}_fp", f"_{name}_fn", f"{name}_")
    return out.select(
        *by,
        "windows",
        "accuracy",
        "macro_f1",
        *[f"{name}_{m}" for name in sides for m in ("precision", "recall", "f1", "brier")],
    )


def lead_time_metrics(df: DataFrame, score: Column, threshold: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """Look-ahead detection on windows that are not yet chatter."""
    quiet = df.where(F.col("label_id") < CHATTER_ID)
    truth = F.coalesce(F.col("future_chatter_within_horizon"), F.lit(False))
    hot = score >= F.lit(threshold)
    lead = F.when(F.col("time_to_chatter_s") >= 0, F.col("time_to_chatter_s"))
    out = quiet.groupBy(*by).agg(
        F.count(F.lit(1)).alias("candidate_windows"),
        count_if(truth).alias("positive_windows"),
        count_if(hot).alias("warning_windows"),
        count_if(truth & hot).alias("true_positive_windows"),
        count_if(~truth & hot).alias("false_positive_windows"),
        count_if(truth & ~hot).alias("false_negative_windows"),
        F.coalesce(F.avg(F.pow(score - truth.cast("double"), 2)), F.lit(0.0)).alias("brier"),
        F.avg(F.when(truth, lead)).alias("mean_time_to_chatter_s"),
        F.avg(F.when(truth & hot, lead)).alias("mean_detected_time_to_chatter_s"),
    )
    return add_scores(out, "true_positive_windows", "false_positive_windows", "false_negative_windows")


def event_warning_metrics(
    df: DataFrame,
    warned: Column,
    keys: tuple[str, ...],
    time: str = "start_time_s",
    any_quiet_warning: bool = False,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Episode-level outcome: was the first chatter preceded by a warning on a non-chatter window?

    ``any_quiet_warning`` counts every warning of a quiet episode as false, also on rows labelled chatter-like.
    Minima per episode are partially aggregated before the exchange, so a long episode costs one row per task.
    """
    calm = F.col("label_id") < CHATTER_ID
    per_episode = df.groupBy(*dict.fromkeys((*by, *keys))).agg(
        F.min(F.when(~calm, F.col(time))).alias("first"),
        F.min(F.when(calm & warned, F.col(time))).alias("warn"),
        F.max(warned.cast("int")).alias("any_warn"),
    )
    event = F.col("first").isNotNull()
    early = event & (F.col("warn") < F.col("first"))
    false_alarm = ~event & ((F.col("any_warn") == 1) if any_quiet_warning else F.col("warn").isNotNull())
    return summarise_events(per_episode, event, early, false_alarm, F.col("first") - F.col("warn"), by)


def summarise_events(
    episodes: DataFrame, event: Column, early: Column, false_alarm: Column, lead: Column, by: tuple[str, ...]
) -> DataFrame:
    out = episodes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("episode_count"),
        count_if(event).alias("event_episodes"),
        count_if(~event).alias("quiet_episodes"),
        count_if(early | false_alarm).alias("warning_episodes"),
        count_if(early).alias("detected_event_episodes"),
        count_if(false_alarm).alias("false_warning_episodes"),
        F.avg(F.when(early, F.greatest(lead, F.lit(0.0)))).alias("mean_detected_lead_time_s"),
    )
    found, false = F.col("detected_event_episodes"), F.col("false_warning_episodes")
    out = out.withColumns(
        {
            "missed_event_episodes": F.col("event_episodes") - found,
            "true_quiet_episodes": F.col("quiet_episodes") - false,
            "precision": ratio(found, found + false),
            "recall": ratio(found, F.col("event_episodes")),
        }
    )
    return out.withColumn("f1", f1_of(F.col("precision"), F.col("recall")))


def threshold_step(score: Column, thresholds: tuple[float, ...]) -> Column:
    """How many thresholds a score reaches; the row warns at threshold i exactly when ``step > i``."""
    reached = [F.when(score >= F.lit(t), 1).otherwise(0) for t in thresholds]
    return reduce(lambda a, b: a + b, reached)


def _thresholds(thresholds: tuple[float, ...]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(thresholds)])


def lead_time_sweep(
    df: DataFrame, score: Column, by: tuple[str, ...] = (), thresholds: tuple[float, ...] = THRESHOLDS
) -> DataFrame:
    """Lead-time scores at every threshold from one pass: rows are counted per step, then summed from above."""
    truth = F.coalesce(F.col("future_chatter_within_horizon"), F.lit(False))
    lead = F.when(F.col("time_to_chatter_s") >= 0, F.col("time_to_chatter_s"))
    steps = (
        df.where(F.col("label_id") < CHATTER_ID)
        .groupBy(*by, threshold_step(score, thresholds).alias("step"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            count_if(truth).alias("pos"),
            F.sum(F.when(truth, lead)).alias("lead"),
            F.count(F.when(truth, lead)).alias("leads"),
        )
    )
    above = F.col("step") > F.col("i")
    grid = steps.select("*", F.inline(_thresholds(thresholds)))
    out = grid.groupBy(*by, "threshold").agg(
        F.sum("n").alias("candidate_windows"),
        F.sum("pos").alias("positive_windows"),
        F.coalesce(F.sum(F.when(above, F.col("n"))), F.lit(0)).alias("warning_windows"),
        F.coalesce(F.sum(F.when(above, F.col("pos"))), F.lit(0)).alias("tp"),
        F.sum(F.when(above, F.col("lead"))).alias("lead"),
        F.sum(F.when(above, F.col("leads"))).alias("leads"),
    )
    out = out.withColumns(
        {"fp": F.col("warning_windows") - F.col("tp"), "fn": F.col("positive_windows") - F.col("tp")}
    )
    return add_scores(out, "tp", "fp", "fn").select(
        *by,
        "threshold",
        "candidate_windows",
        "positive_windows",
        "warning_windows",
        "precision",
        "recall",
        "f1",
        F.try_divide("lead", "leads").alias("mean_detected_time_to_chatter_s"),
    )


def event_sweep(
    df: DataFrame,
    score: Column,
    keys: tuple[str, ...],
    by: tuple[str, ...] = (),
    thresholds: tuple[float, ...] = THRESHOLDS,
    time: str = "start_time_s",
) -> DataFrame:
    """Episode outcome at every threshold: at most twenty rows per episode leave the first aggregation."""
    calm = F.col("label_id") < CHATTER_ID
    steps = df.groupBy(*by, *keys, threshold_step(score, thresholds).alias("step")).agg(
        F.min(F.when(~calm, F.col(time))).alias("first"), F.min(F.when(calm, F.col(time))).alias("calm")
    )
    grid = steps.select("*", F.inline(_thresholds(thresholds)))
    episodes = grid.groupBy(*by, *keys, "threshold").agg(
        F.min("first").alias("first"), F.min(F.when(F.col("step") > F.col("i"), F.col("calm"))).alias("warn")
    )
    event = F.col("first").isNotNull()
    early = event & (F.col("warn") < F.col("first"))
    out = summarise_events(
        episodes, event, early, ~event & F.col("warn").isNotNull(), F.col("first") - F.col("warn"), (*by, "threshold")
    )
    return out.select(
        *by,
        "threshold",
        "episode_count",
        "event_episodes",
        "warning_episodes",
        "precision",
        "recall",
        "f1",
        "mean_detected_lead_time_s",
    )


def best_threshold(sweep: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Best row by F1, then recall, then precision, then the lower threshold."""
    # Scores are compared at 12 digits so that one rate computed along two paths still ties.
    order = F.struct(*[F.round(c, 12) for c in ("f1", "recall", "precision")], -F.col("threshold"))
    row = F.struct(*[c for c in sweep.columns if c not in by])
    return sweep.groupBy(*by).agg(F.max_by(row, order).alias("best")).select(*by, "best.*")


def select_threshold(best: DataFrame, positives: str, split: str = "split") -> DataFrame:
    """Threshold from validation when it has positives, else from training; one row (source, threshold)."""
    usable = (F.col(split) == "validation") & (F.col(positives) > 0)
    rank = F.when(usable, 0).when(F.col(split).isin("fit", "train"), 1).otherwise(2)
    return best.where(usable | F.col(split).isin("fit", "train")).agg(
        F.min_by(F.when(usable, F.lit("validation")).otherwise(F.lit("train")), rank).alias("source"),
        F.min_by("threshold", rank).alias("threshold"),
    )


def roc_auc(df: DataFrame, score: str, positive: Column, by: tuple[str, ...] = (), parts: int = 65_536) -> DataFrame:
    """Area under the ROC curve by mid-ranks; equal scores are counted first, NULL when one class is missing."""
    keys = list(by)
    per_score = df.groupBy(*keys, score).agg(
        count_if(positive).alias("pos"), F.count(F.lit(1)).alias("n")
    )
    ranked = scan(
        per_score,
        keys,
        F.floor(F.col(score) * parts).cast("long"),
        [score],
        {"below": Running("sum", F.col("n"), inclusive=False)},
    )
    mid = F.coalesce("below", F.lit(0)) + (F.col("n") + 1) / 2.0
    return (
        ranked.groupBy(*keys)
        .agg(F.sum(mid * F.col("pos")).alias("ranks"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
        .withColumn("q", F.col("n") - F.col("p"))
        .select(
            *keys,
            F.try_divide(
                F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2.0, (F.col("p") * F.col("q")).cast("double")
            ).alias("roc_auc"),
        )
    )


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson r, 0 when either side is constant."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx > 1e-12) & (sy > 1e-12), F.covar_pop(x, y) / F.nullif(sx * sy, F.lit(0.0))).otherwise(0.0)


def calibration_quality(df: DataFrame, probability: str, positive: str, margin: str, target: str) -> DataFrame:
    """Calibration scores for all rows and per split."""
    p, y = F.col(probability), F.col(positive)
    tagged = df.select("*", F.explode(F.array(F.lit("all"), F.col("split"))).alias("part"))
    scores = tagged.groupBy("part").agg(
        F.count(F.lit(1)).alias("sample_count"),
        count_if(y).alias("positive_count"),
        count_if(~y).alias("negative_count"),
        F.avg(y.cast("double")).alias("positive_fraction"),
        F.avg(((p >= 0.5) == y).cast("double")).alias("accuracy_at_0_5"),
        F.avg(F.pow(p - y.cast("double"), 2)).alias("brier_score"),
        F.avg(F.abs(p - F.col(target))).alias("mean_absolute_error"),
        guarded_corr(F.col(margin), F.col(target)).alias("margin_correlation"),
    )
    return scores.join(roc_auc(tagged, probability, y, ("part",)), "part", "left")


def standard_scaler(df: DataFrame, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Mean and population standard deviation per column; a deviation of at most 1e-12 becomes 1."""
    stats = df.groupBy(*by).agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    )
    rows = F.array(
        *[F.struct(F.lit(c).alias("name"), F.col(f"m_{c}").alias("mean"), F.col(f"s_{c}").alias("scale")) for c in columns]
    )
    return stats.select(*by, F.inline(rows)).withColumn(
        "scale", F.when(F.col("scale") <= 1e-12, 1.0).otherwise(F.col("scale"))
    )


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k n_c); the window runs over one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("windows"))
    every = Window.partitionBy()
    return counts.withColumn(
        "weight", F.sum("windows").over(every) / (F.count(F.lit(1)).over(every) * F.col("windows"))
    )


def predicted_id(column: str) -> Column:
    return id_of_label(F.col(column))
