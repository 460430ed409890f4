"""Metric queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindleflow.functions.labels import id_of_label
from spindleflow.functions.risk import sigmoid
from spindleflow.operators import metrics as m
from spindleflow.operators import sequence as seq
from spindleflow.plans.catalog import pick, query
from spindleflow.plans.inputs import HORIZON_S, HZ_SQL, ID_CASE, LAYOUT, PRED_SQL, WIN_SQL, windows, with_probabilities
from spindleflow.plans.sequence_queries import HYST_SQL
from spindleflow.schema import EPISODE, LABELS

EVENT_COUNTS = (
    "episode_count event_episodes quiet_episodes warning_episodes detected_event_episodes missed_event_episodes"
    " false_warning_episodes true_quiet_episodes"
)


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Windows with look-ahead labels, class probabilities and a predicted label."""
    return with_probabilities(seq.horizon_labels(windows(spark, folder), LAYOUT, HORIZON_S))


def flat_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """The same without look-ahead labels, for metrics that do not read them."""
    return with_probabilities(windows(spark, folder))


PLAIN = f"WITH {WIN_SQL}, {PRED_SQL.replace('FROM hz', 'FROM win')}"
FULL = f"WITH {WIN_SQL}, {HZ_SQL}, {PRED_SQL}"


@query("a8_label_counts", f"{PLAIN} SELECT label, count(*) AS windows FROM win GROUP BY label")
def a8(spark: SparkSession, folder: str) -> DataFrame:
    return m.label_counts(windows(spark, folder))


_PIVOT = ", ".join(f"count(*) FILTER (predicted_label = '{x}') AS {x}" for x in LABELS)


@query(
    "a9_confusion_matrix",
    f"{PLAIN} SELECT s.truth, {', '.join(f'coalesce({x}, 0) AS {x}' for x in LABELS)}"
    f" FROM (VALUES {', '.join(f'({chr(39)}{x}{chr(39)})' for x in LABELS)}) s(truth)"
    f" LEFT JOIN (SELECT label AS truth, {_PIVOT} FROM pred GROUP BY label) c USING (truth)",
)
def a9(spark: SparkSession, folder: str) -> DataFrame:
    return m.confusion_matrix(flat_predictions(spark, folder), "label", "predicted_label")


@query(
    "a9_confusion_seen",
    f"""{PLAIN}, l AS (SELECT label AS x FROM pred UNION SELECT predicted_label FROM pred)
    SELECT a.x AS truth, b.x AS predicted, count(p.label) AS windows
    FROM l a CROSS JOIN l b LEFT JOIN pred p ON p.label = a.x AND p.predicted_label = b.x GROUP BY a.x, b.x""",
)
def a9_seen(spark: SparkSession, folder: str) -> DataFrame:
    return m.confusion_seen(flat_predictions(spark, folder), "label", "predicted_label")


@query(
    "t2_confusion_pairs",
    f"{PLAIN} SELECT label AS truth, predicted_label AS predicted, count(*) AS windows FROM pred"
    " WHERE label <> predicted_label GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2",
)
def t2(spark: SparkSession, folder: str) -> DataFrame:
    return m.confusion_pairs(flat_predictions(spark, folder), "label", "predicted_label")


def _prf(tp: str, fp: str, fn: str, prefix: str = "") -> str:
    p = f"({tp}) / greatest({tp} + {fp}, 1)::DOUBLE"
    r = f"({tp}) / greatest({tp} + {fn}, 1)::DOUBLE"
    return f"{p} AS {prefix}precision, {r} AS {prefix}recall, 2e0 * ({p}) * ({r}) / greatest(({p}) + ({r}), 1e-12) AS {prefix}f1"


_HOT_T, _HOT_P = "label IN ('slight', 'severe')", "predicted_label IN ('slight', 'severe')"
_ONE = " UNION ALL ".join(
    [
        f"SELECT '{x}' AS label, count(*) FILTER (label = '{x}' AND predicted_label = '{x}') AS tp,"
        f" count(*) FILTER (label <> '{x}' AND predicted_label = '{x}') AS fp,"
        f" count(*) FILTER (label = '{x}' AND predicted_label <> '{x}') AS fn FROM pred"
        for x in LABELS
    ]
    + [
        f"SELECT 'chatter_binary', count(*) FILTER ({_HOT_T} AND {_HOT_P}),"
        f" count(*) FILTER (NOT {_HOT_T} AND {_HOT_P}), count(*) FILTER ({_HOT_T} AND NOT {_HOT_P}) FROM pred"
    ]
)


@query(
    "a10_label_metrics",
    f"{PLAIN}, c AS ({_ONE}), s AS (SELECT label, tp + fn AS support, {_prf('tp', 'fp', 'fn')} FROM c"
    " WHERE label = 'chatter_binary' OR tp + fp + fn > 0)"
    f" SELECT {pick('label', 'precision recall f1', 'support')} FROM s",
)
def a10(spark: SparkSession, folder: str) -> DataFrame:
    return m.label_metrics(flat_predictions(spark, folder), "label", "predicted_label")


_PID = ID_CASE.format("predicted_label")


def _side(name: str, truth: str, score: str) -> str:
    return (
        f"count(*) FILTER ({truth} AND {score} >= 0.5e0) AS {name}_tp,"
        f" count(*) FILTER (NOT ({truth}) AND {score} >= 0.5e0) AS {name}_fp,"
        f" count(*) FILTER (({truth}) AND {score} < 0.5e0) AS {name}_fn,"
        f" avg(power({score} - CASE WHEN {truth} THEN 1e0 ELSE 0e0 END, 2)) AS {name}_brier"
    )


_CHAT = "(score * 0.6e0 + score * 0.4e0)"
_INT = f"(p_mid + {_CHAT})"
_CLASS_SQL = f"""{PLAIN},
q AS (SELECT *, {_PID} AS pid FROM pred),
g AS (SELECT scenario, count(*) AS windows, avg(CASE WHEN label_id = pid THEN 1e0 ELSE 0e0 END) AS accuracy,
        {_side('c', 'label_id >= 2', _CHAT)}, {_side('v', 'label_id BETWEEN 1 AND 3', _INT)} FROM q GROUP BY scenario),
lf AS (SELECT scenario, l.i, count(*) FILTER (label_id = l.i AND pid = l.i) AS tp,
         count(*) FILTER (label_id <> l.i AND pid = l.i) AS fp, count(*) FILTER (label_id = l.i AND pid <> l.i) AS fn
       FROM q CROSS JOIN (VALUES (0), (1), (2), (3), (4)) l(i) GROUP BY scenario, l.i),
mf AS (SELECT scenario, avg(f1) AS macro_f1
       FROM (SELECT scenario, {_prf('tp', 'fp', 'fn')} FROM lf WHERE tp + fn > 0) GROUP BY scenario),
o AS (SELECT scenario, windows, accuracy, macro_f1, {_prf('c_tp', 'c_fp', 'c_fn', 'binary_chatter_')},
        c_brier AS binary_chatter_brier, {_prf('v_tp', 'v_fp', 'v_fn', 'intervention_')}, v_brier AS intervention_brier
      FROM g JOIN mf USING (scenario))
SELECT {pick('scenario', 'accuracy macro_f1 ' + ' '.join(f'{n}_{x}' for n in ('binary_chatter', 'intervention') for x in ('precision', 'recall', 'f1', 'brier')), 'windows')} FROM o"""


@query("a11_classification", _CLASS_SQL)
def a11(spark: SparkSession, folder: str) -> DataFrame:
    rows = flat_predictions(spark, folder).withColumn("predicted_id", id_of_label(F.col("predicted_label")))
    return m.classification_metrics(rows, "label_id", "predicted_id", ("scenario",))


_GROUP_COUNTS = " , ".join(
    [f"count(*) FILTER (label = '{x}') AS {x}_support" for x in ("stable", "slight", "severe")]
    + [f"count(*) FILTER (predicted_label = '{x}') AS predicted_{x}" for x in ("stable", "slight", "severe")]
)


def _group_sql(group: str) -> str:
    return f"""g AS (SELECT {group}, count(*) AS windows, avg(CASE WHEN label = predicted_label THEN 1e0 ELSE 0e0 END) AS accuracy,
      count(*) FILTER ({_HOT_T}) AS chatter_support, count(*) FILTER ({_HOT_T} AND {_HOT_P}) AS tp,
      count(*) FILTER (NOT {_HOT_T} AND {_HOT_P}) AS false_positive_windows,
      count(*) FILTER ({_HOT_T} AND NOT {_HOT_P}) AS false_negative_windows, {_GROUP_COUNTS} FROM pred GROUP BY {group}),
    gm AS (SELECT *, {_prf('tp', 'false_positive_windows', 'false_negative_windows', 'chatter_')} FROM g)"""


_GROUP_PICK = pick(
    "",
    "accuracy chatter_precision chatter_recall chatter_f1",
    "windows chatter_support false_positive_windows false_negative_windows stable_support slight_support"
    " severe_support predicted_stable predicted_slight predicted_severe",
)


@query("a12_group_metrics", f"{PLAIN}, {_group_sql('scenario')} SELECT scenario, {_GROUP_PICK} FROM gm")
def a12(spark: SparkSession, folder: str) -> DataFrame:
    return m.group_metrics(flat_predictions(spark, folder), "scenario", "label", "predicted_label")


@query(
    "t1_worst_groups",
    f"{PLAIN}, {_group_sql('episode')} SELECT episode, {_GROUP_PICK} FROM gm WHERE chatter_support > 0"
    " ORDER BY gm.chatter_f1, gm.chatter_support DESC, episode LIMIT 10",
)
def t1(spark: SparkSession, folder: str) -> DataFrame:
    groups = m.group_metrics(flat_predictions(spark, folder), "episode", "label", "predicted_label")
    return m.worst_groups(groups, "episode")


_LEAD_AGG = """count(*) AS candidate_windows, count(*) FILTER (truth) AS positive_windows,
  count(*) FILTER (hot) AS warning_windows, count(*) FILTER (truth AND hot) AS true_positive_windows,
  count(*) FILTER (NOT truth AND hot) AS false_positive_windows,
  count(*) FILTER (truth AND NOT hot) AS false_negative_windows,
  coalesce(avg(power(sc - CASE WHEN truth THEN 1e0 ELSE 0e0 END, 2)), 0e0) AS brier,
  avg(CASE WHEN truth AND time_to_chatter_s >= 0 THEN time_to_chatter_s END) AS mean_time_to_chatter_s,
  avg(CASE WHEN truth AND hot AND time_to_chatter_s >= 0 THEN time_to_chatter_s END) AS mean_detected_time_to_chatter_s"""


@query(
    "a13_lead_time",
    f"""{FULL}, q AS (SELECT *, {_CHAT} AS sc, {_CHAT} >= 0.5e0 AS hot, future_chatter_within_horizon AS truth
      FROM pred WHERE label_id < 2),
    l AS (SELECT scenario, {_LEAD_AGG} FROM q GROUP BY scenario),
    o AS (SELECT *, {_prf('true_positive_windows', 'false_positive_windows', 'false_negative_windows')} FROM l)
    SELECT {pick('scenario', 'brier mean_time_to_chatter_s mean_detected_time_to_chatter_s precision recall f1',
                 'candidate_windows positive_windows warning_windows true_positive_windows false_positive_windows'
                 ' false_negative_windows')} FROM o""",
)
def a13(spark: SparkSession, folder: str) -> DataFrame:
    return m.lead_time_metrics(predictions(spark, folder), m.chatter_score(), 0.5, ("scenario",))


def event_sql(warned: str, source: str, any_quiet: bool = False) -> str:
    false = "any_warn" if any_quiet else "warn IS NOT NULL"
    return f"""ep AS (SELECT scenario, episode, min(CASE WHEN label_id >= 2 THEN start_time_s END) AS first,
        min(CASE WHEN label_id < 2 AND {warned} THEN start_time_s END) AS warn, bool_or({warned}) AS any_warn
      FROM {source} GROUP BY scenario, episode),
    ev AS (SELECT count(*) AS episode_count, count(first) AS event_episodes,
        count(*) - count(first) AS quiet_episodes, count(*) FILTER (warn < first) AS detected_event_episodes,
        count(*) FILTER (first IS NULL AND {false}) AS false_warning_episodes,
        avg(CASE WHEN warn < first THEN first - warn END) AS mean_detected_lead_time_s FROM ep),
    ew AS (SELECT *, detected_event_episodes + false_warning_episodes AS warning_episodes,
        event_episodes - detected_event_episodes AS missed_event_episodes,
        quiet_episodes - false_warning_episodes AS true_quiet_episodes,
        {_prf('detected_event_episodes', 'false_warning_episodes', '(event_episodes - detected_event_episodes)')} FROM ev)"""


EVENT_PICK = pick("", "mean_detected_lead_time_s precision recall f1", EVENT_COUNTS)


@query("a14_event_warning", f"{PLAIN}, {event_sql(f'{_CHAT} >= 0.5e0', 'pred')} SELECT {EVENT_PICK} FROM ew")
def a14(spark: SparkSession, folder: str) -> DataFrame:
    return m.event_warning_metrics(flat_predictions(spark, folder), m.chatter_score() >= 0.5, EPISODE)


_TH = "th AS (SELECT range AS i, round((range + 1) * 0.05e0, 2) AS threshold FROM range(19))"
_LEAD_SWEEP = f"""{FULL}, {_TH},
q AS (SELECT scenario, threshold, {_CHAT} AS sc, {_CHAT} >= threshold AS hot, future_chatter_within_horizon AS truth, time_to_chatter_s
      FROM pred CROSS JOIN th WHERE label_id < 2),
l AS (SELECT scenario, threshold, {_LEAD_AGG} FROM q GROUP BY scenario, threshold),
o AS (SELECT *, {_prf('true_positive_windows', 'false_positive_windows', 'false_negative_windows')} FROM l)"""
_SWEEP_PICK = pick(
    "scenario",
    "threshold precision recall f1 mean_detected_time_to_chatter_s",
    "candidate_windows positive_windows warning_windows",
)


@query("j10_threshold_grid", f"{_LEAD_SWEEP} SELECT {_SWEEP_PICK} FROM o")
def j10(spark: SparkSession, folder: str) -> DataFrame:
    return m.lead_time_sweep(predictions(spark, folder), m.chatter_score(), ("scenario",))


_BEST = "row_number() OVER (PARTITION BY {0} ORDER BY round(f1, 12) DESC, round(recall, 12) DESC, round(precision, 12) DESC, threshold) AS best"


@query(
    "a15_best_lead_threshold",
    f"{_LEAD_SWEEP}, b AS (SELECT *, {_BEST.format('scenario')} FROM o) SELECT {_SWEEP_PICK} FROM b WHERE best = 1",
)
def a15_lead(spark: SparkSession, folder: str) -> DataFrame:
    sweep = m.lead_time_sweep(predictions(spark, folder), m.chatter_score(), ("scenario",))
    return m.best_threshold(sweep, ("scenario",))


_EVENT_SWEEP = f"""{PLAIN}, {_TH},
ep AS (SELECT scenario, episode, threshold, min(CASE WHEN label_id >= 2 THEN start_time_s END) AS first,
         min(CASE WHEN label_id < 2 AND {_CHAT} >= threshold THEN start_time_s END) AS warn
       FROM pred CROSS JOIN th GROUP BY scenario, episode, threshold),
ev AS (SELECT scenario, threshold, count(*) AS episode_count, count(first) AS event_episodes,
         count(*) FILTER (warn < first) AS det, count(*) FILTER (first IS NULL AND warn IS NOT NULL) AS fal,
         avg(CASE WHEN warn < first THEN first - warn END) AS mean_detected_lead_time_s FROM ep GROUP BY scenario, threshold),
o AS (SELECT *, det + fal AS warning_episodes, {_prf('det', 'fal', '(event_episodes - det)')} FROM ev)"""
_EVENT_SWEEP_PICK = pick(
    "scenario",
    "threshold precision recall f1 mean_detected_lead_time_s",
    "episode_count event_episodes warning_episodes",
)


@query("a15_event_sweep", f"{_EVENT_SWEEP} SELECT {_EVENT_SWEEP_PICK} FROM o")
def a15_event(spark: SparkSession, folder: str) -> DataFrame:
    return m.event_sweep(flat_predictions(spark, folder), m.chatter_score(), ("episode",), ("scenario",))


@query(
    "a15_best_event_threshold",
    f"{_EVENT_SWEEP}, b AS (SELECT *, {_BEST.format('scenario')} FROM o)"
    f" SELECT {_EVENT_SWEEP_PICK} FROM b WHERE best = 1",
)
def a15_best_event(spark: SparkSession, folder: str) -> DataFrame:
    sweep = m.event_sweep(flat_predictions(spark, folder), m.chatter_score(), ("episode",), ("scenario",))
    return m.best_threshold(sweep, ("scenario",))


_CAL_SQL = f"""WITH {WIN_SQL},
c AS (SELECT margin_physics AS margin, score AS target, label IN ('slight', 'severe') AS y,
        1e0 / (1e0 + exp(0.3e0 + 1.5e0 * margin_physics - score)) AS p,
        CASE WHEN episode % 5 = 0 THEN 'holdout' ELSE 'train' END AS split FROM win),
t AS (SELECT 'all' AS part, * FROM c UNION ALL SELECT split, * FROM c),
k AS (SELECT part, y, rank() OVER (PARTITION BY part ORDER BY p)
        + (count(*) OVER (PARTITION BY part, p) - 1) / 2e0 AS mid FROM t),
a AS (SELECT part, (sum(CASE WHEN y THEN mid END) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2e0)
        / (count(*) FILTER (y) * count(*) FILTER (NOT y)) AS roc_auc FROM k GROUP BY part),
o AS (SELECT part, count(*) AS sample_count, count(*) FILTER (y) AS positive_count,
        count(*) FILTER (NOT y) AS negative_count, avg(CASE WHEN y THEN 1e0 ELSE 0e0 END) AS positive_fraction,
        avg(CASE WHEN (p >= 0.5e0) = y THEN 1e0 ELSE 0e0 END) AS accuracy_at_0_5,
        avg(power(p - CASE WHEN y THEN 1e0 ELSE 0e0 END, 2)) AS brier_score, avg(abs(p - target)) AS mean_absolute_error,
        corr(margin, target) AS margin_correlation FROM t GROUP BY part)
SELECT {pick('part', 'positive_fraction accuracy_at_0_5 brier_score mean_absolute_error margin_correlation roc_auc',
             'sample_count positive_count negative_count')} FROM o JOIN a USING (part)"""


@query("a24_calibration_quality", _CAL_SQL)
def a24(spark: SparkSession, folder: str) -> DataFrame:
    rows = windows(spark, folder).select(
        F.col("margin_physics").alias("margin"),
        F.col("score").alias("target"),
        F.col("label").isin("slight", "severe").alias("y"),
        sigmoid(-(0.3 + 1.5 * F.col("margin_physics") - F.col("score"))).alias("p"),
        F.when(F.col("episode") % 5 == 0, "holdout").otherwise("train").alias("split"),
    )
    return m.calibration_quality(rows, "p", "y", "margin", "target")


_SCALED = ("rms", "margin_physics", "feed_per_tooth_m")
_SCALER = " UNION ALL ".join(
    f"SELECT '{c}' AS name, avg({c}) AS mean, CASE WHEN stddev_pop({c}) <= 1e-12 THEN 1e0 ELSE stddev_pop({c}) END AS scale"
    " FROM win"
    for c in _SCALED
)


@query("a26_scaler", f"WITH {WIN_SQL}, s AS ({_SCALER}) SELECT {pick('name', 'mean scale')} FROM s")
def a26(spark: SparkSession, folder: str) -> DataFrame:
    return m.standard_scaler(windows(spark, folder), list(_SCALED))


@query(
    "a26_class_weights",
    f"WITH {WIN_SQL}, c AS (SELECT label, count(*) AS windows FROM win GROUP BY label)"
    " SELECT label, windows, round((SELECT sum(windows) FROM c) / ((SELECT count(*) FROM c) * windows::DOUBLE), 6) AS weight"
    " FROM c",
)
def a26_weights(spark: SparkSession, folder: str) -> DataFrame:
    return m.class_weights(windows(spark, folder), "label")


_REPORT_SQL = f"""WITH RECURSIVE {WIN_SQL}, {HYST_SQL}, {HZ_SQL},
o AS (SELECT *, row_number() OVER (PARTITION BY scenario, episode ORDER BY start_time_s, window_id) AS rn FROM win),
r AS (SELECT scenario, episode, rn, window_id, rms AS e FROM o WHERE rn = 1
  UNION ALL SELECT o.scenario, o.episode, o.rn, o.window_id, 0.35e0 * o.rms + 0.65e0 * r.e FROM o JOIN r ON o.scenario = r.scenario AND o.episode = r.episode AND o.rn = r.rn + 1),
ep AS (SELECT scenario, episode, min(CASE WHEN label_id >= 2 THEN start_time_s END) AS first, min(CASE WHEN label_id < 2 AND shadow_warning THEN start_time_s END) AS warn
  FROM hy GROUP BY scenario, episode),
ev AS (SELECT scenario, count(*) AS episode_count, count(first) AS event_episodes, count(*) FILTER (warn < first) AS detected_event_episodes,
  count(*) FILTER (first IS NULL AND warn IS NOT NULL) AS false_warning_episodes FROM ep GROUP BY scenario),
wn AS (SELECT hy.scenario, count(*) AS windows, count(*) FILTER (shadow_warning) AS warning_windows, avg(r.e) AS mean_rms_ewma,
  count(*) FILTER (hz.future_chatter_within_horizon AND hz.label_id < 2) AS lead_windows FROM hy JOIN r USING (window_id) JOIN hz USING (window_id) GROUP BY hy.scenario)
SELECT scenario, windows, warning_windows, lead_windows, round(mean_rms_ewma, 6) AS mean_rms_ewma, episode_count, event_episodes, detected_event_episodes, false_warning_episodes
FROM wn JOIN ev USING (scenario)"""


@query("early_warning_report", _REPORT_SQL)
def early_warning_report(spark: SparkSession, folder: str) -> DataFrame:
    """Per scenario: windows, smoothed level, look-ahead positives, warnings, and what the warnings caught."""
    rows = windows(spark, folder).select(*EPISODE, "window_id", "start_time_s", "label", "label_id", "rms", "score")
    # A scan reads its input twice, so the cheap ones come first and the one-pass look-ahead last.
    warned = seq.hysteresis(rows, LAYOUT, "score", 0.6, 0.45)
    smooth = seq.ewma(warned, LAYOUT, ("rms",))
    warned = seq.horizon_labels(smooth, LAYOUT, HORIZON_S)
    calm, on = F.col("label_id") < 2, F.col("shadow_warning")
    episodes = warned.groupBy(*EPISODE).agg(
        F.count(F.lit(1)).alias("windows"),
        m.count_if(on).alias("warning_windows"),
        m.count_if(F.col("future_chatter_within_horizon") & calm).alias("lead_windows"),
        F.sum("rms_ewma").alias("level"),
        F.min(F.when(~calm, F.col("start_time_s"))).alias("first"),
        F.min(F.when(calm & on, F.col("start_time_s"))).alias("warn"),
    )
    event = F.col("first").isNotNull()
    return episodes.groupBy("scenario").agg(
        F.sum("windows").alias("windows"),
        F.sum("warning_windows").alias("warning_windows"),
        F.sum("lead_windows").alias("lead_windows"),
        (F.sum("level") / F.sum("windows")).alias("mean_rms_ewma"),
        F.count(F.lit(1)).alias("episode_count"),
        m.count_if(event).alias("event_episodes"),
        m.count_if(F.col("warn") < F.col("first")).alias("detected_event_episodes"),
        m.count_if(~event & F.col("warn").isNotNull()).alias("false_warning_episodes"),
    )
