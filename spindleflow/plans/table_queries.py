"""Splits, joins, pseudo-labels, slicing, timebase and shadow queries on the window table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindleflow.functions.labels import is_positive
from spindleflow.operators import align, metrics, pseudo, shadow, slicing, splits, timebase
from spindleflow.operators import sequence as seq
from spindleflow.operators.scan import Layout, with_position
from spindleflow.operators.staging import staged
from spindleflow.plans.catalog import pick, query, read
from spindleflow.plans.inputs import HORIZON_S, HORIZON_US, LAYOUT, WIN_SQL, windows
from spindleflow.plans.metric_queries import EVENT_PICK, event_sql
from spindleflow.plans.sequence_queries import HYST_SQL, RATE_SQL
from spindleflow.schema import EPISODE

BASE = f"WITH {WIN_SQL}"

# ---- splits ---------------------------------------------------------------------------------------------------


def _held(n: str, fraction: float) -> str:
    return f"CASE WHEN {n} <= 1 THEN 0 ELSE least(greatest(1, CAST(round_even({n} * {fraction}::DOUBLE, 0) AS BIGINT)), {n} - 1) END"


@query(
    "w8_time_block_split",
    f"""{BASE}, r AS (SELECT window_id, row_number() OVER (PARTITION BY scenario, episode ORDER BY start_time_s, window_id) AS rn,
      count(*) OVER (PARTITION BY scenario, episode) AS n FROM win)
    SELECT window_id, CASE WHEN rn > n - {_held('n', 0.3)} THEN 'test' ELSE 'train' END AS split FROM r""",
)
def w8(spark: SparkSession, folder: str) -> DataFrame:
    return splits.time_block_split(windows(spark, folder), LAYOUT, 0.3).select("window_id", "split")


GROUP_SQL = f"""
gk AS (SELECT DISTINCT scenario, episode FROM win),
gr AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY md5('303|' || scenario || '|' || episode)) AS rn,
    count(*) OVER (PARTITION BY scenario) AS n FROM gk),
gs AS (SELECT win.*, CASE WHEN rn <= {_held('n', 0.3)} THEN 'test' ELSE 'train' END AS split FROM win JOIN gr USING (scenario, episode))"""


@query("w9_grouped_split", f"{BASE}, {GROUP_SQL} SELECT window_id, split FROM gs")
def w9(spark: SparkSession, folder: str) -> DataFrame:
    return splits.grouped_split(windows(spark, folder), 0.3, 303).select("window_id", "split")


@query(
    "w9_row_split",
    f"""{BASE}, r AS (SELECT window_id, row_number() OVER (PARTITION BY label ORDER BY md5('303|' || window_id)) AS rn,
      count(*) OVER (PARTITION BY label) AS n FROM win)
    SELECT window_id, CASE WHEN rn <= {_held('n', 0.3)} THEN 'test' ELSE 'train' END AS split FROM r""",
)
def w9_row(spark: SparkSession, folder: str) -> DataFrame:
    return splits.row_split(windows(spark, folder), "label", "window_id", 0.3, 303).select("window_id", "split")


@query(
    "w9_scenario_split",
    f"""{BASE}, g AS (SELECT DISTINCT scenario FROM win), r AS (SELECT scenario, row_number() OVER (ORDER BY md5('303|' || scenario)) AS rn,
      count(*) OVER () AS n FROM g)
    SELECT window_id, CASE WHEN rn <= {_held('n', 0.3)} THEN 'test' ELSE 'train' END AS split FROM win JOIN r USING (scenario)""",
)
def w9_scenario(spark: SparkSession, folder: str) -> DataFrame:
    return splits.scenario_split(windows(spark, folder), 0.3, 303).select("window_id", "split")


FAMILY_SQL = """
fg AS (SELECT scenario, episode, round(avg(axial_depth_scale), 12) AS m, count(*) AS size FROM win GROUP BY scenario, episode),
fo AS (SELECT *, coalesce(sum(size) OVER (ORDER BY m DESC, scenario || '::episode=' || episode ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    row_number() OVER (ORDER BY m DESC, scenario || '::episode=' || episode) AS place, count(*) OVER () AS groups, sum(size) OVER () AS total FROM fg),
fs AS (SELECT win.*, CASE WHEN before < greatest(1, CAST(round_even(total * 0.3::DOUBLE, 0) AS BIGINT)) AND place < groups THEN 'test' ELSE 'train' END AS split
  FROM win JOIN fo USING (scenario, episode))"""


@query("w10_parameter_family_split", f"{BASE}, {FAMILY_SQL} SELECT window_id, split FROM fs")
def w10(spark: SparkSession, folder: str) -> DataFrame:
    return splits.parameter_family_split(windows(spark, folder), "axial_depth_scale", 0.3).select("window_id", "split")


@query(
    "w11_validation_split",
    f"""{BASE}, {GROUP_SQL}, vk AS (SELECT DISTINCT scenario, episode FROM gs WHERE split = 'train'),
    vr AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY md5('1214|' || scenario || '|' || episode)) AS rn, count(*) OVER (PARTITION BY scenario) AS n FROM vk)
    SELECT window_id, CASE WHEN gs.split = 'test' THEN 'test' WHEN rn <= {_held('n', 0.25)} THEN 'validation' ELSE 'fit' END AS split
    FROM gs LEFT JOIN vr USING (scenario, episode)""",
)
def w11(spark: SparkSession, folder: str) -> DataFrame:
    base = splits.grouped_split(windows(spark, folder), 0.3, 303)
    return splits.validation_split(base, lambda d: splits.grouped_split(d, 0.25, 303 + 911), "label").select(
        "window_id", "split"
    )


@query(
    "u4_split_overlap",
    f"""{BASE}, {GROUP_SQL}, r AS (SELECT scenario, episode, label, CASE WHEN label = 'stable' THEN 'test' ELSE 'train' END AS split FROM win)
    SELECT scenario, episode FROM r WHERE split = 'train' INTERSECT SELECT scenario, episode FROM r WHERE split = 'test'""",
)
def u4(spark: SparkSession, folder: str) -> DataFrame:
    leaky = windows(spark, folder).withColumn("split", F.when(F.col("label") == "stable", "test").otherwise("train"))
    return splits.overlap(leaky, "train", "test", EPISODE)


@query(
    "a33_split_report",
    f"""{BASE}, {FAMILY_SQL}, r AS (SELECT split, count(*) AS windows, count(DISTINCT (scenario, episode)) AS groups, min(start_time_s) AS start_s, max(start_time_s) AS end_s,
      min(axial_depth_scale) AS value_min, max(axial_depth_scale) AS value_max FROM fs GROUP BY split)
    SELECT {pick('split', 'start_s end_s value_min value_max', 'windows groups')} FROM r""",
)
def a33(spark: SparkSession, folder: str) -> DataFrame:
    rows = splits.parameter_family_split(windows(spark, folder), "axial_depth_scale", 0.3)
    return splits.split_report(rows, EPISODE, "axial_depth_scale")


# ---- joins ----------------------------------------------------------------------------------------------------


@query(
    "j1_interpolate_context",
    f"""{BASE}, s AS (SELECT * FROM win WHERE label <> 'stable'), c AS (SELECT episode, start_time_s AS t, spindle_rpm AS v, rms AS w FROM win WHERE label = 'stable'),
    lo AS (SELECT s.window_id, c.t, c.v, c.w FROM s ASOF JOIN c ON s.episode = c.episode AND s.start_time_s >= c.t),
    hi AS (SELECT s.window_id, c.t, c.v, c.w FROM s ASOF JOIN c ON s.episode = c.episode AND s.start_time_s < c.t),
    j AS (SELECT s.window_id, s.start_time_s AS x, lo.t AS t0, hi.t AS t1, lo.v AS v0, hi.v AS v1, lo.w AS w0, hi.w AS w1
      FROM s LEFT JOIN lo USING (window_id) LEFT JOIN hi USING (window_id)),
    i AS (SELECT window_id, CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (x - t0) / (t1 - t0) END AS rpm_at,
      CASE WHEN t0 IS NULL THEN w1 WHEN t1 IS NULL THEN w0 ELSE w0 + (w1 - w0) * (x - t0) / (t1 - t0) END AS level_at FROM j)
    SELECT {pick('window_id', 'rpm_at level_at')} FROM i""",
)
def j1(spark: SparkSession, folder: str) -> DataFrame:
    rows = windows(spark, folder)
    samples = rows.where(F.col("label") != "stable").select("episode", "start_time_s", "window_id")
    context = rows.where(F.col("label") == "stable").select(
        "episode", "start_time_s", F.col("spindle_rpm").alias("rpm_at"), F.col("rms").alias("level_at")
    )
    return align.interpolate_context(
        samples, context, ["rpm_at", "level_at"], ("episode",), "start_time_s", "window_id", LAYOUT.span
    ).select("window_id", "rpm_at", "level_at")


# Intervals: from each 'unknown' event to the next one of the same user; label by k.
INTERVAL_SQL = """
iv0 AS (SELECT scenario, episode, start_time_s AS a, lead(start_time_s) OVER (PARTITION BY episode ORDER BY start_time_s) AS b, k, window_id FROM win WHERE label = 'unknown'),
iv AS (SELECT scenario, episode, a, b, window_id AS interval_id, CASE WHEN k < 40 THEN 'stable' WHEN k < 70 THEN 'transition' WHEN k < 85 THEN 'slight' ELSE 'severe' END AS label
  FROM iv0 WHERE b > a)"""


def intervals(spark: SparkSession, folder: str) -> DataFrame:
    marks = windows(spark, folder).where(F.col("label") == "unknown")
    nxt = seq.scan(
        marks, ["episode"], LAYOUT.chunk(), LAYOUT.order,
        {"_b": seq.Running("last", F.col("start_time_s"), inclusive=False, reverse=True)},
    )
    k = F.col("k")
    return nxt.where(F.col("_b") > F.col("start_time_s")).select(
        "scenario",
        "episode",
        "start_time_s",
        F.col("_b").alias("end_time_s"),
        F.col("window_id").alias("interval_id"),
        F.when(k < 40, "stable").when(k < 70, "transition").when(k < 85, "slight").otherwise("severe").alias("label"),
    )


@query(
    "j2_label_windows",
    f"""{BASE}, {INTERVAL_SQL}, s AS (SELECT *, 0.5e0 * (start_time_s + end_time_s) AS c FROM win WHERE label <> 'unknown'),
    h AS (SELECT s.window_id, max(CASE iv.label WHEN 'stable' THEN 0 WHEN 'transition' THEN 1 WHEN 'slight' THEN 2 ELSE 3 END) AS sv
      FROM s JOIN iv ON s.episode = iv.episode AND s.c >= iv.a AND s.c <= iv.b GROUP BY s.window_id)
    SELECT s.window_id, CASE sv WHEN 0 THEN 'stable' WHEN 1 THEN 'transition' WHEN 2 THEN 'slight' WHEN 3 THEN 'severe' ELSE 'unknown' END AS label
    FROM s LEFT JOIN h USING (window_id)""",
)
def j2(spark: SparkSession, folder: str) -> DataFrame:
    rows = windows(spark, folder).where(F.col("label") != "unknown")
    slim = rows.select("episode", "window_id", "start_time_s", "end_time_s")
    return align.label_windows(
        slim, intervals(spark, folder).drop("scenario"), ["episode"], "window_id", LAYOUT.span
    ).select("window_id", "label")


@query(
    "j3_cut_by_interval",
    f"""{BASE}, smp AS (SELECT episode AS experiment, row_number() OVER (PARTITION BY episode ORDER BY start_time_s, window_id) - 1 AS i, rms FROM win),
    ci AS (SELECT episode AS experiment, row_number() OVER (PARTITION BY episode ORDER BY window_id) AS pos, k / 10e0 AS a, k / 10e0 + 2.25e0 AS b FROM win WHERE label = 'severe'),
    lb AS (SELECT episode AS experiment, row_number() OVER (PARTITION BY episode ORDER BY window_id) AS pos, k AS tag FROM win WHERE label = 'slight'),
    j AS (SELECT experiment, pos, CAST(round_even(a * 2e0, 0) AS BIGINT) AS lo, CAST(round_even(b * 2e0, 0) AS BIGINT) AS hi, tag FROM ci LEFT JOIN lb USING (experiment, pos))
    SELECT experiment, pos - 1 AS episode, i - lo AS sample_idx, tag, round(rms, 6) AS rms FROM j JOIN smp USING (experiment) WHERE i >= lo AND i < hi""",
)
def j3(spark: SparkSession, folder: str) -> DataFrame:
    rows = windows(spark, folder)
    samples = with_position(rows, ["episode"], LAYOUT.chunk(), LAYOUT.order, "_rank").select(
        F.col("episode").alias("experiment"), (F.col("_rank") - 1).alias("sample_idx"), "rms"
    )
    by_id = F.floor(F.col("window_id") / 4096).cast("long")

    def numbered(label: str) -> DataFrame:
        return with_position(rows.where(F.col("label") == label), ["episode"], by_id, ["window_id"]).withColumn(
            "experiment", F.col("episode")
        )

    cuts = numbered("severe").select(
        "experiment", "position", (F.col("k") / 10.0).alias("start"), (F.col("k") / 10.0 + 2.25).alias("end")
    )
    sheet = numbered("slight").select("experiment", "position", F.col("k").alias("tag"))
    return align.cut_by_interval(samples, cuts, sheet, "experiment", F.lit(2.0), 32, ["tag"])


_REC_SQL = f"""WITH RECURSIVE {WIN_SQL}, {HYST_SQL}, {RATE_SQL},
rec AS (SELECT hy.*, rl.feed_override, rl.spindle_override, abs(rl.feed_override - 1e0) > 1e-9 OR abs(rl.spindle_override - 1e0) > 1e-9 AS action_active,
  rl.feed_override * rl.spindle_override AS relative_mrr_proxy FROM hy JOIN rl USING (window_id))"""


def recommendations(spark: SparkSession, folder: str) -> DataFrame:
    rows = windows(spark, folder).select(*EPISODE, "window_id", "start_time_s", "label", "label_id", "score", "risk_chatter_now")
    return staged(shadow.recommend(rows, LAYOUT, "score", shadow.ShadowPolicy(threshold=0.6, clear=0.45)), "recs")


@query(
    "j4_join_recommendations",
    f"""{BASE}, rec AS (SELECT window_id, score > 0.6e0 AS shadow_warning, 0.9e0 AS risk_chatter_now FROM win WHERE label <> 'stable')
    SELECT rec.window_id, rec.shadow_warning, rec.risk_chatter_now, round(win.spindle_rpm, 6) AS spindle_rpm FROM rec JOIN win USING (window_id)""",
)
def j4(spark: SparkSession, folder: str) -> DataFrame:
    rows = windows(spark, folder)
    recs = rows.where(F.col("label") != "stable").select(
        "window_id", (F.col("score") > 0.6).alias("shadow_warning"), F.lit(0.9).alias("risk_chatter_now")
    )
    return align.join_recommendations(recs, rows.select("window_id", "risk_chatter_now", "spindle_rpm")).select(
        "window_id", "shadow_warning", "risk_chatter_now", "spindle_rpm"
    )


@query(
    "j5_positive_membership",
    f"""{BASE}, e AS (SELECT DISTINCT scenario, episode FROM win WHERE label = 'severe' AND k > 90)
    SELECT window_id, (scenario, episode) IN (SELECT (scenario, episode) FROM e) AS pseudo_label_candidate
    FROM (SELECT * FROM win) WHERE TRUE""",
)
def j5(spark: SparkSession, folder: str) -> DataFrame:
    rows = windows(spark, folder)
    hot = (F.col("label") == "severe") & (F.col("k") > 90)
    marked = rows.withColumn("label", F.when(hot, F.lit("severe")).otherwise(F.lit("stable")))
    return pseudo.mark_candidates(marked, pseudo.PseudoLabels(mode="episode")).select("window_id", "pseudo_label_candidate")


@query(
    "j8_candidate_grid",
    f"""{BASE}, g AS (SELECT * FROM (VALUES (0.92e0), (0.96e0), (1e0)) f(f) CROSS JOIN (VALUES (1e0), (1.04e0)) s(s)),
    c AS (SELECT scenario, score > 0.6e0 AS warn, CASE WHEN score > 0.6e0 THEN f ELSE 1e0 END AS applied_feed, CASE WHEN score > 0.6e0 THEN s ELSE 1e0 END AS applied_spindle, f, s FROM win CROSS JOIN g)
    SELECT scenario, warn, applied_feed, applied_spindle, count(*) AS windows, round(sum(f * s), 6) AS grid_sum FROM c GROUP BY ALL""",
)
def j8(spark: SparkSession, folder: str) -> DataFrame:
    rows = windows(spark, folder).select("scenario", "window_id", (F.col("score") > 0.6).alias("warn"))
    grid = shadow.candidate_grid(rows, (0.92, 0.96), (1.04,), "warn")
    return grid.groupBy("scenario", "warn", "applied_feed", "applied_spindle").agg(
        F.count(F.lit(1)).alias("windows"),
        F.sum(F.col("candidate_feed") * F.col("candidate_spindle")).alias("grid_sum"),
    )


@query(
    "j11_unknown_ids",
    "SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_orderkey + 7 NOT IN (SELECT o_orderkey FROM orders)",
)
def j11(spark: SparkSession, folder: str) -> DataFrame:
    asked = read(spark, folder, "lineitem").select((F.col("l_orderkey") + 7).alias("o_orderkey"))
    missing = align.require_known(asked, read(spark, folder, "orders"), "o_orderkey")
    return missing.select((F.col("o_orderkey") - 7).alias("o_orderkey"))


@query("u1_union_sources", f"{BASE} SELECT scenario, count(*) AS windows FROM win GROUP BY scenario")
def u1(spark: SparkSession, folder: str) -> DataFrame:
    rows = windows(spark, folder).select("scenario", "window_id", "label")
    parts = [rows.where(is_positive(F.col("label"))), rows.where(~is_positive(F.col("label")))]
    return parts[0].unionByName(parts[1]).groupBy("scenario").agg(F.count(F.lit(1)).alias("windows"))


@query(
    "u5_candidate_values",
    "SELECT DISTINCT round(1e0 - l_tax, 6) AS value FROM lineitem UNION SELECT 1e0",
)
def u5(spark: SparkSession, folder: str) -> DataFrame:
    values = read(spark, folder, "lineitem").select(F.round(1.0 - F.col("l_tax"), 6).alias("value"))
    return values.union(spark.range(1).select(F.lit(1.0).alias("value"))).distinct()


# ---- pseudo-labels --------------------------------------------------------------------------------------------

_PC = ("rms", "chatter_band_energy", "non_tooth_harmonic_ratio", "crest_factor")


def _value_sql(c: str) -> str:
    return f"log10(greatest({c}, 1e-18))" if c in pseudo.LOG_SCORED else c


PSEUDO_SQL = (
    "pv AS (SELECT *, " + ", ".join(f"{_value_sql(c)} AS v{i}" for i, c in enumerate(_PC)) + " FROM win),\n"
    + "ps AS (SELECT * FROM pv WHERE label = 'stable'),\n"
    + "pm AS (SELECT " + ", ".join(f"quantile_cont(v{i}, 0.5) AS m{i}, quantile_cont(v{i}, 0.75) - quantile_cont(v{i}, 0.25) AS q{i}" for i in range(4)) + " FROM ps),\n"
    + "pd AS (SELECT " + ", ".join(f"quantile_cont(abs(v{i} - m{i}), 0.5) AS d{i}" for i in range(4)) + " FROM ps CROSS JOIN pm),\n"
    + "pb AS (SELECT " + ", ".join(f"m{i}, greatest(1.4826e0 * d{i}, q{i} / 1.349e0, 1e0) AS s{i}" for i in range(4)) + " FROM pm CROSS JOIN pd),\n"
    + "sc AS (SELECT pv.*, (" + " + ".join(f"greatest(0e0, (v{i} - m{i}) / s{i})" for i in range(4)) + ") / 4e0 AS ps_score FROM pv CROSS JOIN pb)"
)
_CONFIG = pseudo.PseudoLabels(columns=_PC, mode="label", floors=(0.1, 0.15, 0.2))
CUT_SQL = """
c0 AS (SELECT quantile_cont(ps_score, 0.95) AS a, quantile_cont(ps_score, 0.99) AS b, quantile_cont(ps_score, 0.997) AS c FROM sc WHERE label = 'stable'),
c1 AS (SELECT greatest(a, 0.1e0) AS transition, b, c FROM c0),
c2 AS (SELECT transition, greatest(b, 0.15e0, transition + 1e-6) AS slight, c FROM c1),
cu AS (SELECT transition, slight, greatest(c, 0.2e0, slight + 1e-6) AS severe FROM c2)"""


@query(
    "a20_robust_baseline",
    f"{BASE}, {PSEUDO_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS name, round(m{i}, 6) + 0.0 AS median, round(s{i}, 6) + 0.0 AS scale FROM pb" for i, c in enumerate(_PC)),
)
def a20(spark: SparkSession, folder: str) -> DataFrame:
    return pseudo.robust_baseline(windows(spark, folder), _PC)


@query(
    "a21_pseudo_thresholds",
    f"{BASE}, {PSEUDO_SQL}, {CUT_SQL} SELECT {pick('', 'transition slight severe')} FROM cu",
)
def a21(spark: SparkSession, folder: str) -> DataFrame:
    rows = windows(spark, folder)
    scored = pseudo.pseudo_score(rows, staged(pseudo.robust_baseline(rows, _PC)), _PC)
    return pseudo.pseudo_thresholds(scored.where(F.col("label") == "stable"), _CONFIG)


@query(
    "a22_pseudo_labels",
    f"""{BASE}, {PSEUDO_SQL}, {CUT_SQL},
    nw AS (SELECT window_id, scenario, episode, time_us, sc.label AS source_label, ps_score, sc.label IN ('slight', 'severe') AS cand,
      CASE WHEN sc.label NOT IN ('slight', 'severe') THEN sc.label WHEN ps_score >= severe THEN 'severe' WHEN ps_score >= slight THEN 'slight'
        WHEN ps_score >= transition THEN 'transition' ELSE 'stable' END AS label FROM sc CROSS JOIN cu),
    hz AS (SELECT *, min(CASE WHEN label IN ('slight', 'severe') THEN time_us END) OVER (PARTITION BY scenario, episode ORDER BY time_us
      RANGE BETWEEN CURRENT ROW AND {HORIZON_US} FOLLOWING) AS f FROM nw)
    SELECT window_id, source_label, label, round(ps_score, 6) + 0.0 AS pseudo_label_score, cand AS pseudo_label_candidate, label <> source_label AS pseudo_label_changed,
      round(CASE WHEN f IS NULL THEN -1e0 ELSE (f - time_us) / 3e6 END, 6) + 0.0 AS time_to_chatter_s FROM hz""",
)
def a22(spark: SparkSession, folder: str) -> DataFrame:
    return pseudo.relabel(windows(spark, folder), _CONFIG, LAYOUT, HORIZON_S).select(
        "window_id", "source_label", "label", "pseudo_label_score", "pseudo_label_candidate", "pseudo_label_changed", "time_to_chatter_s"
    )


# ---- timebase -------------------------------------------------------------------------------------------------


@query(
    "a23_timebase_check",
    f"""{BASE}, g AS (SELECT scenario, episode, start_time_s, start_time_s - lag(start_time_s) OVER (PARTITION BY scenario, episode ORDER BY window_id) AS dt FROM win),
    m AS (SELECT scenario, quantile_cont(dt, 0.5) AS med, count(*) AS rows, max(start_time_s) - min(start_time_s) AS duration_s, count(*) FILTER (dt <= 0) AS bad FROM g GROUP BY scenario),
    j AS (SELECT scenario, quantile_cont(abs(dt - med), 0.5) AS mad FROM g JOIN m USING (scenario) GROUP BY scenario)
    SELECT scenario, rows, round(duration_s, 6) AS duration_s, round(1e3 / med, 6) AS rate, round(mad / greatest(med, 1e-12), 6) AS jitter, bad = 0 AS increasing,
      mad / greatest(med, 1e-12) > 0.02 AS warn FROM m JOIN j USING (scenario)""",
)
def a23(spark: SparkSession, folder: str) -> DataFrame:
    layout = Layout(keys=("scenario", "episode"), time="window_id", tie="window_id", span=4096.0)
    return timebase.timebase_summary(windows(spark, folder), layout, "start_time_s", ("scenario",)).select(
        "scenario", "rows", "duration_s", (F.col("rate_hz") * 1e3).alias("rate"), "jitter", "increasing", F.col("jitter_warning").alias("warn")
    )


@query(
    "w14_window_spec",
    f"""{BASE}, g AS (SELECT end_time_s - start_time_s + 0.5e0 AS len, start_time_s - lag(start_time_s) OVER (PARTITION BY scenario, episode ORDER BY start_time_s, window_id) AS st FROM win)
    SELECT round(quantile_cont(len, 0.5), 6) AS window_s, round(quantile_cont(st, 0.5) FILTER (st > 0), 6) AS stride_s FROM g""",
)
def w14(spark: SparkSession, folder: str) -> DataFrame:
    return slicing.infer_window_spec(windows(spark, folder), LAYOUT, 2.0)


@query(
    "w15_numbering",
    f"""{BASE} SELECT window_id, row_number() OVER (PARTITION BY scenario ORDER BY start_time_s, window_id) AS package,
      dense_rank() OVER (ORDER BY scenario) - 1 AS file_number FROM win""",
)
def w15(spark: SparkSession, folder: str) -> DataFrame:
    rows = windows(spark, folder)
    files = timebase.dense_number(rows.select("scenario").distinct(), "scenario", "file_number")
    ranked = with_position(rows, ["scenario"], LAYOUT.chunk(), LAYOUT.order, "package")
    return ranked.join(files, "scenario").select("window_id", "package", "file_number")


@query(
    "s14_source_caps",
    f"""{BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY scenario, episode ORDER BY start_time_s, window_id) AS i FROM win)
    SELECT scenario, episode, window_id, i AS position FROM r WHERE i <= 5""",
)
def s14(spark: SparkSession, folder: str) -> DataFrame:
    return timebase.first_per_source(windows(spark, folder), LAYOUT, 5).select("scenario", "episode", "window_id", "position")


@query(
    "s15_inspect_source",
    """SELECT l_shipmode AS machine, count(*) FILTER (o = 'good') AS good, count(*) FILTER (o = 'bad') AS bad FROM (
      SELECT l_returnflag || '_' || l_linestatus AS l_shipmode, CASE WHEN l_discount < 0.05e0 THEN 'good' ELSE 'bad' END AS o FROM lineitem) GROUP BY 1""",
)
def s15(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "lineitem").select(
        F.concat_ws("_", "l_returnflag", "l_linestatus").alias("machine"),
        F.when(F.col("l_discount") < 0.05, "good").otherwise("bad").alias("quality"),
    )
    return timebase.inspect_counts(rows, ("machine",), "quality", ["good", "bad"])


@query(
    "a34_ingest_summary",
    f"""{BASE} SELECT scenario, count(*) AS packages_read, count(*) FILTER (label <> 'unknown') AS packages_kept, count(*) FILTER (label = 'unknown') AS packages_skipped,
      count(*) FILTER (label = 'stable') AS stable, count(*) FILTER (label = 'transition') AS transition, count(*) FILTER (label = 'slight') AS slight,
      count(*) FILTER (label = 'severe') AS severe FROM win GROUP BY scenario""",
)
def a34(spark: SparkSession, folder: str) -> DataFrame:
    return timebase.ingest_summary(windows(spark, folder), ("scenario",), "label")


# ---- shadow mode ----------------------------------------------------------------------------------------------

BURDEN_SQL = """bd AS (SELECT scenario, count(*) AS windows, count(*) FILTER (shadow_warning) AS warning_windows, count(*) FILTER (action_active) AS action_windows,
  avg(feed_override) AS mean_feed_override, avg(spindle_override) AS mean_spindle_override, avg(relative_mrr_proxy) AS relative_mrr_proxy,
  count(*) FILTER (shadow_warning) / count(*)::DOUBLE AS warning_fraction, count(*) FILTER (action_active) / count(*)::DOUBLE AS action_fraction,
  greatest(0e0, 1e0 - avg(relative_mrr_proxy)) AS relative_mrr_loss_proxy FROM rec GROUP BY scenario)"""


@query(
    "a16_shadow_burden",
    f"{_REC_SQL}, {BURDEN_SQL} SELECT "
    + pick(
        "scenario",
        "mean_feed_override mean_spindle_override relative_mrr_proxy warning_fraction action_fraction relative_mrr_loss_proxy",
        "windows warning_windows action_windows",
    )
    + " FROM bd",
)
def a16(spark: SparkSession, folder: str) -> DataFrame:
    return shadow.burden(recommendations(spark, folder), ("scenario",))


@query("a14_shadow_events", f"{BASE}, {HYST_SQL}, {event_sql('shadow_warning', 'hy', True)} SELECT {EVENT_PICK.replace('CAST(warning_episodes AS BIGINT) AS warning_episodes, ', '')} FROM ew")
def a14_shadow(spark: SparkSession, folder: str) -> DataFrame:
    warned = seq.hysteresis(windows(spark, folder), LAYOUT, "score", 0.6, 0.45)
    return metrics.event_warning_metrics(warned, F.col("shadow_warning"), EPISODE, any_quiet_warning=True).drop("warning_episodes")


OUT_SQL = """
oc AS (SELECT window_id, scenario, episode, score > 0.6e0 AS shadow_warning, score > 0.6e0 AS action_active, risk_chatter_now AS baseline_risk,
  CASE WHEN score > 0.6e0 THEN least(1e0, greatest(0e0, risk_chatter_now - (non_tooth_harmonic_ratio - 6e0) / 20e0)) ELSE risk_chatter_now END AS shadow_risk,
  CASE WHEN score > 0.6e0 THEN 0.92e0 * 1.04e0 ELSE 1e0 END AS relative_mrr_proxy FROM win),
ou AS (SELECT *, baseline_risk - shadow_risk AS risk_reduction, baseline_risk >= 0.55e0 AS baseline_chatter, shadow_risk >= 0.55e0 AS shadow_chatter FROM oc)"""


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    on = F.col("score") > 0.6
    base = F.col("risk_chatter_now")
    changed = F.least(F.lit(1.0), F.greatest(F.lit(0.0), base - (F.col("non_tooth_harmonic_ratio") - 6.0) / 20.0))
    rows = windows(spark, folder).select(
        "window_id",
        *EPISODE,
        on.alias("shadow_warning"),
        on.alias("action_active"),
        base.alias("baseline_risk"),
        F.when(on, changed).otherwise(base).alias("shadow_risk"),
        F.when(on, 0.92 * 1.04).otherwise(1.0).alias("relative_mrr_proxy"),
    )
    return rows.withColumns(
        {
            "risk_reduction": F.col("baseline_risk") - F.col("shadow_risk"),
            "baseline_chatter": F.col("baseline_risk") >= 0.55,
            "shadow_chatter": F.col("shadow_risk") >= 0.55,
        }
    )


@query(
    "a17_outcome_windows",
    f"""{BASE}, {OUT_SQL}, s AS (SELECT scenario, count(*) AS windows, count(*) FILTER (action_active) / count(*)::DOUBLE AS action_fraction, avg(relative_mrr_proxy) AS relative_mrr_proxy,
      avg(baseline_risk) AS mean_baseline_risk, avg(shadow_risk) AS mean_shadow_risk, avg(risk_reduction) AS mean_risk_reduction,
      count(*) FILTER (risk_reduction > 0) / count(*)::DOUBLE AS positive_risk_reduction_fraction, count(*) FILTER (baseline_chatter) / count(*)::DOUBLE AS baseline_chatter_fraction,
      count(*) FILTER (shadow_chatter) / count(*)::DOUBLE AS shadow_chatter_fraction FROM ou GROUP BY scenario)
    SELECT {pick('scenario', 'action_fraction relative_mrr_proxy mean_baseline_risk mean_shadow_risk mean_risk_reduction positive_risk_reduction_fraction baseline_chatter_fraction shadow_chatter_fraction', 'windows')} FROM s""",
)
def a17(spark: SparkSession, folder: str) -> DataFrame:
    return shadow.outcome_summary(outcomes(spark, folder), ("scenario",))


EPI_SQL = """oe AS (SELECT scenario, episode, bool_or(baseline_chatter) AS b, bool_or(shadow_chatter) AS s, avg(risk_reduction) AS g FROM ou GROUP BY scenario, episode)"""


@query(
    "a17_outcome_episodes",
    f"""{BASE}, {OUT_SQL}, {EPI_SQL} SELECT scenario, count(*) AS episode_count, count(*) FILTER (b) AS baseline_event_episodes, count(*) FILTER (s) AS shadow_event_episodes,
      count(*) FILTER (b AND NOT s) AS mitigated_event_episodes, count(*) FILTER (s AND NOT b) AS worsened_event_episodes, round(avg(g), 6) + 0.0 AS mean_episode_risk_reduction
    FROM oe GROUP BY scenario""",
)
def a17_episodes(spark: SparkSession, folder: str) -> DataFrame:
    return shadow.outcome_episodes(outcomes(spark, folder), ("episode",), ("scenario",))


@query(
    "a18_policy_summary",
    f"""{BASE}, {OUT_SQL}, o AS (SELECT *, risk_reduction > 0.01e0 AS act FROM ou)
    SELECT scenario, count(*) AS windows, count(*) FILTER (shadow_warning) AS warning_windows, count(*) FILTER (act) AS action_windows, round(avg(relative_mrr_proxy), 6) AS mean_relative_mrr_proxy,
      round(coalesce(avg(risk_reduction) FILTER (act), 0e0), 6) AS mean_risk_reduction, round(count(*) FILTER (shadow_warning) / count(*)::DOUBLE, 6) AS warning_fraction,
      round(count(*) FILTER (act) / count(*)::DOUBLE, 6) AS action_fraction FROM o GROUP BY scenario""",
)
def a18(spark: SparkSession, folder: str) -> DataFrame:
    rows = outcomes(spark, folder).withColumn("action_active", F.col("risk_reduction") > 0.01)
    return shadow.policy_summary(rows, "risk_reduction", "action_active", ("scenario",))


@query(
    "t4_action_sweep",
    f"""{BASE}, g AS (SELECT row_number() OVER (ORDER BY f, s) - 1 AS candidate, f, s FROM (VALUES (0.92e0), (0.96e0), (1e0)) f(f) CROSS JOIN (VALUES (1e0), (1.04e0)) s(s)),
    c AS (SELECT scenario, episode, candidate, f, s, CASE WHEN score > 0.6e0 THEN f ELSE 1e0 END AS af, CASE WHEN score > 0.6e0 THEN s ELSE 1e0 END AS xs, risk_chatter_now AS br, non_tooth_harmonic_ratio AS h FROM win CROSS JOIN g),
    o AS (SELECT *, least(1e0, greatest(0e0, br - (1e0 - af) * (h - 5e0) / 4e0 - (xs - 1e0) * (7e0 - h) / 3e0)) AS sr FROM c),
    w AS (SELECT candidate, avg(br - sr) AS mean_risk_reduction, avg(af * xs) AS relative_mrr_proxy, any_value(f) AS feed_override, any_value(s) AS spindle_override FROM o GROUP BY candidate),
    e AS (SELECT candidate, scenario, episode, bool_or(br >= 0.95e0) AS b, bool_or(sr >= 0.95e0) AS s2 FROM o GROUP BY ALL),
    x AS (SELECT candidate, count(*) FILTER (s2 AND NOT b) AS worsened_event_episodes FROM e GROUP BY candidate)
    SELECT candidate, round(mean_risk_reduction, 6) AS mean_risk_reduction, round(relative_mrr_proxy, 6) AS relative_mrr_proxy, worsened_event_episodes, feed_override, spindle_override
    FROM w JOIN x USING (candidate) ORDER BY round(w.mean_risk_reduction, 12) DESC, round(w.relative_mrr_proxy, 12) DESC, worsened_event_episodes, candidate LIMIT 1""",
)
def t4(spark: SparkSession, folder: str) -> DataFrame:
    rows = windows(spark, folder).select(
        *EPISODE, "window_id", (F.col("score") > 0.6).alias("warn"), "risk_chatter_now", "non_tooth_harmonic_ratio"
    )
    grid = shadow.candidate_grid(rows, (0.92, 0.96), (1.04,), "warn")
    base, h = F.col("risk_chatter_now"), F.col("non_tooth_harmonic_ratio")
    changed = base - (1.0 - F.col("applied_feed")) * (h - 5.0) / 4.0 - (F.col("applied_spindle") - 1.0) * (7.0 - h) / 3.0
    risk = F.least(F.lit(1.0), F.greatest(F.lit(0.0), changed))
    out = grid.withColumn("shadow_risk", risk).withColumns(
        {
            "risk_reduction": base - F.col("shadow_risk"),
            "relative_mrr_proxy": F.col("applied_feed") * F.col("applied_spindle"),
            "baseline_chatter": base >= 0.95,
            "shadow_chatter": F.col("shadow_risk") >= 0.95,
            "action_active": F.col("warn"),
            "baseline_risk": base,
        }
    )
    point = ("candidate", "candidate_feed", "candidate_spindle")
    sweep = shadow.outcome_summary(out, point).join(
        shadow.outcome_episodes(out, EPISODE, ("candidate",)).select("candidate", "worsened_event_episodes"), "candidate"
    )
    return shadow.sweep_best(sweep).select(
        "candidate",
        "mean_risk_reduction",
        "relative_mrr_proxy",
        "worsened_event_episodes",
        F.col("candidate_feed").alias("feed_override"),
        F.col("candidate_spindle").alias("spindle_override"),
    )


@query(
    "w13_override_profile",
    f"""WITH RECURSIVE {WIN_SQL}, {HYST_SQL}, {RATE_SQL},
    r AS (SELECT scenario, episode, window_id, feed_override, CAST(round_even(start_time_s * 0.0003::DOUBLE, 0) AS BIGINT) AS s0, start_time_s FROM hy JOIN rl USING (scenario, episode, window_id)),
    q AS (SELECT *, greatest(0, least(s0, 269)) AS st FROM r),
    n AS (SELECT *, coalesce(lead(st) OVER (PARTITION BY scenario, episode ORDER BY start_time_s, window_id), 270) AS en FROM q),
    e AS (SELECT scenario, episode, unnest(range(st, en)) AS step, feed_override FROM n WHERE st < en)
    SELECT scenario, step, count(*) AS episodes, round(sum(feed_override), 6) AS feed_sum FROM e GROUP BY scenario, step""",
)
def w13(spark: SparkSession, folder: str) -> DataFrame:
    recs = recommendations(spark, folder).withColumn("end_step", F.lit(270).cast("long"))
    held = slicing.override_profile(recs, LAYOUT, 0.0003, ("feed_override",), "end_step")
    return held.groupBy("scenario", "step").agg(
        F.count(F.lit(1)).alias("episodes"), F.sum("feed_override").alias("feed_sum")
    )


