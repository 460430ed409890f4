"""Scalar-function queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindleflow.functions import control as ctl
from spindleflow.functions import features as feat
from spindleflow.functions import labels as lab
from spindleflow.functions import physics as phys
from spindleflow.functions.risk import RiskInputs, risk_struct, safe_log, safe_log10, sigmoid
from spindleflow.operators.quantiles import spread_of
from spindleflow.plans.catalog import pick, query, read
from spindleflow.plans.inputs import ID_CASE, TRACE_SQL, WIN_SQL, trace, windows


@query(
    "p1_label_maps",
    f"""WITH {WIN_SQL} SELECT window_id, label, CAST(label_id AS BIGINT) AS label_id, CAST(sev AS BIGINT) AS severity,
      label IN ('slight', 'severe') AS positive, label AS back FROM win""",
)
def p1(spark: SparkSession, folder: str) -> DataFrame:
    return windows(spark, folder).select(
        "window_id",
        "label",
        "label_id",
        lab.severity_of_label(F.col("label")).alias("severity"),
        lab.is_positive(F.col("label")).alias("positive"),
        lab.label_of_id(F.col("label_id")).alias("back"),
    )


def _words(label: str) -> str:
    return ", ".join(f"'{w}'" for w in lab.STATUS_WORDS[label])


def status_sql(expr: str) -> str:
    word = f"lower(trim({expr}))"
    cases = " ".join(f"WHEN {word} IN ({_words(x)}) THEN '{x}'" for x in lab.STATUS_WORDS)
    return (
        f"CASE WHEN {expr} IS NULL THEN 'unknown' {cases} WHEN try_cast({word} AS DOUBLE) > 0.5 THEN 'slight'"
        f" WHEN try_cast({word} AS DOUBLE) IS NOT NULL THEN 'stable' ELSE 'unknown' END"
    )


_TEXTS = (
    "SELECT event_id, unnest([event_type, upper(event_type), ' ' || CAST(value / 500 AS VARCHAR) || ' ',"
    " CASE event_type WHEN 'error' THEN ' Severe' WHEN 'view' THEN 'Non-Chatter' WHEN 'click' THEN 'INCIPIENT'"
    " WHEN 'signup' THEN 'No Machining' END]) AS text FROM events"
)


@query("p2_status_to_label", f"SELECT {status_sql('text')} AS label, count(*) AS windows FROM ({_TEXTS}) GROUP BY 1")
def p2(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    texts = F.array(
        kind,
        F.upper(kind),
        F.concat(F.lit(" "), (F.col("value") / 500).cast("string"), F.lit(" ")),
        F.when(kind == "error", " Severe")
        .when(kind == "view", "Non-Chatter")
        .when(kind == "click", "INCIPIENT")
        .when(kind == "signup", "No Machining"),
    )
    rows = read(spark, folder, "events").select(F.explode(texts).alias("text"))
    return rows.groupBy(lab.status_to_label(F.col("text")).alias("label")).agg(F.count(F.lit(1)).alias("windows"))


@query(
    "p3_votes_and_comments",
    """SELECT l.doc_id,
      CASE WHEN greatest(l.quality, 2 * l.toxic) <= 0 THEN 'stable' WHEN greatest(l.quality, 2 * l.toxic) < 2 THEN 'slight'
           ELSE 'severe' END AS vote_label,
      CASE WHEN l.quality = 1 THEN 'stable' ELSE 'severe' END AS quality_label,
      CASE l.doc_id % 4 WHEN 0 THEN 'stable' WHEN 1 THEN 'slight' WHEN 2 THEN 'stable' ELSE 'unknown' END AS comment_label
    FROM labels l""",
)
def p3(spark: SparkSession, folder: str) -> DataFrame:
    comments = F.array(F.lit("  "), F.lit("Finishing with CHATTER"), F.lit(" Roughing "), F.lit("trial cut"))
    return read(spark, folder, "labels").select(
        "doc_id",
        lab.vote_to_label(F.col("quality"), 2 * F.col("toxic")).alias("vote_label"),
        lab.quality_to_label(F.when(F.col("quality") == 1, "good").otherwise("bad")).alias("quality_label"),
        lab.comment_to_label(F.get(comments, (F.col("doc_id") % 4).cast("int"))).alias("comment_label"),
    )


@query(
    "p4_risk_to_label",
    """SELECT CASE WHEN l_discount * 10e0 < 0.30e0 THEN 'stable' WHEN l_discount * 10e0 < 0.55e0 THEN 'transition'
      WHEN l_discount * 10e0 < 0.80e0 THEN 'slight' ELSE 'severe' END AS label, count(*) AS windows
    FROM lineitem GROUP BY 1""",
)
def p4(spark: SparkSession, folder: str) -> DataFrame:
    return (
        read(spark, folder, "lineitem")
        .groupBy(lab.risk_to_label(F.col("l_discount") * 10.0).alias("label"))
        .agg(F.count(F.lit(1)).alias("windows"))
    )


def _sig(x: str) -> str:
    return f"(1e0 / (1e0 + exp(-({x}))))"


RISK_SQL = f"""
rk0 AS (SELECT *, {_sig('-margin_physics / 0.2e0')} AS phys,
   least(1e0, 0.55e0 * {_sig('(log10(chatter_band_energy / greatest(tooth_band_energy, 1e-18) + 1e-12) + 0.4e0) * 2e0')}
     + 0.25e0 * {_sig('(crest_factor - 4e0) / 1.5e0')} + 0.2e0 * {_sig('(spectral_entropy - 0.55e0) * 6e0')}) AS sig,
   k <> 7 AS healthy, k <> 11 AS in_cut FROM win),
rk1 AS (SELECT *, least(1e0, greatest(0e0, 0.55e0 * phys + 0.45e0 * sig)) AS now FROM rk0),
rk AS (SELECT window_id, scenario, healthy, in_cut,
   CASE WHEN healthy AND in_cut THEN now ELSE 0.5e0 END AS risk_now,
   CASE WHEN healthy AND in_cut THEN least(1e0, greatest(now, 0.75e0 * phys + 0.25e0 * sig)) ELSE 0.5e0 END AS risk_ahead,
   CASE WHEN healthy AND in_cut THEN 1e0 - 2e0 * sig ELSE 0e0 END AS margin_signal,
   CASE WHEN healthy AND in_cut THEN least(0.95e0, 0.12e0 + 0.55e0 * exp(-abs(margin_physics) / 0.2e0)) ELSE 0.95e0 END AS unsure,
   CASE WHEN NOT (healthy AND in_cut) THEN 'unknown' WHEN now < 0.3e0 THEN 'stable' WHEN now < 0.55e0 THEN 'transition'
        WHEN now < 0.8e0 THEN 'slight' ELSE 'severe' END AS risk_label,
   CASE WHEN NOT healthy THEN 'sensor_unhealthy' WHEN NOT in_cut THEN 'not_in_cut'
        ELSE coalesce(nullif(concat_ws(';', CASE WHEN margin_physics < 0 THEN 'negative_physics_margin' END,
          CASE WHEN sig > 0.55e0 THEN 'chatter_band_energy' END, CASE WHEN phys > 0.7e0 THEN 'near_stability_boundary' END,
          CASE WHEN crest_factor > 5e0 THEN 'impulsive_vibration' END), ''), 'nominal') END AS reasons
  FROM rk1)"""


def risk_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = windows(spark, folder)
    risk = risk_struct(
        RiskInputs(
            F.col("chatter_band_energy"),
            F.col("tooth_band_energy"),
            F.col("crest_factor"),
            F.col("spectral_entropy"),
            F.col("margin_physics"),
            F.col("k") != 7,
            F.col("k") != 11,
        )
    )
    return rows.withColumn("risk", risk)


@query(
    "p5_risk_score",
    f"WITH {WIN_SQL}, {RISK_SQL} SELECT {pick('window_id risk_label', 'risk_now risk_ahead margin_signal unsure')} FROM rk",
)
def p5(spark: SparkSession, folder: str) -> DataFrame:
    return risk_rows(spark, folder).select(
        "window_id",
        F.col("risk.label").alias("risk_label"),
        F.col("risk.risk_chatter_now").alias("risk_now"),
        F.col("risk.risk_chatter_horizon").alias("risk_ahead"),
        F.col("risk.margin_signal").alias("margin_signal"),
        F.col("risk.uncertainty").alias("unsure"),
    )


@query("p6_reason_codes", f"WITH {WIN_SQL}, {RISK_SQL} SELECT window_id, reasons FROM rk")
def p6(spark: SparkSession, folder: str) -> DataFrame:
    return risk_rows(spark, folder).select("window_id", F.array_join("risk.reasons", ";").alias("reasons"))


@query(
    "p7_guarded_math",
    f"""WITH {WIN_SQL}, m AS (SELECT window_id, {_sig('margin_physics * 30e0')} AS logistic,
      least(greatest(margin_physics, -0.4e0), 0.6e0) AS clipped, ln(greatest(margin_physics, 1e-18)) AS ln_floor,
      log10(greatest(margin_physics, 1e-18)) AS log10_floor FROM win)
    SELECT {pick('window_id', 'logistic clipped ln_floor log10_floor')} FROM m""",
)
def p7(spark: SparkSession, folder: str) -> DataFrame:
    margin = F.col("margin_physics")
    return windows(spark, folder).select(
        "window_id",
        sigmoid(margin * 30.0).alias("logistic"),
        F.least(F.greatest(margin, F.lit(-0.4)), F.lit(0.6)).alias("clipped"),
        safe_log(margin).alias("ln_floor"),
        safe_log10(margin).alias("log10_floor"),
    )


_DERIVED_SQL = """(1e0 - margin_physics) AS depth_to_critical_ratio,
  1.1e3 * axial_depth_m / greatest(1e0 - margin_physics, 1e-6) AS critical_depth_proxy_m,
  1.1e3 * (axial_depth_m / greatest(1e0 - margin_physics, 1e-6) - axial_depth_m) AS distance_to_boundary_m,
  (cutting_coeff_t_n_m2 + cutting_coeff_r_n_m2) * axial_depth_m * feed_per_tooth_m AS process_force_proxy_n,
  axial_depth_profile_scale * cutting_coeff_profile_scale AS process_severity_proxy,
  score * axial_depth_profile_scale AS profile_progress,
  (1e0 - margin_physics) * chatter_band_energy AS margin_chatter_energy_interaction,
  (1e0 - margin_physics) * rms AS margin_rms_interaction,
  (1e0 - margin_physics) * crest_factor AS chatter_growth_pressure,
  (1e0 - margin_physics) * uncertainty AS rms_growth_pressure"""


@query(
    "p8_derived_features",
    f"WITH {WIN_SQL}, d AS (SELECT window_id, {_DERIVED_SQL} FROM win)"
    f" SELECT {pick('window_id', ' '.join(feat.INTERACTION))} FROM d",
)
def p8(spark: SparkSession, folder: str) -> DataFrame:
    rows = windows(spark, folder).withColumns(
        {
            "episode_progress": F.col("score"),
            "chatter_band_energy_growth_rate": F.col("crest_factor"),
            "rms_growth_rate": F.col("uncertainty"),
        }
    )
    out = feat.derived_features(rows)
    return out.select(
        "window_id",
        *[
            (F.col(c) * 1.1e3 if c in ("critical_depth_proxy_m", "distance_to_boundary_m") else F.col(c)).alias(c)
            for c in feat.INTERACTION
        ],
    )


_SET = ("margin_physics", "rms", "chatter_band_energy", "cutting_coeff_t_n_m2", "depth_to_critical_ratio", "process_force_proxy_n")


@query(
    "p9_feature_projection",
    f"""WITH {WIN_SQL}, f AS (SELECT window_id, margin_physics, log10(greatest(rms, 1e-18)) AS rms,
      log10(greatest(chatter_band_energy, 1e-18)) AS chatter_band_energy,
      log10(greatest(cutting_coeff_t_n_m2, 1e-18)) AS cutting_coeff_t_n_m2, 1e0 - margin_physics AS depth_to_critical_ratio,
      (cutting_coeff_t_n_m2 + cutting_coeff_r_n_m2) * axial_depth_m * feed_per_tooth_m AS process_force_proxy_n FROM win)
    SELECT {pick('window_id', ' '.join(_SET))} FROM f""",
)
def p9(spark: SparkSession, folder: str) -> DataFrame:
    return feat.project_features(windows(spark, folder), _SET, ("window_id",))


_CAL = phys.MarginCalibration(
    intercept=-0.4,
    coefficients=(-1.2, 0.3, 0.2),
    feature_names=("raw_margin", "log_spindle_rpm", "radial_immersion_ratio"),
    feature_means=(0.0, 9.0, 0.4),
    feature_stds=(0.6, 0.2, 0.1),
    holdout_brier=0.119,
)


@query(
    "p10_margin_calibration",
    f"""WITH {WIN_SQL}, p AS (SELECT window_id, {_sig('-0.4e0 - 1.2e0 * margin_physics / 0.6e0 + 0.3e0 * (ln(spindle_rpm) - 9e0) / 0.2e0 + 0.2e0 * (radial_depth_m / 0.01e0 - 0.4e0) / 0.1e0')} AS p,
        uncertainty AS u0 FROM win),
    o AS (SELECT window_id, p AS calibrated_probability,
        -0.2e0 * ln(least(greatest(p, 1e-6), 1e0 - 1e-6) / (1e0 - least(greatest(p, 1e-6), 1e0 - 1e-6))) AS calibrated_margin,
        least(0.95e0, greatest(0.05e0, 0.08e0 + 0.35e0 * 4e0 * p * (1e0 - p) + 0.119e0)) AS cu, u0 FROM p)
    SELECT window_id, round(calibrated_probability, 6) + 0.0 AS calibrated_probability,
        round(calibrated_margin, 6) + 0.0 AS calibrated_margin, round(greatest(cu, u0), 6) + 0.0 AS uncertainty,
        CASE WHEN cu > u0 THEN 'nominal;calibration_uncertainty' ELSE 'nominal' END AS reasons FROM o""",
)
def p10(spark: SparkSession, folder: str) -> DataFrame:
    rows = windows(spark, folder).withColumn("reasons", F.array(F.lit("nominal")))
    rows = rows.withColumns(phys.calibrated(_CAL, rows.columns, F.col("margin_physics")))
    rows = rows.withColumns(
        phys.raise_uncertainty(F.col("uncertainty"), F.col("reasons"), F.col("calibrated_uncertainty"))
    )
    return rows.select(
        "window_id", "calibrated_probability", "calibrated_margin", "uncertainty", F.array_join("reasons", ";").alias("reasons")
    )


@query(
    "p11_context_features",
    f"""WITH {WIN_SQL}, c AS (SELECT window_id, margin_physics AS raw_margin, ln(spindle_rpm) AS log_spindle_rpm,
      ln(spindle_rpm * 4e0 / 60e0) AS log_tooth_frequency_hz, ln(axial_depth_m) AS log_axial_depth_m,
      ln(radial_depth_m) AS log_radial_depth_m, ln(feed_per_tooth_m) AS log_feed_per_tooth_m,
      ln(cutting_coeff_t_n_m2) AS log_cutting_coeff_t_n_m2, ln(cutting_coeff_r_n_m2) AS log_cutting_coeff_r_n_m2,
      ln(700e0) AS log_modal_frequency_hz, 0.03e0 AS modal_damping_ratio, 1.55e7 / 1.25e7 AS stiffness_ratio_xy,
      radial_depth_m / 0.01e0 AS radial_immersion_ratio, 1e-6 / feed_per_tooth_m AS runout_to_feed_ratio FROM win)
    SELECT {pick('window_id', ' '.join(phys.CONTEXT_FEATURES))} FROM c""",
)
def p11(spark: SparkSession, folder: str) -> DataFrame:
    rows = windows(spark, folder)
    return rows.select(
        "window_id",
        *[c.alias(n) for n, c in phys.context_features(rows.columns, F.col("margin_physics")).items()],
    )


@query(
    "p12_units",
    """SELECT p_partkey, round(1e6 * greatest(p_retailprice / 1000e0 / greatest((100e0 + p_size) * 4, 1e-12), 1e-9), 6) AS from_mm_um,
      round(1e6 * greatest((p_size - 5) * 0.0254e0, 0e0), 6) AS depth_um,
      round(1e6 * CASE WHEN (p_size - 5) * 0.0254e0 <= 0 THEN 1e-9
        ELSE greatest((p_size - 5) * 0.0254e0 / (greatest(p_size * 30e0, 1e0) * 4), 1e-9) END, 6) AS from_inch_um,
      round(1e6 * (p_size / 1000e0), 6) AS mm_um FROM part""",
)
def p12(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    return read(spark, folder, "part").select(
        "p_partkey",
        (1e6 * phys.feed_from_mm_min(F.col("p_retailprice"), 100.0 + size, F.lit(4))).alias("from_mm_um"),
        (1e6 * phys.inch_to_m(size - 5)).alias("depth_um"),
        (1e6 * phys.feed_from_inch_min(size - 5, size * 30.0, F.lit(4))).alias("from_inch_um"),
        (1e6 * phys.mm_to_m(size)).alias("mm_um"),
    )


@query(
    "p13_text_mining",
    r"""WITH t AS (SELECT p_partkey, p_size || ' - ' || (p_size + 3) || '.5 mm of ' || p_brand AS overlap,
        CASE WHEN p_size % 3 = 0 THEN p_name ELSE (p_size % 6) || CASE p_size % 3 WHEN 1 THEN '-Flute ' ELSE ' flute ' END || p_name END AS tool,
        CASE WHEN p_size % 2 = 0 THEN p_name ELSE ' 1.25 ' END AS first_try, CAST(p_size AS VARCHAR) AS second_try FROM part),
      n AS (SELECT *, list_transform(regexp_extract_all(overlap, '\d+(\.\d+)?'), lambda x: CAST(x AS DOUBLE)) AS nums FROM t)
    SELECT p_partkey, round(list_sum(nums) / len(nums), 6) + 0.0 AS overlap_mid,
      CASE WHEN regexp_extract(tool, '(?i)(\d+)\s*[- ]?\s*flute', 1) = '' THEN 4
        ELSE greatest(CAST(regexp_extract(tool, '(?i)(\d+)\s*[- ]?\s*flute', 1) AS BIGINT), 1) END AS flutes,
      coalesce(try_cast(trim(first_try) AS DOUBLE), try_cast(second_try AS DOUBLE)) AS depth FROM n""",
)
def p13(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size")
    text = size.cast("string")
    marks = F.when(size % 3 == 1, "-Flute ").otherwise(" flute ")
    return read(spark, folder, "part").select(
        "p_partkey",
        phys.mean_of_numbers(
            F.concat(text, F.lit(" - "), (size + 3).cast("string"), F.lit(".5 mm of "), F.col("p_brand"))
        ).alias("overlap_mid"),
        phys.flute_count(
            F.when(size % 3 == 0, F.col("p_name")).otherwise(F.concat((size % 6).cast("string"), marks, F.col("p_name")))
        ).alias("flutes"),
        phys.first_number(F.when(size % 2 == 0, F.col("p_name")).otherwise(F.lit(" 1.25 ")), text).alias("depth"),
    )


@query(
    "p14_physics_scalars",
    """WITH b AS (SELECT p_partkey, (6000e0 + 100e0 * p_size) * 4 / 60e0 AS ft, 0.0005e0 + sqrt(p_size) * 1e-4 AS ae,
        1.55e7 * (1e0 + p_size / 100e0) AS kx FROM part)
    SELECT p_partkey, round(ft, 6) AS tooth_hz, round(0.2e0 + 2e0 * abs(sin(pi() * 711.5e0 / ft)), 6) AS regen,
      round((0.5e0 + least(greatest(ae / 0.01e0, 0.02e0), 1e0)) * (0.65e0 + 0.5e0) * (1e0 + 0.25e0 * 2.1e8 / 7e8), 6) AS direction,
      round(0.5e0 * (sqrt(kx / 0.8e0) + sqrt(1.25e7 / 0.8e0)) / (2e0 * pi()), 6) AS natural_hz,
      round(0.5e0 * (210e0 / (2e0 * sqrt(kx * 0.8e0)) + 190e0 / (2e0 * sqrt(1.25e7 * 0.8e0))), 6) AS damping FROM b""",
)
def p14(spark: SparkSession, folder: str) -> DataFrame:
    tooth = phys.tooth_frequency(6000.0 + 100.0 * F.col("p_size"), 4)
    modal = phys.Modal(stiffness_x_n_m=1.55e7 * (1.0 + F.col("p_size") / 100.0))
    cut = phys.Cut(radial_depth_m=0.0005 + F.sqrt("p_size") * 1e-4)
    return read(spark, folder, "part").select(
        "p_partkey",
        tooth.alias("tooth_hz"),
        phys.regenerative_factor(F.lit(711.5), tooth).alias("regen"),
        phys.directional_factor(cut, phys.Tool()).alias("direction"),
        phys.natural_frequency(modal).alias("natural_hz"),
        phys.damping_ratio(modal).alias("damping"),
    )


def _near(x: str, prev: str) -> str:
    return f"least(greatest({x}, {prev} - 0.05e0), {prev} + 0.05e0)"


def shield_sql(mode: str) -> str:
    reject = "blocked OR unknown OR " + ("unsure" if mode == "reject" else "FALSE")
    hold = "unsure" if mode == "hold" else "FALSE"
    return f"""
    s0 AS (SELECT *, l_partkey % 11 = 0 AS blocked, l_partkey % 13 = 0 AS unknown, risk_uncertainty > 0.65e0 AS unsure,
        least(greatest(raw_feed_override, 0.8e0), 1.05e0) AS cf, least(greatest(raw_spindle_override, 0.9e0), 1.1e0) AS cs FROM tr),
    s1 AS (SELECT *, {reject} AS reject, NOT ({reject}) AND {hold} AS hold,
        {_near('cf', 'previous_feed_override')} AS lf, {_near('cs', 'previous_spindle_override')} AS ls FROM s0),
    s AS (SELECT *, CASE WHEN reject OR hold THEN previous_feed_override ELSE lf END AS feed_out,
        CASE WHEN reject OR hold THEN previous_spindle_override ELSE ls END AS spindle_out,
        concat_ws(';', CASE WHEN blocked THEN 'controller_mode_blocked' END, CASE WHEN unknown THEN 'unknown_chatter_state' END,
          CASE WHEN unsure THEN 'high_uncertainty' END, CASE WHEN hold THEN 'uncertainty_hold' END,
          CASE WHEN NOT reject AND NOT hold AND cf <> raw_feed_override THEN 'feed_clipped' END,
          CASE WHEN NOT reject AND NOT hold AND cs <> raw_spindle_override THEN 'spindle_clipped' END,
          CASE WHEN NOT reject AND NOT hold AND lf <> cf THEN 'feed_rate_limited' END,
          CASE WHEN NOT reject AND NOT hold AND ls <> cs THEN 'spindle_rate_limited' END) AS why FROM s1)"""


def _register_shield(mode: str) -> None:
    @query(
        f"p15_shield_{mode}",
        f"""WITH {TRACE_SQL}, {shield_sql(mode)} SELECT why, reject, count(*) AS steps,
          round(sum(feed_out), 6) AS feed_sum, round(sum(spindle_out), 6) AS spindle_sum FROM s GROUP BY why, reject""",
    )
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = trace(spark, folder).withColumns(
            {
                "mode": F.when(F.col("l_partkey") % 11 == 0, "manual").otherwise("auto"),
                "state": F.when(F.col("l_partkey") % 13 == 0, "unknown").otherwise(F.col("risk_label")),
            }
        )
        out = ctl.apply_shield(
            rows,
            ctl.Shield(uncertainty_mode=mode),
            "raw_feed_override",
            "raw_spindle_override",
            "previous_feed_override",
            "previous_spindle_override",
            "state",
            "risk_uncertainty",
            mode="mode",
        )
        return out.groupBy(
            F.array_join("shield_reasons", ";").alias("why"), F.col("shield_rejected").alias("reject")
        ).agg(
            F.count(F.lit(1)).alias("steps"),
            F.sum("shield_feed_override").alias("feed_sum"),
            F.sum("shield_spindle_override").alias("spindle_sum"),
        )


for _mode in ("reject", "hold", "advisory"):
    _register_shield(_mode)


@query(
    "p16_action_mapping",
    f"""WITH {TRACE_SQL},
    a AS (SELECT *, current_margin * 0.9e0 AS act, least(greatest(current_margin * 0.9e0 / 0.5e0, -1e0), 1e0) AS share FROM tr),
    b AS (SELECT scenario, previous_feed_override + act * 0.05e0 AS fixed,
        previous_feed_override + share * CASE WHEN share >= 0 THEN least(0.025e0, greatest(0e0, 1.05e0 - previous_feed_override))
          ELSE least(0.025e0, greatest(0e0, previous_feed_override - 0.8e0)) END AS headroom,
        coalesce(guard_candidate_uncertainty > 0.65e0, FALSE) OR risk_label = 'slight' AS fb, raw_feed_override AS rf,
        least(greatest(raw_feed_override, 0.8e0), 1.05e0) AS cf, previous_feed_override AS pf FROM a)
    SELECT scenario, fb AS fallback, count(*) AS steps, round(sum(fixed), 5) AS fixed_sum, round(sum(headroom), 5) AS headroom_sum,
      round(sum(CASE WHEN fb THEN pf ELSE cf END), 5) AS guard_sum, count(*) FILTER (cf <> rf) AS clipped FROM b GROUP BY scenario, fb""",
)
def p16(spark: SparkSession, folder: str) -> DataFrame:
    rows = trace(spark, folder)
    act, prev = F.col("current_margin") * 0.9, F.col("previous_feed_override")
    rows = rows.withColumns(
        {
            "fixed": ctl.map_action(act, prev, 0.80, 1.05, 0.05, "fixed"),
            "headroom": ctl.map_action(act, prev, 0.80, 1.05, 0.05, "headroom", 0.5),
            "cand_label": F.when(F.col("risk_label") == "slight", "unknown").otherwise("stable"),
            "cand_unc": F.coalesce("guard_candidate_uncertainty", F.lit(0.0)),
        }
    )
    out = ctl.guard_action(
        rows,
        ctl.Shield(),
        "raw_feed_override",
        "raw_spindle_override",
        "previous_feed_override",
        "previous_spindle_override",
        "cand_label",
        "cand_unc",
    )
    return out.groupBy("scenario", (F.col("guard_fallback") == 1).alias("fallback")).agg(
        F.count(F.lit(1)).alias("steps"),
        F.round(F.sum("fixed"), 5).alias("fixed_sum"),
        F.round(F.sum("headroom"), 5).alias("headroom_sum"),
        F.round(F.sum("guard_feed_override"), 5).alias("guard_sum"),
        F.sum(ctl.count_in(F.col("guard_reasons"), "feed_clipped")).alias("clipped"),
    )


@query(
    "p17_control_reward",
    f"""WITH {TRACE_SQL},
    w AS (SELECT *, 1.5e0 * (shield_feed_override * shield_spindle_override) AS prod,
        0.5e0 * (abs(shield_feed_override - previous_feed_override) + abs(shield_spindle_override - previous_spindle_override)) AS smooth,
        CASE WHEN risk_label = 'severe' THEN 2e0 ELSE 0e0 END AS sev, CASE WHEN shield_rejected = 1 THEN 0.75e0 ELSE 0e0 END AS rej,
        0.1e0 * (CASE WHEN guard_reasons LIKE '%feed_clipped%' THEN 1 ELSE 0 END + CASE WHEN guard_reasons LIKE '%spindle_clipped%' THEN 1 ELSE 0 END) AS clp,
        0.05e0 * CASE WHEN shield_reasons LIKE '%feed_rate_limited%' THEN 1 ELSE 0 END AS rate FROM tr)
    SELECT controller, scenario, round(avg(prod - 3e0 * risk_now - 1.5e0 * risk_horizon - sev - smooth - rej - clp - rate), 6) + 0.0 AS reward,
      round(avg(prod), 6) AS productivity, round(avg(smooth), 6) AS smoothness_penalty, round(avg(clp), 6) + 0.0 AS guard_penalty
    FROM w GROUP BY controller, scenario""",
)
def p17(spark: SparkSession, folder: str) -> DataFrame:
    config = ctl.Reward(productivity_weight=1.5, productivity_mode="mrr", clip_penalty=0.1, rate_limit_penalty=0.05)
    c = F.col
    reasons = F.concat("guard_reasons", "shield_reasons")
    terms = ctl.control_reward(
        config, c("shield_feed_override"), c("shield_spindle_override"), c("previous_feed_override"),
        c("previous_spindle_override"), c("risk_now"), c("risk_horizon"), c("risk_label"), c("shield_rejected") == 1, reasons,
    )
    rows = trace(spark, folder).withColumns(
        {**terms, "_guard": ctl.guard_penalty(config, F.lit(True), c("guard_reasons"))}
    )
    return rows.groupBy("controller", "scenario").agg(
        F.avg("control_reward").alias("reward"),
        F.avg("productivity").alias("productivity"),
        F.avg("smoothness_penalty").alias("smoothness_penalty"),
        F.avg("_guard").alias("guard_penalty"),
    )


_ACTIVE = (
    "(abs(shield_feed_override - previous_feed_override) > 1e-9"
    " OR abs(shield_spindle_override - previous_spindle_override) > 1e-9)"
)


@query(
    "p18_productivity_action",
    f"""WITH {TRACE_SQL} SELECT controller, round(avg(shield_feed_override * shield_spindle_override), 6) AS relative_mrr_proxy,
      count(*) FILTER ({_ACTIVE}) AS action_steps,
      count(*) FILTER (abs(shield_feed_override - 1e0) > 1e-9 OR abs(shield_spindle_override - 1e0) > 1e-9) AS active_from_rest
    FROM tr GROUP BY controller""",
)
def p18(spark: SparkSession, folder: str) -> DataFrame:
    feed, spindle = F.col("shield_feed_override"), F.col("shield_spindle_override")
    moved = ctl.action_active(feed, spindle, F.col("previous_feed_override"), F.col("previous_spindle_override"))
    return trace(spark, folder).groupBy("controller").agg(
        F.avg(ctl.productivity_proxy(feed, spindle)).alias("relative_mrr_proxy"),
        F.count(F.when(moved, 1)).alias("action_steps"),
        F.count(F.when(ctl.action_active(feed, spindle), 1)).alias("active_from_rest"),
    )


@query(
    "p19_recommendations",
    f"""WITH {TRACE_SQL} SELECT 'nightly' AS profile_label, scenario, episode, risk_label, {_ACTIVE} AS action_active,
      FALSE AS cnc_write_enabled, TRUE AS shadow_only, count(*) AS steps,
      round(sum(shield_feed_override * shield_spindle_override), 6) AS mrr, round(max(risk_now), 6) AS risk_chatter_now
    FROM tr GROUP BY scenario, episode, risk_label, {_ACTIVE}""",
)
def p19(spark: SparkSession, folder: str) -> DataFrame:
    recs = ctl.trace_to_recommendations(trace(spark, folder), "nightly", "model")
    return recs.groupBy(
        "profile_label", "scenario", "episode", "risk_label", "action_active", "cnc_write_enabled", "shadow_only"
    ).agg(
        F.count(F.lit(1)).alias("steps"),
        F.sum("relative_mrr_proxy").alias("mrr"),
        F.max("risk_chatter_now").alias("risk_chatter_now"),
    )


@query(
    "p20_standardize",
    f"""WITH {WIN_SQL},
    q AS (SELECT scenario, quantile_cont(rms, 0.5) AS m, quantile_cont(rms, 0.75) - quantile_cont(rms, 0.25) AS iqr FROM win GROUP BY scenario),
    d AS (SELECT scenario, quantile_cont(abs(rms - m), 0.5) AS mad FROM win JOIN q USING (scenario) GROUP BY scenario)
    SELECT window_id, round((rms - m) / greatest(1.4826e0 * mad, iqr / 1.349e0, 1e-9), 6) + 0.0 AS rms_std
    FROM win JOIN q USING (scenario) JOIN d USING (scenario)""",
)
def p20(spark: SparkSession, folder: str) -> DataFrame:
    rows = windows(spark, folder)
    spread = spread_of(rows, {"rms": F.col("rms")}, 1e-9, ("scenario",))
    return rows.join(spread.drop("name"), "scenario").select(
        "window_id", ((F.col("rms") - F.col("median")) / F.col("scale")).alias("rms_std")
    )


@query("p21_drop_unknown", f"WITH {WIN_SQL} SELECT window_id, label FROM win WHERE label <> 'unknown'")
def p21(spark: SparkSession, folder: str) -> DataFrame:
    return windows(spark, folder).where(F.col("label") != "unknown").select("window_id", "label")


@query(
    "p22_set_label",
    f"""WITH {WIN_SQL}, n AS (SELECT window_id, CASE WHEN risk_chatter_now < 0.3e0 THEN 'stable' WHEN risk_chatter_now < 0.55e0 THEN 'transition'
      WHEN risk_chatter_now < 0.8e0 THEN 'slight' ELSE 'severe' END AS label FROM win)
    SELECT window_id, label, CAST({ID_CASE.format('label')} AS BIGINT) AS label_id, label IN ('slight', 'severe') AS chatter_within_horizon,
      CASE WHEN label IN ('slight', 'severe') THEN 0e0 ELSE -1e0 END AS time_to_chatter_s FROM n""",
)
def p22(spark: SparkSession, folder: str) -> DataFrame:
    fresh = lab.set_label(windows(spark, folder), lab.risk_to_label(F.col("risk_chatter_now")))
    return fresh.select("window_id", "label", "label_id", "chatter_within_horizon", "time_to_chatter_s")


