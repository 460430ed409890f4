"""Queries over logged traces and evaluation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindleflow.functions.control import trace_to_recommendations
from spindleflow.operators import gates, runs, shadow
from spindleflow.plans.catalog import pick, query
from spindleflow.plans.inputs import TRACE_SQL, trace

EP_KEYS = ("training_algorithm", "controller", "scenario", "seed", "episode")
_EP = ", ".join(EP_KEYS)

EPM_SQL = f"""
epm AS (SELECT {_EP}, count(*) AS steps, sum(reward) AS total_reward, avg(risk_now) AS mean_risk, max(risk_now) AS max_risk,
    arg_max(risk_now, step) AS final_risk, arg_max(risk_label, step) AS final_label,
    count(*) FILTER (risk_label = 'severe') AS severe_steps, count(*) FILTER (risk_label = 'severe') / count(*)::DOUBLE AS severe_fraction,
    avg(shield_feed_override) AS mean_feed_override, avg(shield_spindle_override) AS mean_spindle_override,
    sum(shield_rejected) AS shield_rejections, avg(shield_feed_override) * avg(shield_spindle_override) AS relative_mrr_proxy
  FROM tr GROUP BY {_EP})"""


def summary_sql(name: str, by: str) -> str:
    return f"""
{name} AS (SELECT {by}, count(*) AS episodes, avg(total_reward) AS mean_total_reward, avg(mean_risk) AS mean_risk, max(max_risk) AS max_risk,
    avg(final_risk) AS mean_final_risk, avg(severe_fraction) AS severe_fraction, avg(mean_feed_override) AS mean_feed_override,
    avg(mean_spindle_override) AS mean_spindle_override, sum(shield_rejections) AS shield_rejections,
    avg(relative_mrr_proxy) AS relative_mrr_proxy FROM epm GROUP BY {by})"""


SUM_SQL = summary_sql("sm", "controller, scenario")
SEED_KEYS = ("training_algorithm", "controller", "scenario", "seed")
SEED_SQL = summary_sql("ss", ", ".join(SEED_KEYS))
_AGG = ", ".join(
    f"avg({m}) AS {m}_mean, coalesce(stddev_samp({m}), 0e0) AS {m}_std" for m in runs.SEED_MEASURES
)
AGG_SQL = f"""
ag AS (SELECT training_algorithm, controller, scenario, count(DISTINCT seed) AS seeds, sum(episodes) AS episodes, {_AGG},
    sum(shield_rejections) AS shield_rejections_sum, avg(shield_rejections) AS shield_rejections_mean
  FROM ss GROUP BY training_algorithm, controller, scenario)"""


def episodes(spark: SparkSession, folder: str) -> DataFrame:
    return runs.episode_metrics(trace(spark, folder), EP_KEYS)


def seed_summaries(spark: SparkSession, folder: str) -> DataFrame:
    return runs.summary_metrics(episodes(spark, folder), SEED_KEYS)


@query(
    "a3_episode_metrics",
    f"WITH {TRACE_SQL}, {EPM_SQL} SELECT "
    + pick(
        _EP + " final_label",
        "total_reward mean_risk max_risk final_risk severe_fraction mean_feed_override mean_spindle_override relative_mrr_proxy",
        "steps severe_steps shield_rejections",
    )
    + " FROM epm",
)
def a3(spark: SparkSession, folder: str) -> DataFrame:
    return episodes(spark, folder)


_SUMMARY_REAL = (
    "mean_total_reward mean_risk max_risk mean_final_risk severe_fraction mean_feed_override mean_spindle_override relative_mrr_proxy"
)


@query(
    "a4_summary_metrics",
    f"WITH {TRACE_SQL}, {EPM_SQL}, {SUM_SQL} SELECT {pick('controller scenario', _SUMMARY_REAL, 'episodes shield_rejections')} FROM sm",
)
def a4(spark: SparkSession, folder: str) -> DataFrame:
    return runs.summary_metrics(episodes(spark, folder))


@query(
    "a5_seed_aggregate",
    f"WITH {TRACE_SQL}, {EPM_SQL}, {SEED_SQL}, {AGG_SQL} SELECT "
    + pick(
        "training_algorithm controller scenario",
        " ".join(f"{m}_mean {m}_std" for m in runs.SEED_MEASURES) + " shield_rejections_mean",
        "seeds episodes shield_rejections_sum",
    )
    + " FROM ag",
)
def a5(spark: SparkSession, folder: str) -> DataFrame:
    return runs.seed_aggregate(seed_summaries(spark, folder))


_MEANS_SQL = {
    "mean_raw_feed_override": "raw_feed_override",
    "mean_raw_spindle_override": "raw_spindle_override",
    "mean_guard_feed_override": "guard_feed_override",
    "mean_guard_spindle_override": "guard_spindle_override",
    "mean_shield_feed_override": "shield_feed_override",
    "mean_shield_spindle_override": "shield_spindle_override",
    "mean_abs_guard_feed_delta": "abs(guard_feed_override - raw_feed_override)",
    "mean_abs_guard_spindle_delta": "abs(guard_spindle_override - raw_spindle_override)",
    "mean_abs_shield_feed_delta": "abs(shield_feed_override - guard_feed_override)",
    "mean_abs_shield_spindle_delta": "abs(shield_spindle_override - guard_spindle_override)",
    "mean_guard_candidate_risk": "guard_candidate_risk",
    "mean_guard_candidate_uncertainty": "guard_candidate_uncertainty",
    "mean_current_risk": "risk_now",
    "mean_current_uncertainty": "risk_uncertainty",
}


def diagnostics_sql(name: str, by: str) -> str:
    means = ", ".join(f"coalesce(avg({e}), 0e0) AS {n}" for n, e in _MEANS_SQL.items())
    return f"""
{name} AS (SELECT {by}, count(*) AS steps, sum(guard_fallback) AS guard_fallbacks, avg(guard_fallback) AS guard_fallback_fraction,
    sum(shield_rejected) AS shield_rejections, avg(shield_rejected) AS shield_rejection_fraction, {means} FROM tr GROUP BY {by})"""


_DIAG_REAL = "guard_fallback_fraction shield_rejection_fraction " + " ".join(_MEANS_SQL)


@query(
    "a6_trace_diagnostics",
    f"WITH {TRACE_SQL}, {diagnostics_sql('dg', 'controller, scenario')}"
    f" SELECT {pick('controller scenario', _DIAG_REAL, 'steps guard_fallbacks shield_rejections')} FROM dg",
)
def a6(spark: SparkSession, folder: str) -> DataFrame:
    return runs.trace_diagnostics(trace(spark, folder), ("controller", "scenario"))


_POOL = ", ".join(f"avg({n}) AS {n}" for n in _MEANS_SQL)


@query(
    "a6_pooled_diagnostics",
    f"""WITH {TRACE_SQL}, {diagnostics_sql('dg', ', '.join(SEED_KEYS))},
    po AS (SELECT training_algorithm, controller, scenario, count(DISTINCT seed) AS seeds, sum(steps) AS steps,
      sum(guard_fallbacks) AS guard_fallbacks, sum(shield_rejections) AS shield_rejections, {_POOL},
      sum(guard_fallbacks) / sum(steps)::DOUBLE AS guard_fallback_fraction,
      sum(shield_rejections) / sum(steps)::DOUBLE AS shield_rejection_fraction
      FROM dg GROUP BY training_algorithm, controller, scenario)
    SELECT {pick('training_algorithm controller scenario', _DIAG_REAL, 'seeds steps guard_fallbacks shield_rejections')} FROM po""",
)
def a6_pooled(spark: SparkSession, folder: str) -> DataFrame:
    return runs.pooled_diagnostics(runs.trace_diagnostics(trace(spark, folder), SEED_KEYS))


def reasons_sql(name: str, by: str, column: str) -> str:
    return f"""
{name}0 AS (SELECT {by}, unnest(string_split(CASE WHEN {column} = '' THEN '~' ELSE {column} END, ';')) AS r FROM tr),
{name}1 AS (SELECT {by}, r, count(*) AS n FROM {name}0 GROUP BY {by}, r),
{name} AS (SELECT {by}, coalesce(string_agg(r || ':' || n, ';' ORDER BY r) FILTER (r <> '~'), '') AS reason_counts FROM {name}1 GROUP BY {by})"""


@query(
    "a7_reason_counts",
    f"WITH {TRACE_SQL}, {reasons_sql('rc', 'controller, scenario', 'guard_reasons')} SELECT controller, scenario, reason_counts FROM rc",
)
def a7(spark: SparkSession, folder: str) -> DataFrame:
    return runs.reason_counts(trace(spark, folder), F.col("guard_reasons"), ("controller", "scenario"))


@query(
    "a7_merged_reason_counts",
    f"WITH {TRACE_SQL}, {reasons_sql('rc', 'controller', 'guard_reasons')} SELECT controller, reason_counts FROM rc",
)
def a7_merged(spark: SparkSession, folder: str) -> DataFrame:
    per_seed = runs.reason_counts(trace(spark, folder), F.col("guard_reasons"), ("controller", "scenario", "seed"))
    return runs.merge_reason_counts(per_seed, "reason_counts", ("controller",))


@query(
    "j9_pareto",
    f"""WITH {TRACE_SQL}, {EPM_SQL}, p AS (SELECT scenario, {_EP.replace('scenario, ', '')}, round(mean_risk, 9) AS r, round(relative_mrr_proxy, 9) AS m FROM epm)
    SELECT scenario, episode, training_algorithm, controller, seed, NOT EXISTS (SELECT 1 FROM p q WHERE q.scenario = p.scenario AND q.r <= p.r AND q.m >= p.m
      AND (q.r < p.r OR q.m > p.m)) AS pareto_efficient FROM p""",
)
def j9(spark: SparkSession, folder: str) -> DataFrame:
    rows = episodes(spark, folder).select(
        *EP_KEYS, F.round("mean_risk", 9).alias("r"), F.round("relative_mrr_proxy", 9).alias("m")
    )
    return runs.pareto_front(rows, ["scenario"], "r", "m").drop("r", "m")


def profiled(df: DataFrame) -> DataFrame:
    """Run tables tagged by profile: the seeds stand for the profiles."""
    return df.withColumn("profile", F.concat(F.lit("p"), F.col("seed").cast("string")))


_PROFILE_AGG = ", ".join(f"avg({m}) AS {m}_mean" for m in runs.SEED_MEASURES)
PROFILE_SQL = f"""
pf AS (SELECT 'p' || seed AS profile, training_algorithm, controller, scenario, {_PROFILE_AGG},
    sum(shield_rejections) AS shield_rejections_sum FROM ss GROUP BY ALL),
pd AS (SELECT 'p' || seed AS profile, training_algorithm, controller, scenario, sum(guard_fallback) AS guard_fallbacks, count(*) AS steps,
    avg(raw_feed_override) AS mean_raw_feed_override, avg(shield_feed_override) AS mean_shield_feed_override,
    avg(raw_spindle_override) AS mean_raw_spindle_override, avg(shield_spindle_override) AS mean_shield_spindle_override FROM tr GROUP BY ALL)"""


def profile_summary(spark: SparkSession, folder: str) -> DataFrame:
    keys = ("profile", "training_algorithm", "controller", "scenario")
    return runs.seed_aggregate(profiled(seed_summaries(spark, folder)), keys)


def profile_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    return runs.trace_diagnostics(
        profiled(trace(spark, folder)), ("profile", "training_algorithm", "controller", "scenario")
    )


@query(
    "j6_delta_vs_baseline",
    f"""WITH {TRACE_SQL}, {EPM_SQL}, {SEED_SQL}, {PROFILE_SQL},
    d AS (SELECT a.profile, 'p0' AS baseline_profile, a.training_algorithm, a.controller, a.scenario, a.mean_risk_mean - b.mean_risk_mean AS delta_mean_risk,
      a.relative_mrr_proxy_mean - b.relative_mrr_proxy_mean AS delta_relative_mrr_proxy,
      a.mean_total_reward_mean - b.mean_total_reward_mean AS delta_mean_reward,
      CAST(a.shield_rejections_sum - b.shield_rejections_sum AS DOUBLE) AS delta_shield_rejections
      FROM pf a JOIN pf b USING (training_algorithm, controller, scenario) WHERE b.profile = 'p0' AND a.profile <> 'p0')
    SELECT {pick('profile baseline_profile training_algorithm controller scenario',
                 'delta_mean_risk delta_relative_mrr_proxy delta_mean_reward delta_shield_rejections')} FROM d""",
)
def j6(spark: SparkSession, folder: str) -> DataFrame:
    return runs.delta_vs_baseline(profile_summary(spark, folder), "p0")


CAND_SQL = f"""
cs AS (SELECT profile, training_algorithm, controller, string_agg(scenario, ',' ORDER BY scenario) AS scenarios, count(*) AS scenario_count,
    avg(mean_risk_mean) AS mean_risk_avg, max(mean_risk_mean) AS mean_risk_worst,
    coalesce(avg(mean_risk_mean) FILTER (scenario = 'unstable'), 0e0) AS unstable_risk,
    coalesce(avg(mean_risk_mean) FILTER (scenario = 'near_boundary'), 0e0) AS near_boundary_risk,
    avg(relative_mrr_proxy_mean) AS relative_mrr_avg, min(relative_mrr_proxy_mean) AS relative_mrr_min,
    coalesce(avg(relative_mrr_proxy_mean) FILTER (scenario = 'unstable'), 0e0) AS unstable_relative_mrr,
    avg(mean_total_reward_mean) AS mean_reward_avg, sum(shield_rejections_sum) AS shield_rejections_sum
  FROM pf WHERE controller = training_algorithm GROUP BY profile, training_algorithm, controller),
cd AS (SELECT profile, training_algorithm, controller, sum(guard_fallbacks) AS guard_fallbacks_sum, avg(mean_raw_feed_override) AS mean_raw_feed_override,
    avg(mean_shield_feed_override) AS mean_shield_feed_override, avg(mean_raw_spindle_override) AS mean_raw_spindle_override,
    avg(mean_shield_spindle_override) AS mean_shield_spindle_override FROM pd GROUP BY profile, training_algorithm, controller),
cc AS (SELECT cs.*, cd.* EXCLUDE (profile, training_algorithm, controller) FROM cs LEFT JOIN cd USING (profile, training_algorithm, controller)),
cf AS (SELECT *, CAST(NOT EXISTS (SELECT 1 FROM cc q WHERE round(q.mean_risk_avg, 9) <= round(p.mean_risk_avg, 9)
      AND round(q.relative_mrr_avg, 9) >= round(p.relative_mrr_avg, 9) AND q.shield_rejections_sum <= p.shield_rejections_sum
      AND (round(q.mean_risk_avg, 9) < round(p.mean_risk_avg, 9) OR round(q.relative_mrr_avg, 9) > round(p.relative_mrr_avg, 9)
        OR q.shield_rejections_sum < p.shield_rejections_sum)) AS BOOLEAN) AS is_pareto_frontier FROM cc p)"""


@query(
    "a27_candidate_summary",
    f"WITH {TRACE_SQL}, {EPM_SQL}, {SEED_SQL}, {PROFILE_SQL}, {CAND_SQL} SELECT "
    + pick(
        "profile training_algorithm controller scenarios is_pareto_frontier",
        "mean_risk_avg mean_risk_worst unstable_risk near_boundary_risk relative_mrr_avg relative_mrr_min unstable_relative_mrr"
        " mean_reward_avg mean_raw_feed_override mean_shield_feed_override mean_raw_spindle_override mean_shield_spindle_override",
        "scenario_count shield_rejections_sum guard_fallbacks_sum",
    )
    + " FROM cf",
)
def a27(spark: SparkSession, folder: str) -> DataFrame:
    summary = profile_summary(spark, folder)
    learned = summary.where(F.col("controller") == F.col("training_algorithm"))
    found = runs.candidate_summary(learned, profile_diagnostics(spark, folder))
    found = found.withColumns({"_r": F.round("mean_risk_avg", 9), "_m": F.round("relative_mrr_avg", 9)})
    front = runs.pareto_front3(
        found, ["profile", "training_algorithm", "controller"], "_r", "_m", "shield_rejections_sum", name="is_pareto_frontier"
    )
    return front.drop("_r", "_m")


@query(
    "j9_pareto_three_way",
    f"""WITH {TRACE_SQL}, {EPM_SQL}, p AS (SELECT {_EP}, round(mean_risk, 9) AS r, round(relative_mrr_proxy, 9) AS m, steps - severe_steps AS c FROM epm),
    u AS (SELECT DISTINCT r, m, c FROM p),
    f AS (SELECT *, NOT EXISTS (SELECT 1 FROM u q WHERE q.r <= u.r AND q.m >= u.m AND q.c <= u.c AND (q.r < u.r OR q.m > u.m OR q.c < u.c)) AS pareto_efficient FROM u)
    SELECT {_EP}, pareto_efficient FROM p JOIN f USING (r, m, c)""",
)
def j9_three(spark: SparkSession, folder: str) -> DataFrame:
    rows = episodes(spark, folder).select(
        *EP_KEYS,
        F.round("mean_risk", 9).alias("r"),
        F.round("relative_mrr_proxy", 9).alias("m"),
        (F.col("steps") - F.col("severe_steps")).alias("c"),
    )
    return runs.pareto_front3(rows, list(EP_KEYS), "r", "m", "c").drop("r", "m", "c")


@query(
    "j7_profile_rows",
    f"""WITH {TRACE_SQL}, {EPM_SQL}, {SEED_SQL}, {PROFILE_SQL}, r AS (SELECT DISTINCT profile FROM pf UNION SELECT 'p9')
    SELECT r.profile, coalesce(string_agg(DISTINCT pf.training_algorithm, ',' ORDER BY pf.training_algorithm), '') AS algorithms,
      count(pf.profile) AS summary_rows, count(*) FILTER (pf.controller = pf.training_algorithm) AS learned_rows,
      coalesce((SELECT count(*) FROM pd WHERE pd.profile = r.profile), 0) AS action_diagnostic_rows
    FROM r LEFT JOIN pf ON pf.profile = r.profile GROUP BY r.profile""",
)
def j7(spark: SparkSession, folder: str) -> DataFrame:
    summary = profile_summary(spark, folder)
    wanted = profiled(trace(spark, folder)).select("profile").distinct()
    wanted = wanted.unionByName(spark.range(1).select(F.lit("p9").alias("profile")))
    return runs.profile_rows(wanted, summary, profile_diagnostics(spark, folder))


POLICY_SQL = f"""
ps AS (SELECT training_algorithm, seed, avg(mean_risk) AS mean_risk_avg, max(mean_risk) AS worst_scenario_risk, max(max_risk) AS max_window_risk,
    coalesce(avg(mean_risk) FILTER (scenario = 'unstable'), 0e0) AS unstable_risk,
    coalesce(avg(mean_risk) FILTER (scenario = 'near_boundary'), 0e0) AS near_boundary_risk,
    avg(relative_mrr_proxy) AS relative_mrr_avg, min(relative_mrr_proxy) AS relative_mrr_min,
    coalesce(avg(relative_mrr_proxy) FILTER (scenario = 'unstable'), 0e0) AS unstable_relative_mrr, sum(shield_rejections) AS shield_rejections
  FROM ss GROUP BY training_algorithm, seed),
pg AS (SELECT training_algorithm, seed, sum(guard_fallback) AS guard_fallbacks, sum(guard_fallback) / count(*)::DOUBLE AS guard_fallback_fraction FROM tr GROUP BY 1, 2),
pp AS (SELECT *, greatest(0e0, 1e0 - relative_mrr_min) AS mrr_shortfall FROM ps JOIN pg USING (training_algorithm, seed)),
pz AS (SELECT *, mean_risk_avg + 0.5e0 * worst_scenario_risk + 0.5e0 * unstable_risk + 3e0 * mrr_shortfall
    + 0.15e0 * guard_fallback_fraction + 10e0 * shield_rejections - 0.05e0 * relative_mrr_avg AS selection_score FROM pp)"""


def scored_policies(spark: SparkSession, folder: str) -> DataFrame:
    keys = ("training_algorithm", "seed")
    diagnostics = runs.trace_diagnostics(trace(spark, folder), SEED_KEYS)
    return runs.policy_score(seed_summaries(spark, folder), diagnostics, keys)


@query(
    "a28_policy_score",
    f"WITH {TRACE_SQL}, {EPM_SQL}, {SEED_SQL}, {POLICY_SQL} SELECT "
    + pick(
        "training_algorithm seed",
        "mean_risk_avg worst_scenario_risk max_window_risk unstable_risk near_boundary_risk relative_mrr_avg relative_mrr_min"
        " unstable_relative_mrr guard_fallback_fraction mrr_shortfall selection_score",
        "shield_rejections guard_fallbacks",
    )
    + " FROM pz",
)
def a28(spark: SparkSession, folder: str) -> DataFrame:
    return scored_policies(spark, folder)


@query(
    "t3_policy_ranking",
    f"""WITH {TRACE_SQL}, {EPM_SQL}, {SEED_SQL}, {POLICY_SQL}
    SELECT training_algorithm, seed, round(selection_score, 6) AS selection_score,
      seed = (SELECT seed FROM pz ORDER BY selection_score, seed LIMIT 1) AS selected FROM pz""",
)
def t3(spark: SparkSession, folder: str) -> DataFrame:
    return runs.rank_policies(scored_policies(spark, folder)).select(
        "training_algorithm", "seed", "selection_score", "selected"
    )


@query(
    "a30_controller_rollup",
    f"""WITH {TRACE_SQL}, {EPM_SQL}, {SUM_SQL}, c AS (SELECT controller, count(*) AS scenario_count, avg(mean_risk) AS mean_risk_avg,
      max(mean_risk) AS mean_risk_worst, avg(relative_mrr_proxy) AS relative_mrr_avg, sum(shield_rejections) AS shield_rejections_sum FROM sm GROUP BY controller)
    SELECT {pick('controller', 'mean_risk_avg mean_risk_worst relative_mrr_avg', 'scenario_count shield_rejections_sum')},
      controller = (SELECT arg_min(controller, mean_risk_avg) FROM c) AS best_by_risk FROM c""",
)
def a30(spark: SparkSession, folder: str) -> DataFrame:
    return runs.controller_rollup(runs.summary_metrics(episodes(spark, folder)))


_MOVED = (
    "(abs(shield_feed_override - previous_feed_override) > 1e-9"
    " OR abs(shield_spindle_override - previous_spindle_override) > 1e-9)"
)


def replay_sql(name: str, by: str, grouping: str) -> str:
    return f"""
{name} AS (SELECT {by}, count(*) AS recommendation_windows, count(DISTINCT (scenario, episode)) AS episodes, count(*) FILTER ({_MOVED}) AS action_windows,
    sum(guard_fallback) AS guard_fallbacks, sum(shield_rejected) AS shield_rejections, max(risk_now) AS max_risk, avg(risk_now) AS mean_risk,
    avg(risk_horizon) AS mean_horizon_risk, avg(shield_feed_override) AS mean_feed_override, avg(shield_spindle_override) AS mean_spindle_override,
    avg(shield_feed_override * shield_spindle_override) AS relative_mrr_proxy, count(*) FILTER ({_MOVED}) / count(*)::DOUBLE AS action_fraction,
    sum(guard_fallback) / count(*)::DOUBLE AS guard_fallback_fraction FROM tr GROUP BY {grouping})"""


@query(
    "a19_replay_summary",
    f"WITH {TRACE_SQL}, {replay_sql('rp', 'scenario', 'GROUPING SETS ((scenario), ())')} SELECT "
    + pick(
        "scenario",
        "max_risk mean_risk mean_horizon_risk mean_feed_override mean_spindle_override relative_mrr_proxy action_fraction guard_fallback_fraction",
        "recommendation_windows episodes action_windows guard_fallbacks shield_rejections",
    )
    + " FROM rp",
)
def a19(spark: SparkSession, folder: str) -> DataFrame:
    return shadow.replay_summary(trace_to_recommendations(trace(spark, folder), "nightly", "model"))


# ---- gates: every (algorithm, controller, seed) is one gated run ----------------------------------------------

GATE_SQL = f"""
gm AS (SELECT training_algorithm || '/' || controller || '/' || seed AS run, count(*) AS recommendation_windows, avg(risk_now) * 0.9e0 AS mean_risk, max(risk_now) * 0.9e0 AS max_risk,
    avg(risk_now * 0.9e0) FILTER (scenario = 'unstable' AND seed <> 3) AS unstable_mean_risk, 1.15e0 * avg(shield_feed_override * shield_spindle_override) AS relative_mrr_proxy,
    avg(guard_fallback) AS guard_fallback_fraction, 0.7e0 * count(*) FILTER ({_MOVED}) / count(*)::DOUBLE AS action_fraction,
    sum(CASE WHEN seed = 0 THEN shield_rejected ELSE 0 END) AS shield_rejections,
    CASE WHEN max(seed) = 4 THEN 'live' ELSE 'shadow_only' END AS mode, CASE WHEN max(seed) = 2 THEN NULL ELSE FALSE END AS cnc_writes_enabled,
    CASE WHEN max(seed) = 1 THEN TRUE END AS real_machine_data, max(seed) = 1 AS operator_approval, FALSE AS hardware_interlock
  FROM tr GROUP BY 1)"""


def gate_metrics(spark: SparkSession, folder: str) -> DataFrame:
    recs = trace(spark, folder)
    moved = (F.abs(F.col("shield_feed_override") - F.col("previous_feed_override")) > 1e-9) | (
        F.abs(F.col("shield_spindle_override") - F.col("previous_spindle_override")) > 1e-9
    )
    run = F.concat_ws("/", "training_algorithm", "controller", F.col("seed").cast("string"))
    odd = (F.col("scenario") == "unstable") & (F.col("seed") != 3)
    return recs.groupBy(run.alias("run")).agg(
        F.count(F.lit(1)).alias("recommendation_windows"),
        (F.avg("risk_now") * 0.9).alias("mean_risk"),
        (F.max("risk_now") * 0.9).alias("max_risk"),
        F.avg(F.when(odd, F.col("risk_now") * 0.9)).alias("unstable_mean_risk"),
        (1.15 * F.avg(F.col("shield_feed_override") * F.col("shield_spindle_override"))).alias("relative_mrr_proxy"),
        F.avg(F.col("guard_fallback").cast("double")).alias("guard_fallback_fraction"),
        (0.7 * F.avg(moved.cast("double"))).alias("action_fraction"),
        F.sum(F.when(F.col("seed") == 0, F.col("shield_rejected")).otherwise(0)).alias("shield_rejections"),
        F.when(F.max("seed") == 4, "live").otherwise("shadow_only").alias("mode"),
        F.when(F.max("seed") == 2, F.lit(None)).otherwise(F.lit(False)).cast("boolean").alias("cnc_writes_enabled"),
        F.when(F.max("seed") == 1, F.lit(True)).alias("real_machine_data"),
        (F.max("seed") == 1).alias("operator_approval"),
        F.lit(False).alias("hardware_interlock"),
    )


def _checks_sql() -> str:
    parts = []
    for profile in gates.PROFILES:
        limits = gates.profile_values(profile)
        for name, column, how, limit in gates.NUMERIC_CHECKS:
            parts.append(
                f"SELECT run, '{profile}' AS profile, '{name}' AS \"check\", coalesce({column} {how} {float(limits[limit])!r}::DOUBLE, FALSE) AS passed FROM gm"
            )
        flags = [
            ("deployment_mode_shadow_only", "mode = 'shadow_only'"),
            ("cnc_writes_disabled", "NOT coalesce(cnc_writes_enabled, TRUE)"),
        ]
        if limits["needs_machine_evidence"]:
            flags += [
                ("real_machine_data", "coalesce(real_machine_data, FALSE)"),
                ("operator_approval_evidence", "coalesce(operator_approval, FALSE)"),
            ]
        if limits["needs_interlock"]:
            flags.append(("hardware_interlock_evidence", "coalesce(hardware_interlock, FALSE)"))
        parts += [f"SELECT run, '{profile}', '{name}', {test} FROM gm" for name, test in flags]
    return "ck AS (" + " UNION ALL ".join(parts) + ")"


_CHECKS_SQL = f"WITH {TRACE_SQL}, {GATE_SQL}, {_checks_sql()}"
DECIDE_SQL = """gd AS (SELECT run, profile, bool_and(passed) AS passed, coalesce(string_agg("check", ';' ORDER BY "check") FILTER (NOT passed), '') AS failed_checks
  FROM ck GROUP BY run, profile)"""


@query("a31_gate_checks", f'{_CHECKS_SQL} SELECT run, profile, "check", passed FROM ck')
def a31(spark: SparkSession, folder: str) -> DataFrame:
    return gates.gate_checks(gate_metrics(spark, folder)).select("run", "profile", "check", "passed")


@query(
    "a31_gate_decisions",
    f"""{_CHECKS_SQL}, {DECIDE_SQL} SELECT run, profile, passed, failed_checks, CASE WHEN passed THEN 'pass' ELSE 'blocked' END AS status,
      CASE WHEN NOT passed THEN 'do_not_promote' WHEN profile = 'hardware_actuation' THEN 'hardware_actuation_review_candidate'
        ELSE profile || '_candidate' END AS promotion_level, FALSE AS hardware_actuation_allowed FROM gd""",
)
def a31_decisions(spark: SparkSession, folder: str) -> DataFrame:
    decided = gates.gate_decisions(gates.gate_checks(gate_metrics(spark, folder)))
    return decided.withColumn("failed_checks", F.array_join("failed_checks", ";"))


@query(
    "a32_readiness",
    f"""{_CHECKS_SQL}, {DECIDE_SQL}, w AS (SELECT run, {', '.join(f"max(CASE WHEN profile = '{p}' THEN CASE WHEN passed THEN 'pass' ELSE 'blocked' END END) AS {p}" for p in gates.PROFILES)} FROM gd GROUP BY run)
    SELECT *, CASE WHEN shadow_review = 'pass' AND live_shadow = 'blocked' AND hardware_actuation = 'blocked' THEN 'good_internal_demo_complete'
      ELSE 'needs_attention' END AS readiness FROM w""",
)
def a32(spark: SparkSession, folder: str) -> DataFrame:
    return gates.readiness(gates.gate_decisions(gates.gate_checks(gate_metrics(spark, folder))))


# ---- set operations -------------------------------------------------------------------------------------------


@query(
    "u2_tagged_union",
    f"""WITH {TRACE_SQL}, {EPM_SQL}, {SEED_SQL}, {AGG_SQL}
    SELECT 'seeds' AS source, controller, scenario, round(mean_risk, 6) AS mean_risk, NULL::DOUBLE AS mean_risk_std FROM ss
    UNION ALL SELECT 'pooled', controller, scenario, round(mean_risk_mean, 6), round(mean_risk_std, 6) + 0.0 FROM ag""",
)
def u2(spark: SparkSession, folder: str) -> DataFrame:
    seeds = seed_summaries(spark, folder)
    pooled = runs.seed_aggregate(seeds).select(
        F.lit("pooled").alias("source"),
        "controller",
        "scenario",
        F.col("mean_risk_mean").alias("mean_risk"),
        "mean_risk_std",
    )
    return seeds.select(F.lit("seeds").alias("source"), "controller", "scenario", "mean_risk").unionByName(
        pooled, allowMissingColumns=True
    )


@query(
    "u3_learned_and_baseline",
    f"""WITH {TRACE_SQL}, {EPM_SQL}, {SUM_SQL} SELECT controller, scenario, round(mean_risk, 6) AS mean_risk, controller <> 'fixed' AS learned FROM sm""",
)
def u3(spark: SparkSession, folder: str) -> DataFrame:
    summary = runs.summary_metrics(episodes(spark, folder)).select("controller", "scenario", "mean_risk")
    learned = summary.where(F.col("controller") != "fixed").withColumn("learned", F.lit(True))
    return learned.unionByName(summary.where(F.col("controller") == "fixed").withColumn("learned", F.lit(False)))


