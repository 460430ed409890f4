"""Waveform, stability-margin and generation queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindleflow.functions import signal as sig
from spindleflow.functions.physics import Cut, Modal, Tool, stability
from spindleflow.functions.risk import RiskInputs, risk_struct
from spindleflow.operators import generate, shadow, slicing
from spindleflow.operators import sequence as seq
from spindleflow.operators.scan import with_position
from spindleflow.plans.catalog import pick, query, read
from spindleflow.plans.inputs import HORIZON_S, HZ_SQL, LAYOUT, TRACE_SQL, WIN_SQL, trace, windows

_SIZE, _HOP = 8, 4
SLICE_SQL = f"""
sm AS (SELECT scenario, episode, row_number() OVER (PARTITION BY scenario, episode ORDER BY start_time_s, window_id) - 1 AS i, start_time_s AS t, rms, k FROM win),
sw AS (SELECT scenario, episode, unnest(range(CAST(greatest(0, ceil((i - {_SIZE - 1}) / {_HOP}.0)) AS BIGINT), i // {_HOP} + 1)) AS w, t, rms, k FROM sm),
sl AS (SELECT scenario, episode, w, count(*) AS n, min(t) AS start_time_s, max(t) AS end_time_s, avg(rms) AS m, avg(k) AS mean_k,
    sum(rms) AS total FROM sw GROUP BY scenario, episode, w HAVING count(*) = {_SIZE})"""


def sample_windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = windows(spark, folder)
    samples = with_position(rows, ["scenario", "episode"], LAYOUT.chunk(), LAYOUT.order, "_p").select(
        "scenario",
        "episode",
        (F.col("_p") - 1).alias("sample_idx"),
        F.col("start_time_s").alias("time_s"),
        F.array("rms").alias("ch"),
        "k",
    )
    return slicing.slice_samples(samples.withColumnRenamed("k", "mean_k"), _SIZE, _HOP, mean=("mean_k",))


@query(
    "w1_slice_samples",
    f"""WITH {WIN_SQL}, {SLICE_SQL} SELECT scenario, episode, CAST(w AS BIGINT) AS window_index_in_episode, CAST(n AS BIGINT) AS samples,
      round(start_time_s, 6) AS start_time_s, round(end_time_s, 6) AS end_time_s, round(total, 6) AS total FROM sl""",
)
def w1(spark: SparkSession, folder: str) -> DataFrame:
    cut = sample_windows(spark, folder)
    return cut.select(
        "scenario",
        "episode",
        "window_index_in_episode",
        F.size("sensor_window").alias("samples"),
        "start_time_s",
        "end_time_s",
        sig.total(F.flatten("sensor_window")).alias("total"),
    )


@query(
    "w1_slice_arrays",
    """WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS x, unnest(range(0, 49, 8)) AS st FROM embeddings)
    SELECT vec_id, st // 8 AS window_index_in_episode, st / 100e0 AS start_time_s, (st + 15) / 100e0 AS end_time_s, round(list_sum(x[st + 1 : st + 16]), 6) + 0.0 AS total FROM s""",
)
def w1_arrays(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    cut = slicing.slice_arrays(rows, "x", F.lit(100.0), 0.16, 0.08)
    return cut.select(
        "vec_id", "window_index_in_episode", "start_time_s", "end_time_s", sig.total(F.col("sensor_window")).alias("total")
    )


@query(
    "w12_effective_context",
    f"""WITH {WIN_SQL}, {SLICE_SQL}, e AS (SELECT scenario, episode, w, 0.0006e0 * (0.5e0 + mean_k / 97e0) AS ap, 7e8 * (1e0 + mean_k / 193e0) AS kt FROM sl)
    SELECT scenario, episode, CAST(w AS BIGINT) AS window_index_in_episode, round(ap / 0.0006e0, 6) AS axial_depth_profile_scale, round(kt / 7e8, 6) AS cutting_coeff_profile_scale FROM e""",
)
def w12(spark: SparkSession, folder: str) -> DataFrame:
    cut = sample_windows(spark, folder).withColumns(
        {
            "axial_depth_m": 0.0006 * (0.5 + F.col("mean_k") / 97.0),
            "cutting_coeff_t_n_m2": 7e8 * (1.0 + F.col("mean_k") / 193.0),
        }
    )
    scaled = slicing.effective_cut(cut, {"axial_depth_m": 0.0006, "cutting_coeff_t_n_m2": 7e8})
    return scaled.select(
        "scenario", "episode", "window_index_in_episode", "axial_depth_profile_scale", "cutting_coeff_profile_scale"
    )


# Waveforms: the vector itself repeated four times with growing weight, 256 samples at 1 kHz.
def waveforms(spark: SparkSession, folder: str) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    return read(spark, folder, "embeddings").select(
        "vec_id",
        F.concat(*[_scaled(x, gain) for gain in (1.0, 1.3, 0.7, 1.9)]).alias("x"),
        (900.0 + 73.3 * F.col("label")).alias("rpm"),
        F.when(F.col("vec_id") % 2 == 1, 180.3).alias("modal"),
    )


def _scaled(x, gain: float):
    return F.transform(x, lambda v: v * gain)


WAVE_SQL = """
wv AS (SELECT vec_id, list_concat(list_concat(embedding::DOUBLE[], list_transform(embedding::DOUBLE[], lambda v: v * 1.3e0)),
    list_concat(list_transform(embedding::DOUBLE[], lambda v: v * 0.7e0), list_transform(embedding::DOUBLE[], lambda v: v * 1.9e0))) AS raw,
    900e0 + 73.3e0 * label AS rpm, CASE WHEN vec_id % 2 = 1 THEN 180.3e0 END AS modal FROM embeddings),
ws AS (SELECT vec_id, rpm, modal, unnest(raw) AS v, unnest(range(256)) AS i FROM wv),
wc AS (SELECT vec_id, rpm, modal, i, v - avg(v) OVER (PARTITION BY vec_id) AS x FROM ws)"""


@query(
    "a1_time_features",
    f"""WITH {WAVE_SQL}, f AS (SELECT vec_id, sqrt(avg(x * x)) AS rms, max(abs(x)) AS peak, max(abs(x)) / greatest(sqrt(avg(x * x)), 1e-12) AS crest_factor,
      kurtosis(x) + 3e0 AS kurtosis FROM wc GROUP BY vec_id) SELECT {pick('vec_id', 'rms peak crest_factor kurtosis')} FROM f""",
)
def a1(spark: SparkSession, folder: str) -> DataFrame:
    rows = waveforms(spark, folder).withColumn("f", sig.time_features(sig.centred(F.col("x"))))
    return rows.select("vec_id", "f.*")


_PI = repr(math.pi)
SPECTRUM_SQL = f"""
sg AS (SELECT range AS s FROM range(3)),
sx AS (SELECT vec_id, s, i - 64 * s AS j, x FROM wc JOIN sg ON i >= 64 * s AND i < 64 * s + 128),
sd AS (SELECT vec_id, s, j, (x - avg(x) OVER (PARTITION BY vec_id, s)) * (0.5e0 - 0.5e0 * cos(2e0 * {_PI} * j / 128e0)) AS y FROM sx),
tw AS (SELECT b.range AS k, j.range AS j, cos(2e0 * {_PI} * ((b.range * j.range) % 128) / 128e0) AS c, sin(2e0 * {_PI} * ((b.range * j.range) % 128) / 128e0) AS s2 FROM range(65) b CROSS JOIN range(128) j),
ft AS (SELECT vec_id, s, k, sum(y * c) AS re, sum(y * s2) AS im FROM sd JOIN tw USING (j) GROUP BY vec_id, s, k),
pw AS (SELECT vec_id, k, k * 1000e0 / 128e0 AS f, CASE WHEN k IN (0, 64) THEN 1e0 ELSE 2e0 END * avg(re * re + im * im) / (1000e0 * 48e0) AS p FROM ft GROUP BY vec_id, k),
pm AS (SELECT pw.*, rpm * 4 / 60e0 AS ft, modal FROM pw JOIN wv USING (vec_id)),
nb AS (SELECT *, list_bool_or(list_transform([1, 2, 3, 4, 5, 6], lambda h: h * ft < 500e0 AND abs(f - h * ft) <= greatest(5e0, 0.08e0 * ft))) AS near FROM pm),
mk AS (SELECT *, NOT near AND f >= CASE WHEN modal IS NULL THEN least(greatest(1.2e0 * ft, 20e0), 450e0) ELSE greatest(5e0, 0.75e0 * modal) END
    AND f <= CASE WHEN modal IS NULL THEN 450e0 ELSE least(480e0, 1.25e0 * modal) END AS chat FROM nb),
ta AS (SELECT vec_id, sum(0.5e0 * (p + pp) * (f - pf)) AS tooth FROM (SELECT vec_id, f, p, lag(f) OVER e AS pf, lag(p) OVER e AS pp FROM mk WHERE near WINDOW e AS (PARTITION BY vec_id ORDER BY k)) GROUP BY vec_id),
ca AS (SELECT vec_id, sum(0.5e0 * (p + pp) * (f - pf)) AS chatter FROM (SELECT vec_id, f, p, lag(f) OVER e AS pf, lag(p) OVER e AS pp FROM mk WHERE chat WINDOW e AS (PARTITION BY vec_id ORDER BY k)) GROUP BY vec_id),
al AS (SELECT vec_id, sum(0.5e0 * (p + pp) * (f - pf)) + 1e-18 AS total FROM (SELECT vec_id, f, p, lag(f) OVER e AS pf, lag(p) OVER e AS pp FROM mk WINDOW e AS (PARTITION BY vec_id ORDER BY k)) GROUP BY vec_id),
en AS (SELECT vec_id, -sum(q * log2(q + 1e-18)) / log2(65) AS spectral_entropy FROM (SELECT vec_id, p / (sum(p) OVER (PARTITION BY vec_id) + 1e-18) AS q FROM mk) GROUP BY vec_id),
dm AS (SELECT vec_id, arg_max(f, p) AS dominant_frequency_hz, any_value(ft) AS tooth_frequency_hz FROM mk GROUP BY vec_id),
sf AS (SELECT dm.*, coalesce(tooth, 0e0) AS tooth_band_energy, coalesce(chatter, 0e0) AS chatter_band_energy,
    greatest(total - coalesce(tooth, 0e0), 0e0) / greatest(coalesce(tooth, 0e0), 1e-18) AS non_tooth_harmonic_ratio, total AS total_energy, spectral_entropy
  FROM dm LEFT JOIN ta USING (vec_id) LEFT JOIN ca USING (vec_id) JOIN al USING (vec_id) JOIN en USING (vec_id))"""
_SPECTRAL = "tooth_frequency_hz tooth_band_energy chatter_band_energy non_tooth_harmonic_ratio dominant_frequency_hz spectral_entropy total_energy"


def wave_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = sig.with_series(waveforms(spark, folder), "s", sig.centred(F.col("x")))
    spectrum = sig.spectral_features("s", F.lit(1000.0), "rpm", F.lit(4), F.col("modal"))
    return rows.withColumns({"f": sig.time_features(F.col("s")), "p": spectrum})


@query("a2_spectral_features", f"WITH {WAVE_SQL}, {SPECTRUM_SQL} SELECT {pick('vec_id', _SPECTRAL)} FROM sf")
def a2(spark: SparkSession, folder: str) -> DataFrame:
    return wave_features(spark, folder).select("vec_id", "p.*")


@query(
    "a25_growth_target",
    f"""WITH {WAVE_SQL}, {SPECTRUM_SQL}, tf AS (SELECT vec_id, max(abs(x)) / greatest(sqrt(avg(x * x)), 1e-12) AS crest FROM wc GROUP BY vec_id),
    ht AS (SELECT vec_id, sqrt(avg(v * v) FILTER (i < 85)) AS head, sqrt(avg(v * v) FILTER (i >= 171)) AS tail FROM ws GROUP BY vec_id),
    g AS (SELECT vec_id, least(1e0, 0.55e0 / (1e0 + exp(-(log10(chatter_band_energy / greatest(tooth_band_energy, 1e-18) + 1e-12) + 0.4e0) * 2e0))
        + 0.25e0 / (1e0 + exp(-(crest - 4e0) / 1.5e0)) + 0.2e0 / (1e0 + exp(-(spectral_entropy - 0.55e0) * 6e0))) AS s,
        1e0 / (1e0 + exp(-(log10((tail + 1e-12) / (head + 1e-12)) + 0.05e0) * 3e0)) AS gr FROM sf JOIN tf USING (vec_id) JOIN ht USING (vec_id))
    SELECT vec_id, round(least(1e0, greatest(0e0, 0.65e0 * s + 0.35e0 * gr)), 6) AS risk FROM g""",
)
def a25(spark: SparkSession, folder: str) -> DataFrame:
    rows = wave_features(spark, folder)
    both = F.struct(
        F.col("p.chatter_band_energy"), F.col("p.tooth_band_energy"), F.col("f.crest_factor"), F.col("p.spectral_entropy")
    )
    return rows.select("vec_id", sig.growth_target(F.transform("x", lambda v: F.abs(v)), both).alias("risk"))


# An eight-sample window is one Welch segment of eight: five bins, periodic Hann, segment mean removed.
_WINDOW_RISK_SQL = f"""WITH {WIN_SQL}, sm AS (SELECT scenario, episode, row_number() OVER (PARTITION BY scenario, episode ORDER BY start_time_s, window_id) - 1 AS i, rms, k FROM win),
s0 AS (SELECT scenario, episode, unnest(range(CAST(greatest(0, ceil((i - {_SIZE - 1}) / {_HOP}.0)) AS BIGINT), i // {_HOP} + 1)) AS w, i, rms, k FROM sm),
s1 AS (SELECT *, i - w * {_HOP} AS j, count(*) OVER p AS n, avg(rms) OVER p AS m, avg(k) OVER p AS mk FROM s0 WINDOW p AS (PARTITION BY scenario, episode, w)),
s2 AS (SELECT scenario, episode, w, j, rms - m AS x, mk FROM s1 WHERE n = {_SIZE}),
tf AS (SELECT scenario, episode, w, any_value(mk) AS mk, sqrt(avg(x * x)) AS rms, max(abs(x)) / greatest(sqrt(avg(x * x)), 1e-12) AS crest FROM s2 GROUP BY ALL),
ft AS (SELECT scenario, episode, w, b.range AS b, sum(x * (0.5e0 - 0.5e0 * cos(2e0 * pi() * j / 8e0)) * cos(2e0 * pi() * b.range * j / 8e0)) AS re,
  sum(x * (0.5e0 - 0.5e0 * cos(2e0 * pi() * j / 8e0)) * sin(2e0 * pi() * b.range * j / 8e0)) AS im FROM s2 CROSS JOIN range(5) b GROUP BY ALL),
pw AS (SELECT ft.*, b * 12.5e0 AS f, CASE WHEN b IN (0, 4) THEN 1e0 ELSE 2e0 END * (re * re + im * im) / (100e0 * 3e0) AS p, (300e0 + mk) * 4 / 60e0 AS tooth FROM ft JOIN tf USING (scenario, episode, w)),
mk AS (SELECT *, list_bool_or(list_transform([1, 2, 3, 4, 5, 6], lambda h: h * tooth < 50e0 AND abs(f - h * tooth) <= greatest(5e0, 0.08e0 * tooth))) AS near FROM pw),
mb AS (SELECT *, NOT near AND f >= least(greatest(1.2e0 * tooth, 20e0), 45e0) AND f <= 45e0 AS chat FROM mk),
et AS (SELECT scenario, episode, w, sum(0.5e0 * (p + pp) * (f - pf)) AS e FROM (SELECT scenario, episode, w, f, p, lag(f) OVER o AS pf, lag(p) OVER o AS pp FROM mb WHERE near WINDOW o AS (PARTITION BY scenario, episode, w ORDER BY b)) GROUP BY ALL),
ec AS (SELECT scenario, episode, w, sum(0.5e0 * (p + pp) * (f - pf)) AS e FROM (SELECT scenario, episode, w, f, p, lag(f) OVER o AS pf, lag(p) OVER o AS pp FROM mb WHERE chat WINDOW o AS (PARTITION BY scenario, episode, w ORDER BY b)) GROUP BY ALL),
en AS (SELECT scenario, episode, w, -sum(q * log2(q + 1e-18)) / log2(5) AS h FROM (SELECT scenario, episode, w, p / (sum(p) OVER (PARTITION BY scenario, episode, w) + 1e-18) AS q FROM mb) GROUP BY ALL),
sg AS (SELECT tf.*, least(1e0, 0.55e0 / (1e0 + exp(-(log10(coalesce(ec.e, 0e0) / greatest(coalesce(et.e, 0e0), 1e-18) + 1e-12) + 0.4e0) * 2e0)) + 0.25e0 / (1e0 + exp(-(crest - 4e0) / 1.5e0))
  + 0.2e0 / (1e0 + exp(-(h - 0.55e0) * 6e0))) AS s FROM tf LEFT JOIN et USING (scenario, episode, w) LEFT JOIN ec USING (scenario, episode, w) JOIN en USING (scenario, episode, w)),
rk AS (SELECT *, least(1e0, greatest(0e0, 0.55e0 * 0.5e0 + 0.45e0 * s)) AS now FROM sg)
SELECT scenario, episode, CAST(w AS BIGINT) AS window_index_in_episode, round(rms, 6) AS rms, round(now, 6) AS risk_chatter_now,
  CASE WHEN now < 0.3e0 THEN 'stable' WHEN now < 0.55e0 THEN 'transition' WHEN now < 0.8e0 THEN 'slight' ELSE 'severe' END AS label FROM rk"""


@query("a2_window_risk", _WINDOW_RISK_SQL)
def window_risk(spark: SparkSession, folder: str) -> DataFrame:
    """Slice, featurise and score multi-channel windows end to end."""
    cut = sig.with_series(sample_windows(spark, folder), "s", sig.series_of_window(F.col("sensor_window")))
    cut = cut.withColumns(
        {
            "f": sig.time_features(F.col("s")),
            "p": sig.spectral_features("s", F.lit(100.0), 300.0 + F.col("mean_k"), F.lit(4), F.lit(None).cast("double")),
        }
    )
    risk = risk_struct(
        RiskInputs(
            F.col("p.chatter_band_energy"),
            F.col("p.tooth_band_energy"),
            F.col("f.crest_factor"),
            F.col("p.spectral_entropy"),
            F.lit(0.0),
            margin_uncertainty=1.0,
        )
    )
    return cut.withColumn("risk", risk).select(
        "scenario",
        "episode",
        "window_index_in_episode",
        F.col("f.rms").alias("rms"),
        F.col("risk.risk_chatter_now").alias("risk_chatter_now"),
        F.col("risk.label").alias("label"),
    )


# ---- generation -----------------------------------------------------------------------------------------------


@query(
    "w16_pick_candidate",
    f"""WITH {WIN_SQL}, {HZ_SQL}, g AS (SELECT scenario, episode // 4 % 9 AS grp, episode, count(*) FILTER (label = 'transition') AS transitions,
      10e0 * count(*) FILTER (future_chatter_within_horizon AND label NOT IN ('slight', 'severe')) + 5e0 * count(*) FILTER (label = 'transition')
      + sum(1e0 - least(abs(risk_chatter_now - 0.425e0) / 0.425e0, 1e0)) + 0.25e0 * sum(greatest(0e0, 1e0 - abs(margin_physics))) AS score FROM hz GROUP BY 1, 2, 3),
    p AS (SELECT scenario, grp, min(CASE WHEN transitions >= 17 THEN episode END) AS f FROM g GROUP BY 1, 2),
    b AS (SELECT scenario, grp, episode, row_number() OVER (PARTITION BY scenario, grp ORDER BY transitions DESC, round(score, 9) DESC, episode) AS r FROM g)
    SELECT p.scenario, p.grp, coalesce(p.f, b.episode) AS episode FROM p JOIN b ON p.scenario = b.scenario AND p.grp = b.grp AND b.r = 1""",
)
def w16(spark: SparkSession, folder: str) -> DataFrame:
    rows = seq.horizon_labels(windows(spark, folder), LAYOUT, HORIZON_S).withColumn(
        "grp", F.floor(F.col("episode") / 4) % 9
    )
    scored = generate.candidate_scores(rows, ("scenario", "grp"), "episode")
    return generate.pick_candidate(scored, ("scenario", "grp"), "episode", 17)


def _uniform_sql(seed: int, name: str, bounds: tuple[float, float], key: str) -> str:
    low, high = bounds
    return (
        f"{low!r}::DOUBLE + {high - low!r}::DOUBLE * (('0x' || substr(md5('{seed}|' || {key} || '|{name}'), 1, 8))::BIGINT / 4294967296e0)"
    )


_EPS_SQL = ", ".join(
    f"round({_uniform_sql(303, n, r, 'scenario || chr(124) || episode')}, 6) AS {n}" for n, r in generate.EPISODE_RANGES.items()
)


@query(
    "w17_episode_scales",
    f"WITH {WIN_SQL}, e AS (SELECT DISTINCT scenario, episode FROM win) SELECT scenario, episode, TRUE AS randomized, {_EPS_SQL} FROM e",
)
def w17(spark: SparkSession, folder: str) -> DataFrame:
    episodes = windows(spark, folder).select("scenario", "episode").distinct()
    return generate.episode_scales(episodes, 303, ("scenario", "episode"))


_FAM_SQL = ", ".join(f"round({_uniform_sql(7, n, r, 'family')}, 6) AS {n}" for n, r in generate.FAMILY_RANGES.items())


@query(
    "w18_calibration_grid",
    f"""WITH {WIN_SQL}, s AS (SELECT DISTINCT scenario FROM win), g AS (SELECT scenario, f.range AS family, unnest({list(generate.DEPTH_SCALES)}::DOUBLE[]) AS axial_depth_scale FROM s CROSS JOIN range(5) f),
    h AS (SELECT *, unnest({list(generate.SPINDLE_SCALES)}::DOUBLE[]) AS spindle_scale FROM g)
    SELECT scenario, CAST(family AS BIGINT) AS family, axial_depth_scale, spindle_scale, CASE WHEN family = 4 THEN 'holdout' ELSE 'train' END AS split, {_FAM_SQL} FROM h""",
)
def w18(spark: SparkSession, folder: str) -> DataFrame:
    return generate.calibration_grid(windows(spark, folder).select("scenario").distinct(), 5, 4, 7)


# ---- stability margins ----------------------------------------------------------------------------------------


def parts(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as cuts: speed from the size, depth from the price."""
    return read(spark, folder, "part").select(
        F.col("p_partkey").alias("window_id"),
        (6000.0 + 100.0 * F.col("p_size")).alias("spindle_rpm"),
        (F.col("p_retailprice") * 1e-7).alias("axial_depth_m"),
        (F.col("p_size") % 3 == 0).alias("shadow_warning"),
        (0.94 + (F.col("p_size") % 7) / 70.0).alias("last_feed_override"),
        (0.95 + (F.col("p_size") % 11) / 100.0).alias("last_spindle_override"),
        (F.col("p_size") / 50.0).alias("risk_chatter_now"),
        (0.2 + (F.col("p_size") % 13) / 40.0).alias("uncertainty"),
    )


_PHIS = [math.pi * i / 95 for i in range(96)]
_FX = sum(abs(-math.cos(p) + 0.3 * math.sin(p)) for p in _PHIS) / 96
_FY = sum(abs(math.sin(p) + 0.3 * math.cos(p)) for p in _PHIS) / 96
_DX, _DY = _FX / math.hypot(_FX, _FY), _FY / math.hypot(_FX, _FY)
_WX, _WY = math.sqrt(1.55e7 / 0.8) / (2 * math.pi), math.sqrt(1.25e7 / 0.8) / (2 * math.pi)

PARTS_SQL = """
pt AS (SELECT p_partkey AS window_id, 6000e0 + 100e0 * p_size AS rpm0, p_retailprice * 1e-7 AS ap, p_size % 3 = 0 AS shadow_warning,
    0.94e0 + (p_size % 7) / 70e0 AS last_feed_override, 0.95e0 + (p_size % 11) / 100e0 AS last_spindle_override,
    p_size / 50e0 AS risk_chatter_now, 0.2e0 + (p_size % 13) / 40e0 AS uncertainty FROM part)"""


def margin_sql(source: str, name: str = "mg") -> str:
    """Margin per distinct speed of ``source`` (column rpm): 240 frequencies by join and max."""
    return f"""
{name}r AS (SELECT DISTINCT rpm, rpm * 4 / 60e0 AS ft FROM {source}),
{name}b AS (SELECT *, greatest(5e0, {0.65 * min(_WX, _WY)!r}::DOUBLE, 0.6e0 * ft) AS lo FROM {name}r),
{name}c AS (SELECT *, greatest(lo + 1e0, {1.35 * max(_WX, _WY)!r}::DOUBLE, 1.4e0 * ft) AS hi FROM {name}b),
{name}f AS (SELECT rpm, ft, lo + (hi - lo) * i.range / 239e0 AS f FROM {name}c CROSS JOIN range(240) i),
{name}w AS (SELECT *, 4e0 * {_PI} * {_PI} * f * f AS w2 FROM {name}f),
{name}i AS (SELECT rpm, f, ({_DX!r}::DOUBLE / sqrt(power(1.55e7 - 0.8e0 * w2, 2) + 44100e0 * w2) + {_DY!r}::DOUBLE / sqrt(power(1.25e7 - 0.8e0 * w2, 2) + 36100e0 * w2))
    * least(2.2e0, greatest(0.2e0, 0.2e0 + 2e0 * abs(sin({_PI} * f / ft)))) AS idx FROM {name}w),
{name} AS (SELECT rpm, arg_max(f, idx) AS limiting_frequency_hz,
    greatest(1e-5, 0.5e0 / greatest(7e8 * ((0.5e0 + 0.4e0) * (0.65e0 + 0.5e0) * 1.075e0) * max(idx), 1e-18)) AS critical FROM {name}i GROUP BY rpm)"""


@query(
    "v1_margin_map",
    f"""WITH {PARTS_SQL}, sp AS (SELECT rpm0 AS rpm FROM pt), {margin_sql('sp')}
    SELECT window_id, round(critical * 1e3, 6) AS critical_mm, round((critical - ap) / critical, 6) + 0.0 AS signed_margin, round(limiting_frequency_hz, 6) AS limiting_frequency_hz
    FROM pt JOIN mg ON pt.rpm0 = mg.rpm""",
)
def v1(spark: SparkSession, folder: str) -> DataFrame:
    found = stability(Modal(), Tool(), Cut(spindle_rpm=F.col("spindle_rpm"), axial_depth_m=F.col("axial_depth_m")))
    return parts(spark, folder).withColumn("v", found).select(
        "window_id",
        (F.col("v.critical_axial_depth_m") * 1e3).alias("critical_mm"),
        F.col("v.signed_margin").alias("signed_margin"),
        F.col("v.limiting_frequency_hz").alias("limiting_frequency_hz"),
    )


def part_cut() -> Cut:
    return Cut(spindle_rpm=F.col("spindle_rpm"), axial_depth_m=F.col("axial_depth_m"))


@query(
    "v2_margin_policy",
    f"""WITH {PARTS_SQL}, o AS (SELECT pt.*, 0 AS i, 1e0 AS s FROM pt UNION ALL SELECT pt.*, r.range + 1, 0.9e0 + (1.1e0 - 0.9e0) / 20e0 * r.range FROM pt CROSS JOIN range(21) r WHERE shadow_warning),
    oz AS (SELECT *, rpm0 * s AS rpm FROM o), {margin_sql('oz')},
    m AS (SELECT oz.*, (critical - ap) / critical AS m FROM oz JOIN mg USING (rpm)),
    b AS (SELECT *, first_value(m) OVER (PARTITION BY window_id ORDER BY i) AS m0 FROM m),
    z AS (SELECT *, (m - m0) + 0.03e0 * s - 0.08e0 * abs(s - 1e0) AS score FROM b),
    x AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY score DESC, i) AS r FROM z),
    y AS (SELECT *, shadow_warning AND m - m0 >= 0.05e0 AND abs(s - 1e0) > 1e-12 AS act FROM x WHERE r = 1)
    SELECT window_id, act AS action_active, round(CASE WHEN act THEN s ELSE 1e0 END, 6) AS spindle_override, round(m0, 6) + 0.0 AS baseline_margin_physics,
      round(CASE WHEN act THEN m - m0 ELSE 0e0 END, 6) + 0.0 AS selected_margin_improvement, round(score, 6) + 0.0 AS selected_action_score FROM y""",
)
def v2(spark: SparkSession, folder: str) -> DataFrame:
    chosen = shadow.margin_policy(parts(spark, folder), "shadow_warning", Modal(), Tool(), part_cut())
    return chosen.select(
        "window_id", "action_active", "spindle_override", "baseline_margin_physics", "selected_margin_improvement", "selected_action_score"
    )


def _unsure(m: str) -> str:
    return f"least(0.95e0, 0.12e0 + 0.55e0 * exp(-abs({m}) / 0.22e0))"


@query(
    "v3_lobe_schedule",
    f"""WITH {PARTS_SQL}, o AS (SELECT pt.*, r.range AS i, greatest(0.9e0, last_spindle_override - 0.05e0) AS lo, least(1.1e0, last_spindle_override + 0.05e0) AS hi FROM pt CROSS JOIN range(17) r),
    oy AS (SELECT *, lo + (hi - lo) * i / 16e0 AS c FROM o), oz AS (SELECT *, rpm0 * c AS rpm FROM oy), {margin_sql('oz')},
    m AS (SELECT oz.*, (critical - ap) / critical AS m FROM oz JOIN mg USING (rpm)),
    u AS (SELECT *, {_unsure('m')} AS u FROM m),
    z AS (SELECT *, m - 0.8e0 * u - 0.05e0 * abs(c - last_spindle_override) - 0.01e0 * abs(c - 1e0) AS score, u <= 0.65e0 OR c = last_spindle_override AS ok FROM u),
    x AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY ok DESC, score DESC, i) AS r FROM z)
    SELECT window_id, round(CASE WHEN risk_chatter_now >= 0.8e0 THEN greatest(0.9e0, last_feed_override - 0.03e0) WHEN risk_chatter_now < 0.35e0 THEN least(1e0, last_feed_override + 0.5e0 * 0.03e0)
      ELSE last_feed_override END, 6) AS feed_override, round(CASE WHEN ok THEN c ELSE last_spindle_override END, 6) AS spindle_override,
      round(CASE WHEN ok THEN score END, 6) + 0.0 AS schedule_score FROM x WHERE r = 1""",
)
def v3(spark: SparkSession, folder: str) -> DataFrame:
    return shadow.lobe_schedule(parts(spark, folder), "window_id", Modal(), Tool(), part_cut())


@query(
    "v4_lookahead",
    f"""WITH {PARTS_SQL}, o AS (SELECT pt.*, r.range AS j, greatest(0.9e0, last_spindle_override - 0.05e0) AS lo, least(1.1e0, last_spindle_override + 0.05e0) AS hi,
        greatest(0.8e0, last_feed_override - 0.05e0) AS fl, least(1.05e0, last_feed_override + 0.05e0) AS fh FROM pt CROSS JOIN range(9) r),
    oy AS (SELECT *, lo + (hi - lo) * j / 8e0 AS s FROM o), oz AS (SELECT *, rpm0 * s AS rpm FROM oy), {margin_sql('oz')},
    m AS (SELECT oz.*, (critical - ap) / critical AS m FROM oz JOIN mg USING (rpm)),
    u AS (SELECT *, greatest(uncertainty, {_unsure('m')}) AS u FROM m),
    g AS (SELECT u.*, k.range AS k, fl + (fh - fl) * k.range / 6e0 AS f FROM u CROSS JOIN range(7) k),
    e AS (SELECT *, least(1e0, greatest(0e0, 0.65e0 / (1e0 + exp(m / 0.22e0)) + 0.35e0 * risk_chatter_now - 0.25e0 * greatest(0e0, 1e0 - f))) AS ex FROM g),
    z AS (SELECT *, f * s - 2.8e0 * ex - 0.45e0 * (abs(f - last_feed_override) + abs(s - last_spindle_override)) - 0.35e0 * uncertainty - 0.9e0 * u - 3e0 * greatest(0e0, u - 0.65e0)
        - CASE WHEN m < -1e0 THEN 0.75e0 ELSE 0e0 END - CASE WHEN risk_chatter_now > 0.7e0 AND f > last_feed_override THEN 4e0 * (f - last_feed_override) ELSE 0e0 END AS score,
        u <= 0.65e0 OR (f = last_feed_override AND s = last_spindle_override) AS ok FROM e),
    x AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY ok DESC, score DESC, k * 9 + j) AS r FROM z)
    SELECT window_id, round(CASE WHEN ok THEN f ELSE last_feed_override END, 6) AS feed_override, round(CASE WHEN ok THEN s ELSE last_spindle_override END, 6) AS spindle_override,
      round(CASE WHEN ok THEN score END, 6) + 0.0 AS lookahead_score FROM x WHERE r = 1""",
)
def v4(spark: SparkSession, folder: str) -> DataFrame:
    return shadow.lookahead_schedule(parts(spark, folder), "window_id", Modal(), Tool(), part_cut())


_V5_OUT = """
g AS (SELECT row_number() OVER (ORDER BY f, s) - 1 AS candidate, f AS feed, s AS spindle FROM (VALUES (0.92e0), (0.96e0), (1e0)) f(f) CROSS JOIN (VALUES (0.97e0), (1e0), (1.04e0)) s(s)),
w AS (SELECT window_id, risk_chatter_now AS baseline_risk, score > 0.5e0 AS shadow_warning, non_tooth_harmonic_ratio AS h FROM win),
o AS (SELECT w.*, g.*, least(1e0, greatest(0e0, baseline_risk - (1e0 - feed) * (h - 5e0) / 4e0 - (spindle - 1e0) * (7e0 - h) / 3e0)) AS risk, (spindle - 1e0) * h AS margin_gain FROM w CROSS JOIN g WHERE shadow_warning)"""


def candidate_outcomes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    base = windows(spark, folder).select(
        "window_id",
        F.col("risk_chatter_now").alias("baseline_risk"),
        (F.col("score") > 0.5).alias("shadow_warning"),
        F.col("non_tooth_harmonic_ratio").alias("h"),
    )
    grid = shadow.candidate_grid(base.where("shadow_warning"), (0.92, 0.96), (0.97, 1.04), "shadow_warning")
    f, s, h = F.col("candidate_feed"), F.col("candidate_spindle"), F.col("h")
    risk = F.least(
        F.lit(1.0), F.greatest(F.lit(0.0), F.col("baseline_risk") - (1.0 - f) * (h - 5.0) / 4.0 - (s - 1.0) * (7.0 - h) / 3.0)
    )
    outcomes = grid.select(
        "window_id", "candidate", f.alias("feed"), s.alias("spindle"), risk.alias("risk"), ((s - 1.0) * h).alias("margin_gain")
    )
    return base.drop("h"), outcomes


def _v5_sql(score_extra: str, allowed: str, strong: str) -> str:
    return f"""WITH {WIN_SQL}, {_V5_OUT},
    z AS (SELECT *, (baseline_risk - risk) + 0.02e0 * feed * spindle - 0.04e0 * (abs(feed - 1e0) + abs(spindle - 1e0)) {score_extra} AS score FROM o),
    x AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY score DESC, candidate) AS r FROM z WHERE {allowed} AND score > 0.02e0),
    j AS (SELECT w.window_id, w.baseline_risk, x.feed, x.spindle, x.score, w.baseline_risk - x.risk AS red,
      coalesce(w.shadow_warning AND ({strong}) AND (abs(x.feed - 1e0) > 1e-12 OR abs(x.spindle - 1e0) > 1e-12), FALSE) AS act FROM w LEFT JOIN (SELECT * FROM x WHERE r = 1) x USING (window_id))
    SELECT window_id, act AS action_active, CASE WHEN act THEN feed ELSE 1e0 END AS feed_override, CASE WHEN act THEN spindle ELSE 1e0 END AS spindle_override,
      round(CASE WHEN act THEN red ELSE 0e0 END, 6) + 0.0 AS selected_risk_reduction, round(coalesce(score, 0.02e0), 6) + 0.0 AS selected_action_score FROM j"""


_V5_PICK = ("window_id", "action_active", "feed_override", "spindle_override", "selected_risk_reduction", "selected_action_score")


@query("v5_outcome_policy", _v5_sql("", "TRUE", "w.baseline_risk - x.risk >= 0.005e0"))
def v5(spark: SparkSession, folder: str) -> DataFrame:
    base, outcomes = candidate_outcomes(spark, folder)
    return shadow.outcome_policy(base, outcomes, "shadow_warning").select(*_V5_PICK)


@query(
    "v5_hybrid_policy",
    _v5_sql("+ 0.18e0 * margin_gain", "baseline_risk - risk >= -0.002e0", "w.baseline_risk - x.risk >= 0.005e0 OR x.margin_gain >= 0.05e0"),
)
def v5_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    base, outcomes = candidate_outcomes(spark, folder)
    return shadow.outcome_policy(base, outcomes, "shadow_warning", margin_weight=0.18, max_worsening=0.002).select(*_V5_PICK)


@query(
    "v6_rule_schedule",
    f"""WITH {TRACE_SQL}, r AS (SELECT scenario, risk_now, CASE WHEN risk_now >= 0.7e0 THEN greatest(0.82e0, previous_feed_override - 0.04e0) WHEN risk_now >= 0.45e0 THEN previous_feed_override
        ELSE least(1e0, previous_feed_override + 0.02e0) END AS f, CASE WHEN risk_now >= 0.7e0 THEN least(1.1e0, previous_spindle_override + 0.04e0)
        WHEN risk_now >= 0.45e0 THEN least(1.08e0, previous_spindle_override + 0.02e0) ELSE previous_spindle_override + 0.25e0 * (1e0 - previous_spindle_override) END AS s FROM tr)
    SELECT scenario, count(*) AS steps, round(avg(f), 6) AS rule_feed, round(avg(s), 6) AS rule_spindle FROM r GROUP BY scenario""",
)
def v6(spark: SparkSession, folder: str) -> DataFrame:
    rules = shadow.rule_schedule(F.col("risk_now"), F.col("previous_feed_override"), F.col("previous_spindle_override"))
    return trace(spark, folder).withColumns(rules).groupBy("scenario").agg(
        F.count(F.lit(1)).alias("steps"), F.avg("rule_feed").alias("rule_feed"), F.avg("rule_spindle").alias("rule_spindle")
    )


def _bin_sql(column: str, edges: tuple[float, ...]) -> str:
    return "(" + " + ".join(f"CAST({column} >= {e!r}::DOUBLE AS INTEGER)" for e in edges) + ")"


_STATE_SOURCE = {
    "feed_override": "previous_feed_override",
    "spindle_override": "previous_spindle_override",
    "risk_now": "risk_now",
    "risk_horizon": "risk_horizon",
    "margin_physics": "current_margin",
    "uncertainty": "risk_uncertainty",
}
_KEY_SQL = " || ':' || ".join(_bin_sql(_STATE_SOURCE[n], e) for n, e in shadow.STATE_BINS.items())
_VALUE = "round(('0x' || substr(md5(state_key || '|' || {0}), 1, 8))::BIGINT / 4294967296e0, 6)"


@query(
    "v7_score_table_policy",
    f"""WITH {TRACE_SQL}, k AS (SELECT *, {_KEY_SQL} AS state_key FROM tr),
    t AS (SELECT DISTINCT state_key FROM k WHERE risk_label <> 'slight'),
    a AS (SELECT state_key, i.range AS i, {_VALUE.format('i.range')} AS q FROM t CROSS JOIN range(9) i),
    b AS (SELECT state_key, min(i) AS action FROM (SELECT *, max(q) OVER (PARTITION BY state_key) AS top FROM a) WHERE abs(q - top) <= 1e-8 + 1e-5 * top GROUP BY state_key),
    j AS (SELECT k.*, coalesce(b.action, 0) AS action FROM k LEFT JOIN b USING (state_key))
    SELECT state_key, CAST(action AS BIGINT) AS action, count(*) AS steps, round(sum(least(1.05e0, greatest(0.8e0, previous_feed_override + [-0.05e0, 0e0, 0.05e0][CAST(action // 3 + 1 AS INTEGER)]))), 6) AS feed_sum,
      round(sum(least(1.1e0, greatest(0.9e0, previous_spindle_override + [-0.05e0, 0e0, 0.05e0][CAST(action % 3 + 1 AS INTEGER)]))), 6) AS spindle_sum FROM j GROUP BY 1, 2""",
)
def v7(spark: SparkSession, folder: str) -> DataFrame:
    rows = trace(spark, folder)
    columns = {name: F.col(source) for name, source in _STATE_SOURCE.items()}
    known = rows.where(F.col("risk_label") != "slight").select(shadow.state_key(columns).alias("state_key")).distinct()
    draw = F.transform(
        F.sequence(F.lit(0), F.lit(8)),
        lambda i: F.round(
            F.conv(F.substring(F.md5(F.concat_ws("|", F.col("state_key"), i.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0, 6
        ),
    )
    table = known.withColumn("action_values", draw)
    return (
        shadow.table_policy(rows, table, columns)
        .groupBy("state_key", "action")
        .agg(F.count(F.lit(1)).alias("steps"), F.sum("policy_feed").alias("feed_sum"), F.sum("policy_spindle").alias("spindle_sum"))
    )
