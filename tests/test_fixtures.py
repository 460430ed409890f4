"""Small fixtures with expected values worked out by hand."""

import json
import math
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindleflow.functions import control, labels, physics, signal
from spindleflow.functions.features import project_features
from spindleflow.functions.risk import RiskInputs, risk_struct
from spindleflow.operators import align, gates, learning, metrics, pseudo, runs, shadow, splits
from spindleflow.operators.scan import Layout
from spindleflow.plans import ingest, training
from spindleflow.schema import WINDOW_SCHEMA
from spindleflow.sources import packages, tables


def csv_of(path, header, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join([",".join(header), *[",".join(map(str, r)) for r in rows]]) + "\n")
    return str(path)


def cell(values):
    return '"[' + ", ".join(map(str, values)) + ']"'


HEAD = ("timestamp", "fs", "numscans", "spindlespeed", "x_channel", "y_channel", "status")


def package_rows(states):
    shapes = [(list(range(16)), [i / 2 for i in range(16)]), (list(range(16, 0, -1)), [i % 3 for i in range(16)])]
    return [(f"t{i}", 1000, 16, 6000, cell(x), cell(y), s) for i, ((x, y), s) in enumerate(zip(shapes, states))]


PLAN = ingest.WindowPlan(0.008, 0.004, 0.02, 0.01)


def test_package_vectors_to_windows(spark, tmp_path):
    csv_of(tmp_path / "machine_a.csv", HEAD, package_rows(("0", "1")))
    table = ingest.ingest_packages(spark, str(tmp_path), PLAN).collect()
    assert len(table) == 6
    assert sorted(r["label"] for r in table) == ["slight"] * 3 + ["stable"] * 3
    assert {r["scenario"] for r in table} == {"machine_a"}
    assert sorted(r["window_id"] for r in table) == list(range(6))
    assert [f.name for f in WINDOW_SCHEMA.fields] == list(table[0].asDict())
    assert min(r["uncertainty"] for r in table) >= 0.80
    first = [r for r in table if r["window_index_in_episode"] == 0]
    assert all(r["rms_delta"] == 0.0 and r["rms_ewma"] == r["rms"] for r in first)


def test_package_expanded_columns(spark, tmp_path):
    names = ["timestamp", "fs", "numscans", "spindlespeed", "status"] + [f"{a}_channel_{i}" for a in "xy" for i in range(4)]
    csv_of(tmp_path / "wide.csv", names, [("t", 1000, 4, 6000, "chatter", 1, 2, 3, 4, 4, 3, 2, 1)])
    table = ingest.ingest_packages(spark, str(tmp_path), ingest.WindowPlan(0.004, 0.004, 0.02, 0.01)).collect()
    assert [r["label"] for r in table] == ["slight"]


def test_idle_packages_are_skipped_unless_asked(spark, tmp_path):
    csv_of(tmp_path / "idle.csv", HEAD, package_rows(("No Machining", "Stable")))
    read = packages.read_packages(spark, str(tmp_path))
    assert read.count() == 2 and read.where("kept").count() == 1
    assert ingest.ingest_packages(spark, str(tmp_path), PLAN).count() == 3
    both = ingest.ingest_packages(spark, str(tmp_path), PLAN, include_unknown=True)
    assert {r["label"]: r["count"] for r in both.groupBy("label").count().collect()} == {"stable": 3, "unknown": 3}


def test_triaxial_folders(spark, tmp_path):
    for quality, offset in (("good", 0), ("bad", 10)):
        csv_of(tmp_path / "M01" / "OP00" / quality / f"{quality}.csv", "xyz", [(i + offset, 2 * i + offset, 3 * i + offset) for i in range(8)])
    samples = tables.read_triaxial(spark, str(tmp_path), 10.0)
    rows = samples.withColumns(
        {"episode": F.when(F.col("quality") == "good", 0).otherwise(1).cast("long"), "label": labels.quality_to_label(F.col("quality"))}
    )
    table = ingest.ingest_samples(rows, ingest.WindowPlan(0.4, 0.2, 0.8, 10.0), 10.0, 6000.0)
    assert {r["label"]: r["count"] for r in table.groupBy("label").count().collect()} == {"stable": 3, "severe": 3}
    found = tables.discover_files(spark, str(tmp_path)).collect()
    assert {(r["machine"], r["operation"], r["quality"]) for r in found} == {("M01", "OP00", "good"), ("M01", "OP00", "bad")}


def test_controller_signals_drop_non_numeric(spark, tmp_path):
    csv_of(tmp_path / "IM-01F_hfdata.csv", ("CYCLE", "LOAD|6", "CURRENT|6"), [(i, "x" if i == 3 else i, i * 2) for i in range(9)])
    rows = tables.read_controller_hf(spark, str(tmp_path), ("LOAD|6", "CURRENT|6"), 10.0).orderBy("sample_idx").collect()
    assert [r["ch"][0] for r in rows] == [0, 1, 2, 4, 5, 6, 7, 8] and rows[-1]["sample_idx"] == 7
    with pytest.raises(ValueError):
        tables.read_controller_hf(spark, str(tmp_path), ("LOAD|9",), 10.0)


def machine_run(folder):
    t = [i / 1000 for i in range(240)]
    wave_of = [(x + 5.0, math.sin(2 * math.pi * 120 * x), 0.5 * math.sin(2 * math.pi * 220 * x), 0.25 * math.sin(2 * math.pi * 320 * x)) for x in t]
    csv_of(folder / "sensors.csv", ("time_s", "accel_x", "accel_y", "accel_z"), wave_of)
    csv_of(folder / "cnc_context.csv", ("time_s", "spindle_rpm", "feed_per_tooth_m"), [(5.0 + x, 9000, 45e-6) for x in (0.0, 0.12, 0.24)])
    csv_of(folder / "labels.csv", ("start_time_s", "end_time_s", "label"), [(5.0, 5.10, "stable"), (5.10, 5.15, "transition"), (5.15, 5.24, "slight")])
    (folder / "metadata.json").write_text(json.dumps({"run_id": "fixture_run", "tool": {"flute_count": 4}, "process": {"axial_depth_m": 0.0004}}))


def test_machine_run(spark, tmp_path):
    machine_run(tmp_path)
    table = ingest.ingest_machine_run(spark, str(tmp_path), ingest.WindowPlan(0.05, 0.05, 0.10, 0.1)).orderBy("window_id").collect()
    assert len(table) == 4 and {r["scenario"] for r in table} == {"fixture_run"}
    assert [r["label"] for r in table] == ["stable", "stable", "transition", "slight"]
    assert [r["horizon_label"] for r in table] == ["transition", "slight", "slight", "slight"]
    assert table[1]["time_to_chatter_s"] == pytest.approx(0.10, abs=1e-6)
    assert all(r["spindle_rpm"] == pytest.approx(9000) for r in table)
    assert table[0]["axial_depth_m"] == 0.0004


def test_many_machine_runs_in_one_job(spark, tmp_path):
    machine_run_of = {"first": (2, "shared"), "second": (5, "shared"), "third": (None, None)}
    for name, (flutes, run_id) in machine_run_of.items():
        home, rate = tmp_path / name, 500 if name == "second" else 1000
        home.mkdir()
        machine_run(home)
        if name == "second":
            t = [i / rate for i in range(120)]
            csv_of(home / "sensors.csv", ("time_s", "accel_x", "accel_y", "accel_z"), [(x + 5.0, math.sin(700 * x), math.sin(900 * x), 0.1) for x in t])
        csv_of(home / "cnc_context.csv", ("time_s", "spindle_rpm", "feed_mm_min"), [(5.0 + x, 9000, 1800) for x in (0.0, 0.24)])
        if flutes is None:
            (home / "metadata.json").unlink()
            (home / "labels.csv").unlink()
        else:
            (home / "metadata.json").write_text(json.dumps({"run_id": run_id, "tool": {"flute_count": flutes}}))
    table = ingest.ingest_machine_run(spark, str(tmp_path), ingest.WindowPlan(0.05, 0.05, 0.10, 0.1), "unknown")
    rows = table.orderBy("scenario", "episode", "window_index_in_episode").collect()
    assert [(r["scenario"], r["episode"]) for r in rows] == [*[("shared", 0)] * 4, *[("shared", 1)] * 4, *[("third", 0)] * 4]
    for r, flutes in zip(rows, [2] * 4 + [5] * 4 + [4] * 4):
        assert r["feed_per_tooth_m"] == pytest.approx(1.8 / (9000 * flutes))
        assert r["tooth_frequency_hz"] == pytest.approx(150 * flutes)
    assert [r["label"] for r in rows] == ["stable", "stable", "transition", "slight"] * 2 + ["unknown"] * 4
    assert [r["start_time_s"] for r in rows[:8]] == pytest.approx([0.0, 0.05, 0.1, 0.15] * 2)
    assert len({r["margin_physics"] for r in rows}) == 3


def test_runs_with_different_headers_fail(spark, tmp_path):
    for name, axes in (("one", ("accel_x", "accel_y", "accel_z")), ("two", ("accel_y", "accel_x", "accel_z"))):
        (tmp_path / name).mkdir()
        machine_run(tmp_path / name)
        csv_of(tmp_path / name / "sensors.csv", ("time_s", *axes), [(5.0 + n / 10, 0, 1, 2) for n in range(20)])
    with pytest.raises(Exception, match="CSV header"):
        ingest.ingest_machine_run(spark, str(tmp_path), ingest.WindowPlan(0.5, 0.5, 1.0, 0.1)).collect()


def test_machine_run_with_a_clock_that_stalls(spark, tmp_path):
    machine_run(tmp_path)
    csv_of(tmp_path / "sensors.csv", ("time_s", "accel_x", "accel_y", "accel_z"), [(5.0, 0, 0, 0)] * 6)
    with pytest.raises(ValueError, match="strictly increasing"):
        ingest.ingest_machine_run(spark, str(tmp_path))


def test_sound_files(spark, tmp_path):
    for sensor in (0, 1):
        path = tmp_path / "ExpA" / f"cut_sensor{sensor}.wav"
        path.parent.mkdir(exist_ok=True)
        with wave.open(str(path), "wb") as out:
            out.setnchannels(1)
            out.setsampwidth(2)
            out.setframerate(1000)
            data = [int(10000 * math.sin(i / 7 + sensor)) + 500 for i in range(100 + 5 * sensor)]
            out.writeframes(b"".join(struct.pack("<h", v) for v in data))
    rows = packages.read_sound(spark, str(tmp_path), (0, 1)).orderBy("sample_idx").collect()
    assert len(rows) == 100 and rows[0]["rate"] == 1000.0
    first = np.array([int(10000 * math.sin(i / 7)) + 500 for i in range(100)]) / 32768
    assert np.allclose([r["ch"][0] for r in rows], first - first.mean())


def test_label_intervals_must_end_after_start(spark, tmp_path):
    path = csv_of(tmp_path / "labels.csv", ("start_time_s", "end_time_s", "label"), [(1.0, 1.0, "stable")])
    with pytest.raises(Exception, match="end_time_s must exceed"):
        tables.read_label_intervals(spark, path).collect()


# ---- features, risk, stability --------------------------------------------------------------------------------


def test_tone_at_the_tooth_frequency_dominates(spark):
    n, rate, rpm = 400, 4000.0, 6000.0
    tone = [math.sin(2 * math.pi * 400.0 * i / rate) for i in range(n)]
    df = spark.createDataFrame([(tone,)], "x array<double>")
    rows = signal.with_series(df, "s", signal.centred(F.col("x"))).select(
        signal.spectral_features("s", F.lit(rate), F.lit(rpm), F.lit(4), F.lit(None).cast("double")).alias("p"),
        signal.time_features(F.col("s")).alias("f"),
    )
    row = rows.first()
    assert row["p"]["tooth_frequency_hz"] == 400.0
    assert abs(row["p"]["dominant_frequency_hz"] - 400.0) <= rate / 200
    assert row["f"]["rms"] == pytest.approx(1 / math.sqrt(2), rel=1e-3)


def test_one_channel_window_uses_magnitude(spark):
    df = spark.createDataFrame([([[1.0], [-1.0], [3.0], [-3.0]],)], "w array<array<double>>")
    assert df.select(signal.series_of_window(F.col("w"))).first()[0] == [-1.0, -1.0, 1.0, 1.0]


def risk_of(spark, margin, healthy=True):
    df = spark.createDataFrame([(1e-3, 1e-2, 3.0, 0.4, margin, healthy)], "c double, t double, k double, e double, m double, h boolean")
    return df.select(risk_struct(RiskInputs(F.col("c"), F.col("t"), F.col("k"), F.col("e"), F.col("m"), F.col("h"))).alias("r")).first()["r"]


def test_risk_rises_as_the_margin_falls(spark):
    assert risk_of(spark, -0.5)["risk_chatter_now"] > risk_of(spark, 0.5)["risk_chatter_now"]
    sick = risk_of(spark, -0.5, False)
    assert (sick["label"], sick["risk_chatter_now"], sick["uncertainty"], sick["reasons"]) == ("unknown", 0.5, 0.95, ["sensor_unhealthy"])


def test_margin_falls_with_depth(spark):
    df = spark.createDataFrame([(0.0002,), (0.0006,), (0.002,)], "ap double")
    v = physics.stability(physics.Modal(), physics.Tool(), physics.Cut(axial_depth_m=F.col("ap")))
    margins = [r["v"]["signed_margin"] for r in df.withColumn("v", v).orderBy("ap").collect()]
    assert margins[0] > margins[1] > margins[2]


def test_shield(spark):
    df = spark.createDataFrame(
        [(0.5, 1.5, 1.0, 1.0, "stable", 0.1), (0.9, 1.0, 1.0, 1.0, "unknown", 0.1), (0.9, 1.0, 0.95, 1.0, "stable", 0.9)],
        "f double, s double, pf double, ps double, label string, u double",
    )

    def run(mode):
        return control.apply_shield(df, control.Shield(uncertainty_mode=mode), "f", "s", "pf", "ps", "label", "u").collect()

    rejected = run("reject")
    assert rejected[0]["shield_feed_override"] == pytest.approx(0.95)
    assert rejected[0]["shield_reasons"] == ["feed_clipped", "spindle_clipped", "feed_rate_limited", "spindle_rate_limited"]
    assert rejected[1]["shield_rejected"] and rejected[1]["shield_reasons"] == ["unknown_chatter_state"]
    assert rejected[2]["shield_rejected"] and rejected[2]["shield_feed_override"] == 0.95
    assert run("hold")[2]["shield_accepted"] and run("hold")[2]["shield_reasons"] == ["high_uncertainty", "uncertainty_hold"]
    assert run("advisory")[2]["shield_feed_override"] == pytest.approx(0.9)


def test_missing_feature_columns_are_named(spark):
    with pytest.raises(ValueError, match="axial_depth_m"):
        project_features(spark.createDataFrame([(0.1,)], "margin_physics double"), ("critical_depth_proxy_m",))


# ---- pseudo-labels --------------------------------------------------------------------------------------------


def pseudo_rows(spark, rows):
    cols = "window_id long, scenario string, episode long, start_time_s double, label string, rms double"
    df = spark.createDataFrame(rows, cols)
    return df.withColumns({"chatter_band_energy": F.col("rms"), "non_tooth_harmonic_ratio": F.col("rms")})


COLS3 = ("rms", "chatter_band_energy", "non_tooth_harmonic_ratio")


def test_pseudo_labels_by_scenario(spark):
    rows = [(i, "stable_trial", 1, i * 0.1, "stable", 1.0) for i in range(3)]
    rows += [(3 + i, "chatter_trial", 2, i * 0.1, "slight", v) for i, v in enumerate((1.0, 31.62, 1000.0, 100000.0))]
    out = pseudo.relabel(pseudo_rows(spark, rows), pseudo.PseudoLabels(columns=COLS3), Layout(span=1.0), 0.2)
    got = {r["window_id"]: r for r in out.collect()}
    assert [got[i]["label"] for i in range(3, 7)] == ["stable", "transition", "slight", "severe"]
    assert got[3]["future_chatter_within_horizon"] and got[3]["time_to_chatter_s"] == pytest.approx(0.2)
    assert sum(r["pseudo_label_changed"] for r in got.values()) == 3


def test_pseudo_labels_by_label(spark):
    rows = [(0, "mixed_exp", 1, 0.0, "stable", 1e5), (1, "stable_exp", 1, 0.0, "stable", 1.0), (2, "stable_exp", 1, 0.1, "stable", 1.0)]
    rows += [(3 + i, "stable_exp", 2 + i, 0.0, "stable", 1.0) for i in range(3)]
    rows += [(10 + i, "mixed_exp", 2, i * 0.1, "slight", v) for i, v in enumerate((1.0, 1e6, 1e8))]
    out = pseudo.relabel(pseudo_rows(spark, rows), pseudo.PseudoLabels(columns=COLS3, mode="label"), Layout(span=1.0), 0.2)
    got = {r["window_id"]: r for r in out.collect()}
    assert got[0]["label"] == "stable" and not got[0]["pseudo_label_candidate"]
    assert sum(r["pseudo_label_candidate"] for r in got.values()) == 3
    assert got[12]["source_label"] == "slight" and got[10]["label"] == "stable"


# ---- shadow policy, errors, recommendations -------------------------------------------------------------------


def test_shadow_policy_detects_onset(spark):
    rows = [(0, "onset", 0, 0.0, 1, "transition", 0.75), (1, "onset", 0, 0.1, 2, "slight", 0.9), (2, "stable", 0, 0.0, 0, "stable", 0.2)]
    df = spark.createDataFrame(rows, "window_id long, scenario string, episode long, start_time_s double, label_id int, label string, score double")
    recs = shadow.recommend(df, Layout(span=1.0), "score", shadow.ShadowPolicy(threshold=0.5))
    events = metrics.event_warning_metrics(recs, F.col("shadow_warning"), ("scenario", "episode"), any_quiet_warning=True).first()
    assert (events["event_episodes"], events["detected_event_episodes"], events["false_warning_episodes"], events["f1"]) == (1, 1, 0, 1.0)
    assert events["mean_detected_lead_time_s"] == pytest.approx(0.1)
    assert shadow.burden(recs).first()["relative_mrr_proxy"] < 1.0


def test_error_analysis(spark):
    rows = [("ExpA", "stable", "stable"), ("ExpA", "slight", "slight"), ("ExpA", "severe", "stable"),
            ("ExpB", "slight", "stable"), ("ExpB", "severe", "stable"), ("ExpB", "stable", "slight")]
    df = spark.createDataFrame(rows, "scenario string, target string, predicted string")
    by_label = {r["label"]: r for r in metrics.label_metrics(df, "target", "predicted").collect()}
    assert by_label["chatter_binary"]["support"] == 4 and "transition" not in by_label
    worst = metrics.worst_groups(metrics.group_metrics(df, "scenario", "target", "predicted"), "scenario").first()
    assert worst["scenario"] == "ExpB" and worst["false_negative_windows"] == 2
    matrix = {r["truth"]: r for r in metrics.confusion_matrix(df, "target", "predicted").collect()}
    assert matrix["severe"]["stable"] == 2 and matrix["unknown"]["stable"] == 0 and len(matrix) == 5


def test_recommendation_without_a_window_fails(spark):
    windows = spark.createDataFrame([(1, 9000.0)], "window_id long, spindle_rpm double")
    recs = spark.createDataFrame([(1, True), (2, False)], "window_id long, shadow_warning boolean")
    with pytest.raises(Exception, match="no window for recommendation 2"):
        align.join_recommendations(recs, windows).collect()
    assert align.join_recommendations(recs.where("window_id = 1"), windows).count() == 1


def test_margin_policy_acts_on_warnings_only(spark):
    df = spark.createDataFrame([(1, True, 0.002), (2, False, 0.0002)], "window_id long, shadow_warning boolean, axial_depth_m double")
    out = shadow.margin_policy(df, "shadow_warning", physics.Modal(), physics.Tool(), physics.Cut(axial_depth_m=F.col("axial_depth_m")), min_gain=0.0)
    got = {r["window_id"]: r for r in out.collect()}
    assert got[2]["spindle_override"] == 1.0 and not got[2]["action_active"]
    assert got[1]["selected_margin_improvement"] >= 0.0


# ---- gates and runs -------------------------------------------------------------------------------------------

GATE = (
    "run string, recommendation_windows long, mean_risk double, max_risk double, unstable_mean_risk double, relative_mrr_proxy double,"
    " guard_fallback_fraction double, action_fraction double, shield_rejections long, mode string, cnc_writes_enabled boolean,"
    " real_machine_data boolean, operator_approval boolean, hardware_interlock boolean"
)


def test_gates(spark):
    good = ("a", 160, 0.50, 0.74, 0.57, 1.13, 0.10, 0.46, 0, "shadow_only", False, False, False, False)
    bad = ("b", 160, 0.60, 0.74, None, 1.13, 0.10, 0.46, 0, "shadow_only", None, False, False, False)
    checks = gates.gate_checks(spark.createDataFrame([good, bad], GATE))
    got = {(r["run"], r["profile"]): r for r in gates.gate_decisions(checks).collect()}
    assert got["a", "shadow_review"]["status"] == "pass" and got["a", "shadow_review"]["promotion_level"] == "shadow_review_candidate"
    assert got["a", "live_shadow"]["status"] == "blocked" and not got["a", "shadow_review"]["hardware_actuation_allowed"]
    assert set(got["b", "shadow_review"]["failed_checks"]) == {"mean_risk", "unstable_mean_risk", "cnc_writes_disabled"}
    ready = {r["run"]: r["readiness"] for r in gates.readiness(gates.gate_decisions(checks)).collect()}
    assert ready == {"a": "good_internal_demo_complete", "b": "needs_attention"}
    loose = gates.gate_checks(spark.createDataFrame([bad], GATE), ("shadow_review",), max_mean_risk=0.9)
    assert loose.where("check = 'mean_risk' AND passed").count() == 1
    with pytest.raises(ValueError):
        gates.profile_values("other")


def test_policy_selection(spark):
    cols = "seed long, scenario string, mean_risk double, max_risk double, relative_mrr_proxy double, shield_rejections long"
    rows = [(11, "stable", 0.25, 0.35, 0.85, 0), (11, "unstable", 0.35, 0.45, 0.85, 0), (22, "stable", 0.32, 0.4, 1.05, 0), (22, "unstable", 0.38, 0.5, 1.05, 0)]
    diag = spark.createDataFrame([(11, 0, 40), (22, 4, 40)], "seed long, guard_fallbacks long, steps long")
    scored = runs.policy_score(spark.createDataFrame(rows, cols), diag, ("seed",), {"shortfall": 5.0})
    ranked = {r["seed"]: r["selected"] for r in runs.rank_policies(scored).collect()}
    assert ranked == {11: False, 22: True}


def test_reason_counts_round_trip(spark):
    df = spark.createDataFrame([("g", ["b", "a"]), ("g", ["a"]), ("h", [])], "k string, r array<string>")
    counts = {r["k"]: r["reason_counts"] for r in runs.reason_counts(df, F.col("r"), ("k",)).collect()}
    assert counts == {"g": "a:2;b:1", "h": ""}
    texts = spark.createDataFrame([("g", "a:2;b:1"), ("g", "b:4;bad"), ("h", "")], "k string, t string")
    merged = {r["k"]: r["reason_counts"] for r in runs.merge_reason_counts(texts, "t", ("k",)).collect()}
    assert merged == {"g": "a:2;b:5", "h": ""}


def test_best_threshold_prefers_the_lower_of_equals(spark):
    rows = [(0.25, 0.8, 1.0, 0.7), (0.5, 0.8, 1.0, 0.7), (0.75, 0.4, 0.5, 0.3)]
    best = metrics.best_threshold(spark.createDataFrame(rows, "threshold double, f1 double, recall double, precision double")).first()
    assert best["threshold"] == 0.25


def test_auc_and_guarded_correlation(spark):
    rows = [(0.1, False, 1.0), (0.4, True, 1.0), (0.4, False, 1.0), (0.8, True, 1.0)]
    df = spark.createDataFrame(rows, "p double, y boolean, flat double")
    assert metrics.roc_auc(df, "p", F.col("y")).first()["roc_auc"] == pytest.approx(0.875)
    assert df.agg(metrics.guarded_corr(F.col("p"), F.col("flat"))).first()[0] == 0.0


# ---- splits and training --------------------------------------------------------------------------------------


def window_table(spark):
    rows = []
    for e in range(24):
        for i in range(12):
            level = 0.1 + 0.03 * e + 0.02 * i
            label = "stable" if level < 0.3 else "transition" if level < 0.5 else "slight" if level < 0.7 else "severe"
            rows.append((e * 12 + i, f"s{e % 3}", e, i * 0.1, label, level, math.sin(e * 5 + i), 0.6 + 0.05 * e))
    df = spark.createDataFrame(rows, "window_id long, scenario string, episode long, start_time_s double, label string, rms double, noise double, axial_depth_scale double")
    from spindleflow.operators.sequence import horizon_labels

    df = df.withColumns({"label_id": labels.id_of_label(F.col("label")), "risk_chatter_now": F.col("rms")})
    return horizon_labels(df, Layout(span=1.0), 0.25)


@pytest.mark.parametrize("mode", ["episode", "parameter_family", "scenario"])
def test_group_splits_are_disjoint(spark, mode):
    config = training.Training(split=mode, validation_fraction=0.25)
    split = training.split_windows(window_table(spark), config, Layout(span=1.0))
    sides = {r["split"] for r in split.select("split").distinct().collect()}
    assert {"fit", "test"} <= sides
    key = ("scenario",) if mode == "scenario" else ("scenario", "episode")
    for a, b in (("fit", "test"), ("validation", "test"), ("fit", "validation")):
        assert splits.overlap(split, a, b, key).count() == 0
    assert split.count() == 288


def test_time_blocks_hold_out_the_late_windows(spark):
    split = splits.time_block_split(window_table(spark), Layout(span=0.5), 0.3)
    for r in split.groupBy("episode").agg(
        F.max(F.when(F.col("split") == "train", F.col("start_time_s"))).alias("a"),
        F.min(F.when(F.col("split") == "test", F.col("start_time_s"))).alias("b"),
        F.count(F.when(F.col("split") == "test", 1)).alias("n"),
    ).collect():
        assert r["a"] < r["b"] and r["n"] == 4


@pytest.mark.parametrize("options", [{"model": "softmax"}, {"model": "trees", "iterations": 3}, {"calibration": "isotonic", "iterations": 10}])
def test_training_end_to_end(spark, options):
    config = training.Training(features=("rms", "noise"), split="row", validation_fraction=0.2, **options)
    run = training.train_risk(window_table(spark), config, Layout(span=1.0))
    scores = {r["split"]: r for r in run["classification"].collect()}
    assert scores["test"]["accuracy"] > 0.6
    p = run["predictions"].select((F.aggregate("probability", F.lit(0.0), lambda a, x: a + x)).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert p[0] == pytest.approx(1.0, abs=1e-6) and p[1] == pytest.approx(1.0, abs=1e-6)
    outcome = training.shadow_evaluation(run, Layout(span=1.0))
    assert outcome["burden"].first()["windows"] == run["predictions"].where("split = 'test'").count()


def test_window_dataset_round_trip(spark, tmp_path):
    table = window_table(spark)
    tables.write_window_dataset(table, str(tmp_path / "d"), 0.1, 0.05)
    stored = tables.read_window_dataset(spark, str(tmp_path / "d"))
    assert stored.count() == 288
    facts = tables.manifest(stored, 0.1, 0.05).first()
    assert facts["total_windows"] == 288 and sum(facts["label_counts"].values()) == 288


def test_status_words(spark):
    texts = ["0", " Severe ", "chatter", "0.7", "0.2", None, "No Machining", "what", "warning"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["l"] for r in df.select("i", labels.status_to_label(F.col("t")).alias("l")).orderBy("i").collect()]
    assert got == ["stable", "severe", "slight", "slight", "stable", "unknown", "unknown", "unknown", "transition"]


def test_sql_names(spark):
    from spindleflow.functions.sql import register

    register(spark)
    row = spark.sql("SELECT status_to_label(' Severe') AS a, status_to_label('0.7') AS b, risk_score(1e-3D, 1e-2D, 3D, 0.4D, -0.5D) AS r").first()
    assert (row["a"], row["b"]) == ("severe", "slight")
    assert row["r"] == pytest.approx(risk_of(spark, -0.5)["risk_chatter_now"], rel=1e-9)
    wave_row = spark.sql("SELECT spectral_features(transform(sequence(0, 127), i -> sin(i / 3D)), 100D, 300D, 4, CAST(NULL AS DOUBLE)) AS p").first()
    assert wave_row["p"]["tooth_frequency_hz"] == 20.0


def test_sigmoid_maps_reach_the_optimum_in_few_passes(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = []
    for fold in range(2):
        for _ in range(600):
            a, b = rng.random(), rng.random()
            label = 0 if rng.random() < 1 / (1 + np.exp(3 - (4 + fold) * a)) else 1
            rows.append((fold, [a, b, 0.25, float(label == 1)], label))
    table = spark.createDataFrame(rows, "fold int, p array<double>, label int").persist()
    passes, collect = [], type(table).collect
    monkeypatch.setattr(type(table), "collect", lambda self: passes.append(1) or collect(self))
    found = learning.sigmoid_maps(table, [(k, c) for k in range(2) for c in range(4)])
    assert len(passes) < 70
    for (k, c), (slope, intercept) in found.items():
        s = np.array([p[c] for f, p, _ in rows if f == k])
        y = np.array([float(label == c) for f, _, label in rows if f == k])
        if c > 1:  # no row of the class
            assert (slope, intercept) == (0.0, -math.inf)
            continue
        away = y - 1 / (1 + np.exp(-(slope * s + intercept)))
        assert abs(away.sum()) < 1e-4 and abs((away * s).sum()) < 1e-4
    apart = table.select("fold", F.array(F.col("p")[2], F.col("p")[3]).alias("p"), "label")
    found = learning.sigmoid_maps(apart, [(0, 0), (0, 1)])
    share = np.mean([label == 0 for f, _, label in rows if f == 0])
    assert found[0, 0] == (0.0, pytest.approx(math.log(share / (1 - share))))  # a score that never varies
    slope, intercept = found[0, 1]  # a score that tells the class without fail
    assert 1 / (1 + math.exp(-slope - intercept)) > 0.999 and 1 / (1 + math.exp(-intercept)) < 0.001


def test_sweeps_are_computed_when_they_are_read():
    asked = []
    run = training.Results({"model": 1}, {"lead": lambda: asked.append("lead") or 2})
    assert run["model"] == 1 and not asked
    assert run["lead"] == run["lead"] == 2 and asked == ["lead"]


@pytest.mark.parametrize("kind", ["softmax", "trees", "sigmoid", "isotonic"])
def test_saved_models_score_alike(spark, tmp_path, kind):
    from spindleflow.operators import learning

    rows = [(i, i % 3, float(i % 3) + ((i * 37) % 11) / 20.0, float((i * 53) % 7)) for i in range(240)]
    df = spark.createDataFrame(rows, "window_id long, label_id int, a double, b double")
    fit = lambda d: learning.train_softmax(d, ("a", "b"), "label_id")
    if kind == "softmax":
        model = fit(df)
    elif kind == "trees":
        model = learning.train_trees(df, ("a", "b"), "label_id", max_iter=3)
    else:
        model = learning.calibrate_scores(df, fit, "label_id", "window_id", kind, 2)
    model.save(spark, str(tmp_path))
    again = learning.RiskModel.load(spark, str(tmp_path))
    mine, theirs = ({r["window_id"]: (r["probability"], r["predicted_label"]) for r in m.transform(df).collect()} for m in (model, again))
    assert mine == theirs


def test_m2_grows_all_rounds_of_its_trees(spark, sf, monkeypatch):
    from spindleflow.plans import model_queries

    runs, train = [], model_queries.train_risk
    monkeypatch.setattr(model_queries, "train_risk", lambda *a: runs.append(train(*a)) or runs[-1])
    scores = {r["split"]: r for r in model_queries.m2(spark, sf).collect()}
    model = runs[0]["model"]
    rounds = [len(trees) for trees in model.forest.values] if getattr(model, "forest", None) else [s.getNumTrees for s in model.stages]
    assert rounds == [250] * 4 and scores["test"]["accuracy"] > 0.9


def test_trees_of_cells_are_those_of_rows(spark, monkeypatch):
    from spindleflow.operators import forest

    rng = np.random.default_rng(8)
    rows = []
    for i in range(900):
        a, b, c = int(rng.integers(0, 12)), int(rng.integers(0, 9)), int(rng.integers(0, 30))
        label = 0 if a + b < 7 + rng.normal() else 3 if c > 24 else 1
        rows.append((i, label, a / 7.0, float(b), c / 3.0))
    df = spark.createDataFrame(rows, "window_id long, label_id int, a double, b double, c double")
    fit = lambda: learning.train_trees(df, ("a", "b", "c"), "label_id", max_iter=6, min_rows=7)
    counted = fit()
    assert counted.forest and [len(e) for e in counted.forest.edges] == [11, 8, 29]
    monkeypatch.setattr(forest, "CELLS", 0)
    whole = fit()
    assert len(whole.stages) == 3 and whole.forest is None
    # New rows too, in cells that had none and beyond all values.
    new = [(1000 + i, 0, float(rng.uniform(-1, 3)), float(rng.uniform(-2, 11)), float(rng.uniform(-1, 12))) for i in range(300)]
    both = df.union(spark.createDataFrame(new, df.schema))
    mine, theirs = ({r["window_id"]: r["probability"] for r in m.transform(both).collect()} for m in (counted, whole))
    assert len(mine) == 1200
    for key, p in mine.items():
        assert p == pytest.approx(theirs[key], abs=1e-9)


def test_scores_of_cells_outlive_what_is_kept(spark, monkeypatch):
    from spindleflow.operators import forest

    rows = [(i, i % 2, float(i % 17), float((i * 7) % 13)) for i in range(900)]
    df = spark.createDataFrame(rows, "window_id long, label_id int, a double, b double").coalesce(1)
    model = learning.train_trees(df, ("a", "b"), "label_id", max_iter=4)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        kept = {r["window_id"]: r["probability"] for r in model.transform(df).collect()}
        monkeypatch.setattr(forest, "KNOWN", 60)
        assert kept == {r["window_id"]: r["probability"] for r in model.transform(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    with pytest.raises(Exception, match="a feature is NULL or NaN"):
        model.transform(df.withColumn("a", F.when(F.col("a") > 1, F.col("a")))).collect()


def test_edges_count_each_label_alike(spark):
    from spindleflow.operators import forest

    rows = [(0, i / 5000.0) for i in range(5000)] + [(1, 1.0 + i / 100.0) for i in range(100)]
    (edges,) = forest.bin_edges(spark.createDataFrame(rows, "y int, x double"), ("x",), "y")
    assert len(edges) == 31 and sum(e < 1.0 for e in edges) in (15, 16)
    assert np.allclose(np.diff(edges[:15]), 1 / 16, atol=0.005)
    assert forest._edges(np.array([-math.inf, 1.0, 1.0, 3.0, math.inf])) == [-math.inf, 2.0, 3.0]


def test_sound_is_read_by_ranges(spark, tmp_path):
    rng = np.random.default_rng(5)
    written = {}
    for experiment, widths, channels in (("ExpA", (2, 3), 1), ("Exp B", (1, 4), 2)):
        for sensor, width in enumerate(widths):
            path = tmp_path / experiment / f"cut_sensor{sensor}.wav"
            path.parent.mkdir(exist_ok=True)
            n = 1000 + 37 * sensor
            low, high = (0, 256) if width == 1 else (-(2 ** (8 * width - 1)), 2 ** (8 * width - 1))
            data = rng.integers(low, high, (n, channels))
            with wave.open(str(path), "wb") as out:
                out.setnchannels(channels)
                out.setsampwidth(width)
                out.setframerate(1000)
                out.writeframes(b"".join(int(v).to_bytes(width, "little", signed=width > 1) for v in data.reshape(-1)))
            mono = data.mean(axis=1) / (255 if width == 1 else high)
            written[experiment, sensor] = mono - mono.mean()
    rows = packages.read_sound(spark, str(tmp_path), (0, 1), frames=64).orderBy("experiment", "sample_idx").collect()
    assert [r["sample_idx"] for r in rows] == list(range(1000)) * 2
    for experiment in ("ExpA", "Exp B"):
        got = np.array([r["ch"] for r in rows if r["experiment"] == experiment])
        for sensor in (0, 1):
            assert np.allclose(got[:, sensor], written[experiment, sensor][:1000])
    with pytest.raises(Exception, match="a sensor's sound file is missing in"):
        packages.read_sound(spark, str(tmp_path), (0, 1, 2)).collect()


def test_class_weights_leave_rows_in_their_tasks(spark):
    """A join by label would bring all rows of a label into one task."""
    from spindleflow.operators import learning

    df = spark.range(4000, numPartitions=8).select((F.col("id") % 10 == 0).cast("int").alias("y"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = learning.balanced(df, "y").groupBy(F.spark_partition_id()).agg(F.count("*"), F.sum("weight")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert [(r[1], round(r[2], 6)) for r in parts] == [(500, 500.0)] * 8


def test_cuts_that_differ_in_depth_only_share_a_scan(monkeypatch):
    cuts = {n: np.full((3000, 1), v) for n, v in zip(physics._INPUTS, (6000.0, 4, 0.01, 1e-4, 0.004, 7e8, 2.1e8, 0.8, 0.8, 1.55e7, 1.25e7, 80.0, 75.0, 0.0, math.pi))}
    cuts["rpm"] = cuts["rpm"] + 100.0 * (np.arange(3000) % 7)[:, None]
    cuts["ap"] = 1e-4 + 1e-7 * np.arange(3000)[:, None]
    whole, solved, solve = physics._solve(cuts), [], physics._solve
    monkeypatch.setattr(physics, "_solve", lambda c: solved.append(len(c["rpm"])) or solve(c))
    assert np.array_equal(physics._solve_in_blocks(cuts), whole)
    assert sum(solved) == 7


def test_a_low_that_many_rows_share_is_looked_up_once(spark, monkeypatch):
    from spindleflow.operators import runs

    rows = [(i, (i % 3) / 10.0, float((i * 7) % 5), (i * 11) % 6) for i in range(3000)] + [(3000, None, 1.0, 0), (3001, 0.1, None, 0), (3002, 0.1, 1.0, None)]
    df = spark.createDataFrame(rows, "id long, l double, h double, c long")
    seen, scan = [], runs.scan
    monkeypatch.setattr(runs, "scan", lambda d, *a, **k: seen.append(d.count()) or scan(d, *a, **k))
    found = {r["id"]: r["pareto_efficient"] for r in runs.pareto_front3(df, ["id"], "l", "h", "c").collect()}
    known = set(r[1:] for r in rows if None not in r)
    beaten = {(l, h, c) for l, h, c in known for a, b, d in known if a <= l and b >= h and d <= c and (a < l or b > h or d < c)}
    assert found.keys() == {r[0] for r in rows}
    assert all(found[r[0]] == (r[1:] not in beaten) for r in rows if None not in r)
    assert max(seen) < 200


def test_rows_of_files_are_numbered_in_place(spark, tmp_path):
    for name, n in (("a", 400), ("b", 3), ("c", 90)):
        csv_of(tmp_path / name / f"{name}.csv", ("v", "w"), [(i, i % 7) for i in range(n)])
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")  # long files are cut into blocks
    try:
        rows = tables.read_rows(spark, str(tmp_path))
        assert rows.select("_path", "_block").distinct().count() > 5
        whole = tables.in_file_order(rows, "n", stem=tables.stem(F.col("_path")))
        assert whole.columns == ["v", "w", "_path", "n", "stem"]
        assert sorted((r["stem"], r["n"], int(r["v"])) for r in whole.collect()) == [
            (name, i + 1, i) for name, n in (("a", 400), ("b", 3), ("c", 90)) for i in range(n)
        ]
        some = tables.in_file_order(rows.where("w <> 3"), "n", stem=tables.stem(F.col("_path")))
        assert sorted((r["n"], int(r["v"])) for r in some.where("stem = 'a'").collect()) == list(enumerate((i for i in range(400) if i % 7 != 3), 1))
        # Rows are neither sorted nor exchanged for it.
        assert "Window" not in whole._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
