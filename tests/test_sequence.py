"""Chunked sequence operators against plain loops; one episode holds most of the rows."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindleflow.operators import align, quantiles, runs, sequence as seq, slicing
from spindleflow.operators.scan import Layout, Running, scan, with_position
from spindleflow.schema import SEVERITY

LAYOUT = Layout(span=2.0)
LABELS = ("stable", "transition", "slight", "severe", "unknown")


def episodes(seed=1, hot=400):
    """One hot episode, one of a single row, one with long silent gaps."""
    rnd = random.Random(seed)
    rows, wid = [], 0
    for episode, (n, gap) in enumerate(((hot, 0.1), (1, 1.0), (40, 5.0))):
        t = 0.0
        for _ in range(n):
            rows.append(("s", episode, wid, round(t, 3), rnd.choice(LABELS), rnd.random() * 10 + 0.1, rnd.random()))
            wid += 1
            t += gap * rnd.choice((1, 1, 2))
    return rows


COLS = "scenario string, episode long, window_id long, start_time_s double, label string, rms double, score double"


@pytest.fixture(scope="module")
def table(spark):
    rows = episodes()
    shuffled = rows[:]
    random.Random(3).shuffle(shuffled)
    return rows, spark.createDataFrame(shuffled, COLS)


def by_episode(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    return groups


def result(df, *columns):
    return {r["window_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_running_values(table):
    rows, df = table
    out = scan(
        df,
        ["scenario", "episode"],
        LAYOUT.chunk(),
        LAYOUT.order,
        {
            "total": Running("sum", F.col("rms")),
            "best": Running("max", F.col("rms"), inclusive=False),
            "next": Running("last", F.col("window_id"), inclusive=False, reverse=True),
            "last_t": Running("max", F.col("start_time_s"), whole=True),
        },
    )
    got = result(out, "total", "best", "next", "last_t")
    for group in by_episode(rows).values():
        values = [r[5] for r in group]
        for i, r in enumerate(group):
            total, best, nxt, last = got[r[2]]
            assert total == pytest.approx(sum(values[: i + 1]))
            assert best == (max(values[:i]) if i else None)
            assert nxt == (group[i + 1][2] if i + 1 < len(group) else None)
            assert last == group[-1][3]


def test_position_and_size(table):
    rows, df = table
    got = result(with_position(df, ["episode"], LAYOUT.chunk(), LAYOUT.order, "p", "n"), "p", "n")
    for group in by_episode(rows).values():
        for i, r in enumerate(group):
            assert got[r[2]] == (i + 1, len(group))


def test_chunks_of_chunks(table):
    rows, df = table
    everything = sorted(rows, key=lambda r: r[2])
    out = scan(
        df,
        [],
        F.floor(F.col("window_id") / 5).cast("long"),
        ["window_id"],
        {
            "total": Running("sum", F.col("rms")),
            "next": Running("last", F.col("rms"), inclusive=False, reverse=True),
            "top": Running("max", F.col("rms"), whole=True),
        },
        coarse=F.floor(F.col("_fine") / 7).cast("long"),
    )
    got = result(out, "total", "next", "top")
    values = [r[5] for r in everything]
    for i, r in enumerate(everything):
        total, nxt, top = got[r[2]]
        assert total == pytest.approx(sum(values[: i + 1])) and top == max(values)
        assert nxt == (values[i + 1] if i + 1 < len(values) else None)


def test_deltas_and_ewma(table):
    rows, df = table
    got = result(seq.temporal_deltas(df, LAYOUT, {"rms": "rms_delta"}), "rms_delta", "rms_growth_rate")
    smooth = result(seq.ewma(df, LAYOUT, ("rms",)), "rms_ewma")
    for group in by_episode(rows).values():
        before, level = None, None
        for r in group:
            delta, growth = got[r[2]]
            if before is None:
                assert (delta, growth) == (0.0, 0.0)
            else:
                assert delta == pytest.approx(r[5] - before[5])
                assert growth == pytest.approx((r[5] - before[5]) / max(r[3] - before[3], 1e-12))
            level = r[5] if level is None else 0.35 * r[5] + 0.65 * level
            assert smooth[r[2]][0] == pytest.approx(level, rel=1e-12)
            before = r


@pytest.mark.parametrize("alpha", [0.01, 0.05, 0.35, 0.9, 1.0])
@pytest.mark.parametrize("span", [0.1, 2.0, 1e9])
def test_ewma_for_any_alpha_and_chunk(table, alpha, span):
    """One long chunk, some chunks, and chunks of about one row each."""
    rows, df = table
    smooth = result(seq.ewma(df, Layout(span=span), ("rms",), alpha), "rms_ewma")
    for group in by_episode(rows).values():
        level = None
        for r in group:
            level = r[5] if level is None else alpha * r[5] + (1 - alpha) * level
            assert smooth[r[2]][0] == pytest.approx(level, rel=1e-12)


def test_scans_keep_groups_and_times_that_are_null_together(spark):
    rows = [(None, None if i < 3 else i / 10.0, i) for i in range(400)] + [("a", i / 10.0, 1000 + i) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, t double, i long")
    layout = Layout(("k",), "t", "i", 2.0)
    out = {r["i"]: (r["position"], r["n"]) for r in with_position(df, ["k"], layout.chunk(), layout.order, total="n").collect()}
    assert [out[i] for i in range(400)] == [(i + 1, 400) for i in range(400)]
    assert [out[1000 + i] for i in range(50)] == [(i + 1, 50) for i in range(50)]


@pytest.mark.parametrize("horizon", [0.25, 3.0])
def test_horizon_labels(table, horizon):
    rows, df = table
    out = seq.horizon_labels(df, LAYOUT, horizon)
    got = result(out, "horizon_label", "chatter_within_horizon", "future_chatter_within_horizon", "time_to_chatter_s", "label")
    for group in by_episode(rows).values():
        for i, r in enumerate(group):
            window = [c for c in group[i:] if c[3] - r[3] <= horizon + 1e-12]
            worst = max((c[4] for c in window), key=lambda label: SEVERITY[label])
            hot = [c for c in window if c[4] in ("slight", "severe")]
            future = [c for c in window[1:] if c[4] in ("slight", "severe")]
            label, now, later, wait, own = got[r[2]]
            assert label == worst and now == bool(hot) and later == bool(future)
            assert wait == pytest.approx(hot[0][3] - r[3] if hot else -1.0, abs=1e-8)
            assert SEVERITY[label] >= SEVERITY[own]


def test_hysteresis_and_rate_limit(table):
    rows, df = table
    warned = seq.hysteresis(df, LAYOUT, "score", 0.8, 0.3)
    targets = {"feed": (0.83, 0.80, 1.05, 0.05), "spindle": (1.2, 0.90, 1.10, 0.03)}
    got = result(seq.rate_limit(warned, LAYOUT, "shadow_warning", targets), "shadow_warning", "feed", "spindle")
    for group in by_episode(rows).values():
        on, y = False, {name: 1.0 for name in targets}
        for r in group:
            on = True if r[6] >= 0.8 else False if r[6] <= 0.3 else on
            assert got[r[2]][0] == on
            for i, (name, (target, low, high, delta)) in enumerate(targets.items()):
                goal = min(max(target if on else 1.0, low), high)
                step = min(max(goal, y[name] - delta), y[name] + delta)
                assert abs(step - y[name]) <= delta + 1e-12
                y[name] = step
                assert got[r[2]][1 + i] == pytest.approx(step, abs=1e-9)


def test_progress_stays_in_bounds(table):
    _, df = table
    values = [r[0] for r in seq.episode_progress(df, LAYOUT).select("episode_progress").collect()]
    assert min(values) == 0.0 and max(values) == 1.0


def test_interpolation_equals_numpy(spark):
    rnd = random.Random(5)
    t = sorted(round(rnd.uniform(0, 50), 3) for _ in range(60))
    c = sorted({round(rnd.uniform(5, 40), 2) for _ in range(12)})
    t[10] = c[3]  # a sample exactly on a context time
    t.sort()
    v = [rnd.random() for _ in c]
    samples = spark.createDataFrame([("r", x, i) for i, x in enumerate(t)], "run string, time_s double, sample_idx long")
    context = spark.createDataFrame([("r", x, y) for x, y in zip(c, v)], "run string, time_s double, level double")
    out = align.interpolate_context(samples, context, ["level"], ("run",), "time_s", "sample_idx", 3.0)
    got = {r["sample_idx"]: r["level"] for r in out.collect()}
    assert np.allclose([got[i] for i in range(len(t))], np.interp(t, c, v), atol=1e-12)


def test_intervals_closed_and_severest_wins(spark):
    windows = spark.createDataFrame([("r", i, float(i), float(i) + 1.0) for i in range(12)], "run string, window_id long, start_time_s double, end_time_s double")
    marks = spark.createDataFrame(
        [("r", 0.0, 3.5, "stable"), ("r", 3.5, 5.5, "slight"), ("r", 5.0, 9.0, "transition")],
        "run string, start_time_s double, end_time_s double, label string",
    )
    got = {r["window_id"]: r["label"] for r in align.label_windows(windows, marks, ["run"], "window_id", 2.0).collect()}
    assert [got[i] for i in range(12)] == ["stable"] * 3 + ["slight"] * 3 + ["transition"] * 3 + ["unknown"] * 3


def test_exact_quantiles(spark):
    rnd = random.Random(2)
    rows = [("a", rnd.gauss(0, 1)) for _ in range(3000)] + [("b", float(rnd.randint(0, 3))) for _ in range(501)] + [("c", 4.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.0, 0.25, 0.5, 0.95, 0.997, 1.0]
    out = quantiles.exact_quantiles(df, {"x": F.col("x")}, probs, ("g",))
    got = {(r["g"], r["prob"]): r["value"] for r in out.collect()}
    for g in "abc":
        values = [x for k, x in rows if k == g]
        for p in probs:
            assert got[g, p] == pytest.approx(float(np.quantile(values, p)), abs=1e-12)


def test_sketch_brackets_hold_the_ranks(spark, monkeypatch):
    """Brackets from the sketch, not the whole range."""
    monkeypatch.setattr(quantiles, "NARROW", 0)
    df = spark.range(250_000).select((F.hash("id") / 1000.0).alias("x"), F.lit(1).alias("g"))
    values = np.array([r[0] for r in df.select("x").collect()])
    out = quantiles.exact_quantiles(df, {"x": F.col("x")}, [0.25, 0.5, 0.99], ("g",))
    got = {r["prob"]: r["value"] for r in out.collect()}
    for p in (0.25, 0.5, 0.99):
        assert got[p] == pytest.approx(float(np.quantile(values, p)), rel=1e-12)


def test_pareto_fronts(spark):
    rnd = random.Random(9)
    rows = [(i, "s", round(rnd.random(), 1), round(rnd.random(), 1), rnd.randint(0, 4)) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, scenario string, r double, m double, c long")
    two = {x["id"]: x["pareto_efficient"] for x in runs.pareto_front(df, ["scenario"], "r", "m", parts=4).collect()}
    three = {x["id"]: x["pareto_efficient"] for x in runs.pareto_front3(df, ["id"], "r", "m", "c", parts=4).collect()}
    for i, _, r, m, c in rows:
        beaten2 = any(a <= r and b >= m and (a < r or b > m) for _, _, a, b, _ in rows)
        beaten3 = any(a <= r and b >= m and d <= c and (a < r or b > m or d < c) for _, _, a, b, d in rows)
        assert two[i] == (not beaten2)
        assert three[i] == (not beaten3)


def test_front_with_large_counts(spark):
    rows = [(0, 0.1, 0.9, 0), (1, 0.2, 0.8, 2**33), (2, 0.1, 0.95, 2**62), (3, 0.3, 0.95, 2**62 - 1)]
    df = spark.createDataFrame(rows, "id long, r double, m double, c long")
    got = {x["id"]: x["pareto_efficient"] for x in runs.pareto_front3(df, ["id"], "r", "m", "c").collect()}
    assert got == {0: True, 1: False, 2: True, 3: True}
    with pytest.raises(Exception, match="must not be negative"):
        runs.pareto_front3(spark.createDataFrame([(0, 0.1, 0.9, -1)], df.schema), ["id"], "r", "m", "c").collect()


def test_slices_cover_full_windows_only(spark):
    n, size, hop = 53, 8, 3
    samples = spark.createDataFrame([("s", 0, i, i / 10.0, [float(i)]) for i in range(n)], "scenario string, episode long, sample_idx long, time_s double, ch array<double>")
    out = {r["window_index_in_episode"]: r for r in slicing.slice_samples(samples, size, hop).collect()}
    starts = range(0, n - size + 1, hop)
    assert sorted(out) == list(range(len(starts)))
    for k, s in enumerate(starts):
        assert [c[0] for c in out[k]["sensor_window"]] == [float(i) for i in range(s, s + size)]
        assert math.isclose(out[k]["end_time_s"], (s + size - 1) / 10.0)
    with pytest.raises(ValueError):
        slicing.window_samples(0.2, 0.1, 10.0)


@pytest.mark.parametrize(("size", "hop"), [(8, 3), (5, 7), (700, 40)])
def test_windows_of_several_blocks_with_gaps(spark, size, hop):
    kept = [i for i in range(4000) if i % 911 != 500 and not 2000 <= i < 2100]
    rows = [("s", 0, i, i / 10.0, [float(i)], float(i % 13), 7) for i in kept]
    schema = "scenario string, episode long, sample_idx long, time_s double, ch array<double>, load double, teeth int"
    samples = spark.createDataFrame(rows, schema).repartition(5)
    held = set(kept)
    whole = [w for w in range(4000) if all(w * hop + j in held for j in range(size))]
    for given in ((size, hop), (F.lit(size), F.lit(hop))):
        out = {r["window_index_in_episode"]: r for r in slicing.slice_samples(samples, *given, ("teeth",), ("load",)).collect()}
        assert sorted(out) == whole
        for w in whole[:: max(1, len(whole) // 50)]:
            covered = range(w * hop, w * hop + size)
            assert [c[0] for c in out[w]["sensor_window"]] == [float(i) for i in covered]
            assert math.isclose(out[w]["load"], sum(i % 13 for i in covered) / size) and out[w]["teeth"] == 7
            assert math.isclose(out[w]["start_time_s"], w * hop / 10.0)


def test_overlapping_intervals_make_no_pairs(spark):
    rng = np.random.default_rng(8)
    names = ["unknown", "stable", "transition", "slight", "severe"]
    marks = [(f"r{k % 2}", s, s + d, names[int(c)]) for k, (s, d, c) in enumerate(zip(rng.integers(0, 60, 300) / 2, rng.integers(-2, 12, 300) / 2, rng.integers(0, 5, 300)))]
    rows = [(f"r{k % 3}", k, k / 8, k / 8 + 0.5) for k in range(300)]
    windows = spark.createDataFrame(rows, "run string, w long, start_time_s double, end_time_s double")
    intervals = spark.createDataFrame([(r, float(a), float(b), n) for r, a, b, n in marks], "run string, start_time_s double, end_time_s double, label string")
    found = align.label_windows(windows, intervals, ["run"], "w", 7.0, "none")
    want = {}
    for run, w, a, b in rows:
        held = [names.index(n) for r, s, e, n in marks if r == run and s <= (a + b) / 2 <= e]
        want[w] = names[max(held)] if held else "none"
    assert {r["w"]: r["label"] for r in found.collect()} == want
    # Intervals are not copied to buckets that windows join.
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_interpolation_sorts_the_samples_once(spark):
    samples = spark.createDataFrame([("a", k / 4, k) for k in range(80)] + [("b", 3.0, 0), ("c", 1.0, 0)], "run string, time_s double, sample_idx long")
    context = spark.createDataFrame([("a", 5.0, 1.0), ("a", 5.0, 2.0), ("a", 9.0, 4.0), ("b", 7.0, 6.0)], "run string, time_s double, level double")
    out = align.interpolate_context(samples, context, ["level"], ("run",), "time_s", "sample_idx", 3.0)
    got = {(r["run"], r["sample_idx"]): r["level"] for r in out.collect()}
    assert got["b", 0] == 6.0 and got["c", 0] is None
    assert np.allclose([got["a", k] for k in range(80)], np.interp(np.arange(80) / 4, [5.0, 9.0], [1.0, 4.0]), atol=1e-12)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_tie#" in plan and not re.search(r"_tie#\d+L? DESC", plan)
