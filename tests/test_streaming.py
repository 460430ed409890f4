"""Live operators: the same rows give the same result in any files and batches; late rows are told and counted."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindleflow.operators import sequence
from spindleflow.operators.scan import Layout
from spindleflow.operators.shadow import ShadowPolicy
from spindleflow.streaming import event_order

HOUR = 3_600_000_000
POLICY = ShadowPolicy(threshold=0.6, clear=0.45)


def samples(seed=3):
    """Three machines, one with most rows; silences over two days; NULL scores; a last row that moves the watermark."""
    rng, rows, n = random.Random(seed), [], 0
    for machine, count, pace in (("a", 400, HOUR // 2), ("b", 60, 4 * HOUR), (None, 30, 9 * HOUR)):
        us = rng.randrange(HOUR)
        for k in range(count):
            us += rng.randrange(1, pace)
            if k % 97 == 50:
                us += 60 * HOUR
            n += 1
            rows.append((machine, us, n, None if k % 41 == 7 else round(rng.random(), 3)))
    return rows + [("z", max(r[1] for r in rows) + 400 * HOUR, n + 1, 0.1)]


def expected(rows, closed):
    out, last = [], {}
    for machine, us, n, score in sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1], r[2])):
        if us >= closed:
            continue
        state = last.get(machine)
        if state and us - state[4] > 48 * HOUR:
            out.append((machine, None, state[4], None, False, 1.0, 1.0, "unknown"))
            state = None
        active, feed, spindle, mean, _ = state or (False, 1.0, 1.0, None, 0)
        if score is not None:
            active = True if score >= 0.6 else False if score <= 0.45 else active
            mean = score if mean is None else 0.35 * score + 0.65 * mean
        goal = (0.92, 1.04) if active else (1.0, 1.0)
        feed, spindle = (min(max(g, y - 0.05), y + 0.05) for g, y in zip(goal, (feed, spindle)))
        last[machine] = (active, feed, spindle, mean, us)
        out.append((machine, n, us, mean, active, feed, spindle, "live"))
    out += [(m, None, s[4], None, False, 1.0, 1.0, "unknown") for m, s in last.items() if s[4] + 48 * HOUR < closed]
    return out


def rounded(rows):
    return sorted((tuple("" if x is None else round(x, 7) if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("files", [1, 2, 10])
def test_recommendations_follow_event_order(spark, tmp_path, files):
    rows = samples()
    random.Random(files).shuffle(rows)
    # The newest row comes last, so none is late.
    rows.sort(key=lambda r: r[0] == "z")
    schema = "machine string, us long, window_id long, score double"
    for k in range(files):
        part = spark.createDataFrame(rows[k * len(rows) // files : (k + 1) * len(rows) // files], schema)
        part.withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found, _ = event_order.recommendations(stream, {"machine": "string"}, POLICY, delay="400 hours", span="30 hours")
    got = found.select("machine", "window_id", F.unix_micros("ts"), "score_ewma", "shadow_warning", "feed_override", "spindle_override", "state").collect()
    closed = (max(r[1] for r in rows) - 400 * HOUR) // (30 * HOUR) * 30 * HOUR
    assert rounded(map(tuple, got)) == rounded(expected(rows, closed))


def test_recommendations_equal_the_batch_operators(spark, tmp_path):
    rows = [(m, us, n, s) for m, us, n, s in samples(5) if s is not None and m]
    table = spark.createDataFrame(rows, "scenario string, us long, window_id long, score double")
    table = table.withColumns({"ts": F.timestamp_micros("us"), "episode": F.lit(1).cast("long"), "start_time_s": F.col("us") / 1e6})
    table.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")
    found, _ = event_order.recommendations(stream, {"scenario": "string", "episode": "long"}, POLICY, stale="9999 days", delay="1 hour", span="50 hours")
    layout = Layout(span=90_000.0)
    batch = sequence.hysteresis(table, layout, "score", 0.6, 0.45)
    batch = sequence.rate_limit(batch, layout, "shadow_warning", {"feed_override": (0.92, 0.80, 1.05, 0.05), "spindle_override": (1.04, 0.90, 1.10, 0.05)})
    want = {r.window_id: (r.shadow_warning, round(r.feed_override, 7), round(r.spindle_override, 7)) for r in batch.collect()}
    got = {r.window_id: (r.shadow_warning, round(r.feed_override, 7), round(r.spindle_override, 7)) for r in found.collect()}
    assert len(got) == len(rows) - 1 and all(want[k] == v for k, v in got.items())


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    rows = sorted(samples(9), key=lambda r: r[1])
    stream, base = None, f"{tmp_path}/base"
    for k in range(4):
        part = spark.createDataFrame(rows[k * len(rows) // 4 : (k + 1) * len(rows) // 4], "machine string, us long, window_id long, score double")
        part.withColumn("ts", F.timestamp_micros("us")).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
        found, _ = event_order.recommendations(stream, {"machine": "string"}, POLICY, delay="1 hour", span="30 hours", base=base)
    got = found.select("machine", "window_id", F.unix_micros("ts"), "score_ewma", "shadow_warning", "feed_override", "spindle_override", "state").collect()
    closed = (rows[-1][1] - HOUR) // (30 * HOUR) * 30 * HOUR
    assert rounded(map(tuple, got)) == rounded(expected(rows, closed))


def test_effects_compose():
    """A chunk's effect says what working off its rows gives, for any state before."""
    rules, rng = event_order.Recursion.of(POLICY, "2 days"), np.random.default_rng(2)
    for trial in range(300):
        n = int(rng.integers(1, 200))
        us = np.cumsum(rng.integers(1, 3 * HOUR if trial % 3 else 50 * HOUR, n)).astype(np.int64)
        scores = np.where(rng.random(n) < 0.1, np.nan, np.round(rng.random(n) * (0.3 if trial % 5 == 0 else 1), 2))
        state = (bool(trial % 2), float(rng.uniform(0.92, 1)), float(rng.uniform(1, 1.04)), math.nan if trial % 7 == 0 else float(rng.random()), int(-rng.integers(0, 80 * HOUR)))
        for before in (state, None):
            a = rules.after(before, rules.effect(us, scores), int(us[0]), int(us[-1]))
            b = rules.exit(us, scores, before)
            assert a[4] == us[-1] and np.allclose([float(x) for x in a[:4]], b, atol=1e-9, equal_nan=True)


def test_late_rows_are_told_by_the_watermark_they_meet(spark, tmp_path):
    """Rows late by window, against a loop; the state carries on over separate runs of the stream."""
    rng, parts = random.Random(1), []
    for k in range(5):
        parts.append([(n, (k * 600 - rng.choice([0, 0, 0, 900, 2_000]) + rng.randrange(600)) * 1_000_000) for n in range(50)] + [(99, None)])
    base, newest, want = f"{tmp_path}/out", None, []
    for number, part in enumerate(parts):
        spark.createDataFrame(part, "n long, us long").withColumn("ts", F.timestamp_micros("us")).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("n long, us long, ts timestamp").parquet(f"{tmp_path}/in")
        kept, late = event_order.separate_late(stream, base, "120 seconds", "60 seconds", delay="300 seconds")
        times = [us for _, us in part if us is not None]
        # The last of the sliding windows that hold a row ends two minutes after the row's own minute begins.
        want += [us for us in times if newest is not None and us // 60_000_000 * 60_000_000 + 120_000_000 <= newest - 300_000_000]
        newest = max(times + ([newest] if newest else []))
    assert sorted(r.us for r in late.collect()) == sorted(want) and want
    assert kept.count() + late.count() == sum(map(len, parts))
    assert kept.where("ts IS NULL").count() == len(parts)


def test_machines_of_a_group_share_a_state():
    import types

    import numpy as np
    import pandas as pd

    from spindleflow.operators.shadow import ShadowPolicy
    from spindleflow.streaming import event_order as order

    held, timers = [], []
    state = types.SimpleNamespace(appendValue=held.append, get=lambda: iter(held), clear=lambda: None)
    rules = order.Recursion.of(ShadowPolicy(threshold=0.6, clear=0.45), "2 days")
    chunks = order._Chunks(["m"], rules, 1_000_000)
    chunks.init(types.SimpleNamespace(getListState=lambda *a: state, registerTimer=timers.append))
    frame = pd.DataFrame({"m": ["b", None, "b", "a"], "us": [20, 5, 10, 30], "window_id": [1, 2, 3, 4], "score": [0.7, None, 0.1, 0.2]})
    list(chunks.handleInputRows((9, 0), iter([frame, frame.assign(us=frame["us"] + 100, window_id=frame["window_id"] + 10)]), None))
    (out,) = chunks.handleExpiredTimer((9, 0), types.SimpleNamespace(getCurrentWatermarkInMs=lambda: 7), None)
    found = {r["m"]: np.frombuffer(r["packed"], order._ROW) for r in out.to_dict("records")}
    assert set(timers) == {1000} and list(out["chunk"]) == [0, 0, 0]
    assert {k: v["id"].tolist() for k, v in found.items()} == {"b": [3, 1, 13, 11], None: [2, 12], "a": [4, 14]}
    assert found["b"]["us"].tolist() == [10, 20, 110, 120] and np.isnan(found[None]["score"]).all()
