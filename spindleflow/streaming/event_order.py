"""Live recommendations in event order, whatever the order and the batches in which rows arrive.

1. ``ordered_chunks``: rows wait in the state of their time chunk and group of machines until the watermark passes the
   chunk's end; an event-time timer then puts them in order and emits each machine's chunk as one record: its rows,
   packed, and its effect. (A group shares one list and one timer, which cost more than the few rows of a machine.) The
   effect says what the chunk makes of the state in which a machine enters it, so nothing earlier has to be known yet.
2. ``fold``: for each micro-batch the effects of a machine (one small row a chunk) are applied in order to the state it
   had, which gives every chunk its entry state; then all chunks are worked off independently of each other. A long
   backlog of one machine thus spreads over as many tasks as it has chunks.

State per machine and micro-batch is stored under the batch's number: a batch that is run again starts from the same
state and replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from spindleflow.operators.sequence import EWMA_ALPHA
from spindleflow.operators.shadow import ShadowPolicy
from spindleflow.session import shared_folder
from spindleflow.sources.tables import fresh_path

NAN = float("nan")


@dataclass(frozen=True)
class Recursion:
    """The rules of one machine: hysteresis, two rate-limited overrides and the average of the score.

    A machine's state is (active, feed, spindle, average, time of its last row in microseconds). Scores that are NULL or
    not a number leave flag and average as they are.
    """

    on: float
    off: float
    stale_us: int
    axes: tuple  # low, high and step of each override
    alpha: float = EWMA_ALPHA
    start: tuple = field(default=(False, 1.0, 1.0, NAN))

    @staticmethod
    def of(policy: ShadowPolicy, stale: str) -> "Recursion":
        axes = []
        for target, (low, high), delta in (
            (policy.warning_feed, policy.feed_bounds, policy.max_feed_delta),
            (policy.warning_spindle, policy.spindle_bounds, policy.max_spindle_delta),
        ):
            if not low <= 1.0 <= high:
                raise ValueError("bounds must include 1.0")
            goal = min(max(target, low), high)
            axes.append((min(goal, 1.0), max(goal, 1.0), delta if goal >= 1.0 else -delta))
        clear = max(0.0, policy.threshold * 0.75) if policy.clear is None else policy.clear
        return Recursion(policy.threshold, clear, int(pd.Timedelta(stale).total_seconds() * 1e6), tuple(axes))

    def flags(self, scores: np.ndarray, active: bool) -> np.ndarray:
        switch = np.where(scores >= self.on, 1, np.where(scores <= self.off, 0, -1))
        last = np.maximum.accumulate(np.where(switch >= 0, np.arange(len(scores)), -1))
        return np.where(last >= 0, switch[last] == 1, active)

    def overrides(self, flags: np.ndarray, axis: tuple, value: float) -> np.ndarray:
        """Runs of equal flags move in equal steps, so each run is one expression."""
        low, high, step = axis
        out = np.empty(len(flags))
        cuts = np.flatnonzero(np.diff(flags)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(flags)]):
            move = step if flags[a] else -step
            out[a:b] = np.clip(value + move * np.arange(1, b - a + 1), low, high)
            value = float(out[b - 1])
        return out

    def averages(self, scores: np.ndarray, value: float, block: int = 64) -> np.ndarray:
        known = ~np.isnan(scores)
        x, keep = scores[known], 1.0 - self.alpha
        out, before, first = np.empty(len(x)), value, 0
        if len(x) and np.isnan(value):
            out[0] = value = float(x[0])
            first = 1
        for a in range(first, len(x), block):
            part = x[a : a + block]
            powers = keep ** np.arange(1, len(part) + 1)
            out[a : a + block] = powers * (value + np.cumsum(self.alpha * part / powers))
            value = float(out[a + len(part) - 1])
        return np.append(before, out)[np.cumsum(known)]

    def segments(self, us: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of rows between silences longer than ``stale_us``; each but the first starts anew."""
        cuts = np.flatnonzero(np.diff(us) > self.stale_us) + 1
        return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(us)]))

    def rows(self, us: np.ndarray, scores: np.ndarray, state: tuple | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]:
        """Averages, flags and overrides of ordered rows, and the times of the last rows before silences."""
        silent = []
        if state is not None and us[0] - state[4] > self.stale_us:
            silent.append(state[4])
            state = None
        parts = []
        for n, (a, b) in enumerate(self.segments(us)):
            if n:
                silent.append(int(us[a - 1]))
            active, feed, spindle, mean = (state if n == 0 and state is not None else self.start)[:4]
            flags = self.flags(scores[a:b], active)
            parts.append((self.averages(scores[a:b], mean), flags, self.overrides(flags, self.axes[0], feed), self.overrides(flags, self.axes[1], spindle)))
        return (*(np.concatenate([p[k] for p in parts]) for k in range(4)), silent)

    def exit(self, us: np.ndarray, scores: np.ndarray, state: tuple | None) -> list[float]:
        mean, flags, feed, spindle, _ = self.rows(us, scores, state)
        return [float(flags[-1]), float(feed[-1]), float(spindle[-1]), float(mean[-1])]

    def effect(self, us: np.ndarray, scores: np.ndarray) -> list[float]:
        """The state after the rows as a function of the state before: when started anew (4 numbers); then for either
        flag at the start the flag at the end and shift, low and high of each override (14); then factor and addend of
        the average (2), and whether the rows hold a silence (1), which makes all but the first four void."""
        anew = self.exit(us, scores, None)
        if len(self.segments(us)) > 1:
            return [*anew, *[0.0] * 16, 1.0]
        out = [*anew]
        for active in (False, True):
            flags = self.flags(scores, active)
            cuts = np.flatnonzero(np.diff(flags)) + 1
            out.append(float(flags[-1]))
            for low, high, step in self.axes:
                shift, least, most = 0.0, low, high
                for a, b in zip([0, *cuts], [*cuts, len(flags)]):
                    move, rest = (step if flags[a] else -step), b - a - 1
                    clip = lambda y: min(max(y, low), high)  # noqa: B023, E731
                    shift += move * (b - a)
                    # A run of n equal steps is one step of n times the length, within the bounds its first step met.
                    floor, ceiling = clip(low + move * rest), clip(high + move * rest)
                    least = min(max(least + move * (b - a), floor), ceiling)
                    most = min(max(most + move * (b - a), floor), ceiling)
                out += [shift, least, most]
        known = int((~np.isnan(scores)).sum())
        zero = self.averages(scores, 0.0)[-1]
        return [*out, (1.0 - self.alpha) ** known, float(zero), 0.0]

    def after(self, state: tuple | None, effect: list[float], first_us: int, last_us: int) -> tuple:
        """A machine's state after a chunk, from its state before and the chunk's effect."""
        if state is None or first_us - state[4] > self.stale_us or effect[20]:
            return (bool(effect[0]), effect[1], effect[2], effect[3], last_us)
        active, feed, spindle, mean, _ = state
        own = effect[4 + 7 * int(active) :]
        move = lambda y, k: min(max(y + own[k], own[k + 1]), own[k + 2])
        mean = effect[3] if np.isnan(mean) else effect[18] * mean + effect[19]
        return (bool(own[0]), move(feed, 1), move(spindle, 4), mean, last_us)


_ROW = np.dtype([("us", "<i8"), ("id", "<i8"), ("score", "<f8")])
_CHUNK = "chunk long, first_us long, last_us long, end_us long, mark_us long, effect array<double>, packed binary"
_STATE = "active boolean, feed double, spindle double, mean double, last_us long"
ROWS = (
    "window_id long, ts timestamp, score double, score_ewma double, shadow_warning boolean, feed_override double,"
    " spindle_override double, state string"
)


def _blob(frame: pd.DataFrame) -> bytes:
    batch, out = pa.RecordBatch.from_pandas(frame, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


class _Chunks(StatefulProcessor):
    """Rows of one (group of machines, chunk) in a list until the watermark passes the chunk's end."""

    def __init__(self, names: list[str], rules: Recursion, span_us: int):
        self.names, self.rules, self.span_us = names, rules, span_us

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("rows", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kinds = {"us": "int64", "window_id": "int64", "score": "float64"}
        for frame in rows:
            self.held.appendValue((_blob(frame[[*self.names, *kinds]].astype(kinds)),))
        self.handle.registerTimer((key[-1] + 1) * self.span_us // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        frames = [pa.ipc.open_stream(r[0]).read_pandas() for r in self.held.get()]
        self.held.clear()
        if not frames:
            return
        held = pd.concat(frames, ignore_index=True)
        machine = held.groupby(self.names, sort=False, dropna=False).ngroup().to_numpy()
        order = np.lexsort((held["window_id"], held["us"], machine))
        rows = np.empty(len(held), _ROW)
        for name, column in zip(_ROW.names, ("us", "window_id", "score")):
            rows[name] = held[column].to_numpy()[order]
        cuts = np.flatnonzero(np.diff(machine[order])) + 1
        records = held[self.names].iloc[order[[0, *cuts]]].to_dict("records")
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        for record, own in zip(records, np.split(rows, cuts)):
            record |= {
                "chunk": key[-1], "first_us": own["us"][0], "last_us": own["us"][-1], "end_us": (key[-1] + 1) * self.span_us,
                "mark_us": mark, "effect": self.rules.effect(own["us"], own["score"]), "packed": own.tobytes(),
            }
        yield pd.DataFrame(records)

    def close(self) -> None:
        pass


def ordered_chunks(stream: DataFrame, keys: dict[str, str], rules: Recursion, span: str, delay: str, shards: int = 4_096) -> DataFrame:
    """One record per closed (machine, chunk): its rows in order, packed, and its effect on a machine's state.

    Machines share the state of one of ``shards`` groups, told by a hash.
    """
    span_us = int(pd.Timedelta(span).total_seconds() * 1e6)
    # List state and timers need a state store that holds more than one column family.
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    us = F.unix_micros("ts")
    slim = stream.where(F.col("ts").isNotNull()).select(*keys, "ts", us.alias("us"), "window_id", "score")
    chunk = F.expr(f"us div {span_us} - CAST(us % {span_us} < 0 AS INT)").cast("long")
    # Keys travel as texts: a NULL would turn whole numbers into doubles in a frame.
    dealt = slim.withColumns({"shard": F.pmod(F.xxhash64(*keys), F.lit(shards)), "chunk": chunk, **{n: F.col(n).cast("string") for n in keys}})
    schema = ", ".join(f"{n} string" for n in keys) + ", " + _CHUNK
    closed = dealt.withWatermark("ts", delay).groupBy("shard", "chunk").transformWithStateInPandas(_Chunks(list(keys), rules, span_us), schema, "append", "eventTime")
    return closed.withColumns({n: F.col(n).cast(t) for n, t in keys.items()})


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the finished batches under a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    return sorted(int(s.getPath().getName()[6:]) for s in system.listStatus(path) if s.getPath().getName().startswith("batch="))


def fold(base: str, keys: dict[str, str], rules: Recursion, span: str) -> Callable[[DataFrame, int], None]:
    """What a micro-batch of chunks does: write its rows and the machines' states under its number."""
    names, kinds = list(keys), ", ".join(f"{n} {t}" for n, t in keys.items())
    span_us = int(pd.Timedelta(span).total_seconds() * 1e6)

    def enter(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Effects of each machine in order -> the state in which it enters each chunk, and its state at the end."""
        key, state, closed = None, None, -1

        def last():
            # Every row before the last closed chunk's end has been seen: a machine silent for so long is stale.
            stale = state[4] + rules.stale_us < closed
            return dict(zip(names, key)) | {"chunk": None, "kind": "stale" if stale else "state"} | dict(zip(("active", "feed", "spindle", "mean", "last_us"), state))

        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                here = tuple(row[n] for n in names)
                if here != key:
                    if key is not None and state is not None:
                        out.append(last())
                    key, state, closed = here, None, int(row["closed_us"])
                if pd.isna(row["chunk"]):
                    state = (bool(row["active"]), row["feed"], row["spindle"], row["mean"], int(row["last_us"]))
                    continue
                entry = state or (None, None, None, None, None)
                out.append(dict(zip(names, key)) | {"chunk": row["chunk"], "kind": "entry"} | dict(zip(("active", "feed", "spindle", "mean", "last_us"), entry)))
                state = rules.after(state, row["effect"], int(row["first_us"]), int(row["last_us"]))
            yield typed(out)
        if key is not None and state is not None:
            yield typed([last()])

    def typed(rows: list[dict]) -> pd.DataFrame:
        columns = [*names, "chunk", "kind", "active", "feed", "spindle", "mean", "last_us"]
        out = pd.DataFrame(rows, columns=columns)
        return out.astype({"chunk": "Int64", "last_us": "Int64", "active": "boolean", "feed": "float64", "spindle": "float64", "mean": "float64"})

    def recommend(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts, held = [], 0
            for row in frame.to_dict("records"):
                rows = np.frombuffer(row["packed"], _ROW)
                state = None if pd.isna(row["entry_us"]) else (bool(row["active"]), row["feed"], row["spindle"], row["mean"], int(row["entry_us"]))
                parts.append((row, rows, *rules.rows(rows["us"], rows["score"], state)))
                held += len(rows)
                if held >= 100_000:
                    yield made(parts)
                    parts, held = [], 0
            if parts:
                yield made(parts)

    def made(parts: list[tuple]) -> pd.DataFrame:
        """The rows of several chunks as one frame."""
        heads, packed, mean, flags, feed, spindle, silent = zip(*parts)
        rows = np.concatenate(packed)
        live = pd.DataFrame(
            {
                "window_id": pd.array(rows["id"], "Int64"), "ts": rows["us"].astype("datetime64[us]"), "score": rows["score"], "score_ewma": np.concatenate(mean),
                "shadow_warning": np.concatenate(flags), "feed_override": np.concatenate(feed), "spindle_override": np.concatenate(spindle), "state": "live",
            }
        )
        owner = np.repeat(np.arange(len(heads)), [len(p) for p in packed])
        if any(silent):
            live = pd.concat([live, _unknown([us for times in silent for us in times])], ignore_index=True)
            owner = np.concatenate([owner, np.repeat(np.arange(len(heads)), [len(times) for times in silent])])
        machines = pd.DataFrame([[h[n] for n in names] for h in heads], columns=names, dtype=object).iloc[owner].reset_index(drop=True)
        return pd.concat([machines, live], axis=1)

    def _unknown(times: list[int]) -> pd.DataFrame:
        n = len(times)
        return pd.DataFrame(
            {
                "window_id": pd.array([None] * n, "Int64"), "ts": np.array(times, np.int64).astype("datetime64[us]"), "score": [NAN] * n, "score_ewma": [NAN] * n,
                "shadow_warning": [False] * n, "feed_override": [1.0] * n, "spindle_override": [1.0] * n, "state": ["unknown"] * n,
            }
        )

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{base}/chunks/batch={number}")
        chunks = spark.read.schema(batch.schema).parquet(f"{base}/chunks/batch={number}")
        mark = chunks.agg(F.max("mark_us")).first()[0]
        if mark is None:
            return  # no chunk was closed
        closed = mark // span_us * span_us
        effects = chunks.select(*names, "chunk", "first_us", "last_us", "effect", *[F.lit(None).cast(t).alias(n) for n, t in (("active", "boolean"), ("feed", "double"), ("spindle", "double"), ("mean", "double"))])
        earlier = [n for n in _batches(spark, f"{base}/states") if n < number]
        if earlier:
            states = spark.read.schema(f"{kinds}, {_STATE}").parquet(f"{base}/states/batch={earlier[-1]}")
            effects = effects.unionByName(states.select(*names, F.lit(None).cast("long").alias("chunk"), F.lit(None).cast("long").alias("first_us"), "last_us", F.lit(None).cast("array<double>").alias("effect"), "active", "feed", "spindle", "mean"))
        ordered = effects.withColumn("closed_us", F.lit(closed)).repartition(*names).sortWithinPartitions(*names, F.col("chunk").asc_nulls_first())
        ordered.mapInPandas(enter, f"{kinds}, chunk long, kind string, {_STATE}").write.mode("overwrite").parquet(f"{base}/entries/batch={number}")
        entries = spark.read.parquet(f"{base}/entries/batch={number}")
        same = [F.col(f"c.{n}").eqNullSafe(F.col(f"e.{n}")) for n in (*names, "chunk")]
        joined = chunks.alias("c").join(entries.where("kind = 'entry'").alias("e"), same).select(
            *[F.col(f"c.{n}") for n in names], "c.packed", "e.active", "e.feed", "e.spindle", "e.mean", F.col("e.last_us").alias("entry_us")
        )
        rows = joined.mapInPandas(recommend, f"{kinds}, {ROWS}")
        for column in ("score", "score_ewma"):
            rows = rows.withColumn(column, F.nanvl(column, F.lit(None).cast("double")))
        stale = entries.where("kind = 'stale'").select(
            *names, F.lit(None).cast("long").alias("window_id"), F.timestamp_micros("last_us").alias("ts"), F.lit(None).cast("double").alias("score"),
            F.lit(None).cast("double").alias("score_ewma"), F.lit(False).alias("shadow_warning"), F.lit(1.0).alias("feed_override"), F.lit(1.0).alias("spindle_override"), F.lit("unknown").alias("state"),
        )
        rows.unionByName(stale).write.mode("overwrite").parquet(f"{base}/rows/batch={number}")
        entries.where("kind = 'state'").select(*names, "active", "feed", "spindle", "mean", "last_us").write.mode("overwrite").parquet(f"{base}/states/batch={number}")

    return work


def recommendations(
    stream: DataFrame, keys: dict[str, str], policy: ShadowPolicy, stale: str = "2 days", delay: str = "1 day", span: str = "5 days", base: str | None = None
) -> tuple[DataFrame, str]:
    """Run a stream of scores (``ts``, ``window_id``, ``score`` and the keys, with their types) over all there is.

    Returns the recommendations and the folder of their rows, which another stream may read. Rows appear once the
    watermark (``delay`` behind the newest row) has passed the end of their time chunk (``span``: choose it so that a
    machine's chunk holds some 100,000 rows at most); rows behind the watermark are dropped. A machine silent longer
    than ``stale`` gets one row of state ``unknown`` at the neutral overrides, at the time of its last row, and starts
    anew. The same rows give the same result in any number of files and batches, as long as none is late. With ``base``
    a stream goes on where it stopped. NULL times take no part.
    """
    spark = stream.sparkSession
    rules = Recursion.of(policy, stale)
    base = base or fresh_path(shared_folder(spark), "recommendations")
    chunks = ordered_chunks(stream, keys, rules, span, delay)
    writer = chunks.writeStream.outputMode("append").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(fold(base, keys, rules, span)).start().awaitTermination()
    schema = ", ".join(f"{n} {t}" for n, t in keys.items()) + ", " + ROWS
    if not _batches(spark, f"{base}/rows"):
        return spark.createDataFrame([], schema), f"{base}/rows"
    return spark.read.schema(schema).parquet(f"{base}/rows"), f"{base}/rows"


def split_late(base: str, size: str, slide: str | None, delay: str, ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """What a micro-batch does to tell late rows: those of which every window has ended behind the watermark, which is
    ``delay`` behind the newest row of the batches before. They are written to ``late`` and the others to ``kept``
    under the batch's number, with the watermark they met. (The engine's own filter may still let in what the newest
    batch alone has made late.)"""

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        earlier = [n for n in _batches(spark, f"{base}/marks") if n < number]
        mark = spark.read.schema("newest_us long").parquet(f"{base}/marks/batch={earlier[-1]}").first()[0] if earlier else None
        delay_us, step_us = (int(pd.Timedelta(x).total_seconds() * 1e6) for x in (delay, slide or size))
        us = F.unix_micros(ts)
        end = us - F.pmod(us, F.lit(step_us)) + int(pd.Timedelta(size).total_seconds() * 1e6)
        line = F.lit(None).cast("long") if mark is None else F.lit((mark - delay_us) // 1000 * 1000)
        late = F.coalesce(end <= line, F.lit(False))
        marked = batch.withColumn("watermark_us", line)
        marked.where(late).write.mode("overwrite").parquet(f"{base}/late/batch={number}")
        marked.where(~late).write.mode("overwrite").parquet(f"{base}/kept/batch={number}")
        newest = batch.agg(F.greatest(F.max(us), F.lit(mark).cast("long")).alias("newest_us"))
        newest.write.mode("overwrite").parquet(f"{base}/marks/batch={number}")

    return work


def separate_late(stream: DataFrame, base: str, size: str, slide: str | None = None, delay: str = "10 minutes", ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Run a stream over all there is and return its kept and its late rows, each with the watermark it met and the
    number of its micro-batch. Repeated calls with one ``base`` go on where the stream stopped. Rows without a time are
    never late."""
    spark = stream.sparkSession
    writer = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(split_late(base, size, slide, delay, ts)).start().awaitTermination()
    schema = stream.schema.add("watermark_us", "long").add("batch", "long")
    read = lambda name: spark.read.schema(schema).parquet(f"{base}/{name}") if _batches(spark, f"{base}/{name}") else spark.createDataFrame([], schema)
    return read("kept"), read("late")
