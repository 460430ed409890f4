"""Streaming queries, run over the events table with an available-now trigger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindleflow.operators.shadow import ShadowPolicy
from spindleflow.plans.catalog import query, read
from spindleflow.session import shared_folder
from spindleflow.sources.tables import fresh_path
from spindleflow.streaming import event_order as order
from spindleflow.streaming import live


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = read(spark, folder, "events").schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(folder)
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )


@query(
    "x1_live_features",
    """WITH s AS (SELECT user_id, epoch_us(ts) AS us, value FROM events),
    w AS (SELECT user_id, value, unnest(range(us // 43200000000 * 43200000000 - 43200000000, us // 43200000000 * 43200000000 + 1, 43200000000)) AS st FROM s),
    m AS (SELECT max(us) - 86400000000 AS mark FROM s)
    SELECT user_id, st AS start_us, count(*) AS samples, round(sqrt(avg(value * value)), 6) AS rms, max(abs(value)) AS peak
    FROM w CROSS JOIN m WHERE st + 86400000000 <= mark GROUP BY user_id, st""",
)
def x1(spark: SparkSession, folder: str) -> DataFrame:
    features = live.feature_windows(event_stream(spark, folder), ["user_id"], "value", "1 day", "12 hours", "1 day")
    rows = live.drain(features, "features")
    return rows.select("user_id", F.unix_micros("window_start").alias("start_us"), "samples", "rms", "peak")


@query(
    "x1_live_sessions",
    """WITH s AS (SELECT user_id, epoch_us(ts) AS us, value, CASE WHEN epoch_us(ts) < lag(epoch_us(ts)) OVER o + 43200000000 THEN 0 ELSE 1 END AS opens FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
    n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS number FROM s),
    g AS (SELECT user_id, number, min(us) AS start_us, max(us) + 43200000000 AS end_us, count(*) AS samples, round(sqrt(avg(value * value)), 6) AS rms FROM n GROUP BY 1, 2)
    SELECT user_id, start_us, end_us, samples, rms FROM g WHERE end_us <= (SELECT max(epoch_us(ts)) FROM events) - 86400000000""",
)
def x1_sessions(spark: SparkSession, folder: str) -> DataFrame:
    sessions = live.session_features(event_stream(spark, folder), ["user_id"], "value", "12 hours", "1 day")
    rows = live.drain(sessions, "sessions")
    return rows.select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "samples", "rms")


@query(
    "x2_live_context",
    """WITH s AS (SELECT user_id, event_id, ts FROM events WHERE event_type <> 'view'), c AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view'),
    m AS (SELECT least((SELECT max(ts) FROM s), (SELECT max(ts) FROM c)) - INTERVAL 1 DAY AS mark),
    j AS (SELECT s.event_id, s.ts, arg_max(c.value, c.ts) AS context_value FROM s LEFT JOIN c ON s.user_id = c.user_id AND c.ts <= s.ts AND c.ts >= s.ts - INTERVAL 12 HOUR GROUP BY s.event_id, s.ts)
    SELECT event_id, context_value FROM j CROSS JOIN m WHERE date_trunc('second', j.ts) + INTERVAL 1 SECOND <= m.mark - INTERVAL 12 HOUR""",
)
def x2(spark: SparkSession, folder: str) -> DataFrame:
    events = event_stream(spark, folder)
    samples = events.where("event_type <> 'view'").select("user_id", "event_id", "ts")
    context = event_stream(spark, folder).where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("context_value"))
    joined = live.enrich(samples, context, "user_id", "event_id", ["context_value"], "12 HOURS", "1 day")
    return live.drain(joined, "context").select("event_id", "context_value")


# Rows before the end of the last time chunk that the watermark has passed; a silence over two days starts anew.
_LIVE_SQL = """WITH RECURSIVE m AS (SELECT (epoch_ms(max(ts)) - 86400000) // 432000000 * 432000000 AS closed FROM events),
  g AS (SELECT user_id, event_id, ts, value / 500e0 AS score, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 172800000000 THEN 0 ELSE 1 END AS opens
    FROM events CROSS JOIN m WHERE epoch_us(ts) < closed * 1000),
  n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM g),
  o AS (SELECT *, row_number() OVER w AS rn, coalesce(last_value(CASE WHEN score >= 0.6e0 THEN TRUE WHEN score <= 0.45e0 THEN FALSE END IGNORE NULLS) OVER w, FALSE) AS warn
    FROM n WINDOW w AS (PARTITION BY user_id, run ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  r AS (SELECT user_id, run, event_id, ts, rn, warn, score AS ewma, CASE WHEN warn THEN 0.95e0 ELSE 1e0 END AS feed, CASE WHEN warn THEN 1.04e0 ELSE 1e0 END AS spindle FROM o WHERE rn = 1
    UNION ALL SELECT o.user_id, o.run, o.event_id, o.ts, o.rn, o.warn, 0.35e0 * o.score + 0.65e0 * r.ewma,
      greatest(least(CASE WHEN o.warn THEN 0.92e0 ELSE 1e0 END, r.feed + 0.05e0), r.feed - 0.05e0),
      greatest(least(CASE WHEN o.warn THEN 1.04e0 ELSE 1e0 END, r.spindle + 0.05e0), r.spindle - 0.05e0) FROM o JOIN r ON o.user_id = r.user_id AND o.run = r.run AND o.rn = r.rn + 1),
  e AS (SELECT user_id, run, max(ts) AS last_ts, run < max(run) OVER (PARTITION BY user_id) AS followed FROM o GROUP BY user_id, run)"""


def live_recommendations(spark: SparkSession, folder: str) -> tuple[DataFrame, str]:
    stream = event_stream(spark, folder).select(
        "user_id", "ts", F.col("event_id").alias("window_id"), (F.col("value") / 500.0).alias("score")
    )
    return order.recommendations(stream, {"user_id": "long"}, ShadowPolicy(threshold=0.6, clear=0.45))


@query(
    "x3_live_recommendations",
    f"""{_LIVE_SQL}
    SELECT user_id, event_id AS window_id, warn AS shadow_warning, round(ewma, 4) AS score_ewma, round(feed, 6) AS feed_override, round(spindle, 6) AS spindle_override, 'live' AS state FROM r
    UNION ALL SELECT user_id, NULL, FALSE, NULL, 1e0, 1e0, 'unknown' FROM e CROSS JOIN m WHERE followed OR epoch_us(last_ts) + 172800000000 < closed * 1000""",
)
def x3(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = live_recommendations(spark, folder)
    return rows.select(
        "user_id", "window_id", "shadow_warning", F.round("score_ewma", 4).alias("score_ewma"), "feed_override", "spindle_override", "state"
    )


@query(
    "x4_live_burden",
    f"""{_LIVE_SQL} SELECT epoch_us(date_trunc('day', ts)) AS start_us, count(*) AS windows, count(*) FILTER (warn) AS warning_windows,
      count(*) FILTER (abs(feed - 1e0) > 1e-9 OR abs(spindle - 1e0) > 1e-9) AS action_windows FROM r GROUP BY 1""",
)
def x4(spark: SparkSession, folder: str) -> DataFrame:
    stored, path = live_recommendations(spark, folder)
    # The recommendations table is itself a stream source for the burden job.
    again = spark.readStream.schema(stored.schema).parquet(path).where("state = 'live'")
    burden = live.drain(live.rolling_burden(again, "1 day"), "burden", ("window_start",))
    return burden.select(F.unix_micros("window_start").alias("start_us"), "windows", "warning_windows", "action_windows")


ARRIVALS = 6


@query(
    "x1_late_rows",
    f"""WITH a AS (SELECT event_id, epoch_us(ts) AS us, event_id * {ARRIVALS} // (SELECT max(event_id) + 1 FROM events) AS arrival FROM events),
    n AS (SELECT arrival, max(us) AS newest FROM a GROUP BY 1), m AS (SELECT arrival, (max(newest) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) // 1000 * 1000 AS mark FROM n)
    SELECT arrival, count(*) AS samples, count(*) FILTER (us // 60000000 * 60000000 + 60000000 <= mark) AS late_samples, max(mark) AS watermark_us FROM a JOIN m USING (arrival) GROUP BY arrival""",
)
def x1_late(spark: SparkSession, folder: str) -> DataFrame:
    """The events arrive in the order of their ids, which is not quite that of their times; windows of one minute."""
    events = read(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = events.agg(F.max("event_id") + 1).first()[0]
    base = fresh_path(shared_folder(spark), "arrivals")
    dealt = events.withColumn("arrival", F.expr(f"event_id * {ARRIVALS} div {last}"))
    for number in range(ARRIVALS):
        dealt.where(F.col("arrival") == number).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(dealt.schema).parquet(f"{base}/in")
        kept, late = order.separate_late(stream, f"{base}/out", "1 minute", delay="0 seconds")
    tag = lambda rows, is_late: rows.select("arrival", "watermark_us", F.lit(is_late).alias("late"))
    both = tag(kept, 0).unionByName(tag(late, 1))
    return both.groupBy("arrival").agg(F.count(F.lit(1)).alias("samples"), F.sum("late").alias("late_samples"), F.max("watermark_us").alias("watermark_us"))
