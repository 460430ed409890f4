"""Time alignment: context interpolation, interval labels, interval cutting, membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindleflow.functions.labels import severity_of_label
from spindleflow.operators.scan import Running, scan
from spindleflow.schema import SEVERITY


def interpolate_context(
    samples: DataFrame, context: DataFrame, columns: list[str], keys: tuple[str, ...], time: str, tie: str, span: float
) -> DataFrame:
    """Linear interpolation of the context columns at each sample time, clamped at both ends.

    Every context row first learns the one after it, among context rows alone; of rows of one time the least counts. Then
    both tables become one ordered table in which the last context row is carried forward: samples, by far the more rows,
    are sorted once. No range join, no per-recording collection.
    """
    def chunk() -> Column:
        return F.floor(F.col(time) / F.lit(float(span))).cast("long")

    reading = F.struct(F.col(time).alias("t"), *[F.col(c) for c in columns])
    once = context.groupBy(*keys, time).agg(F.min(reading).alias("_lo"))
    near = {"_hi": Running("last", F.col("_lo"), False, reverse=True), "_prior": Running("last", F.lit(True), False)}
    linked = scan(once, list(keys), chunk(), [time], near)
    own = F.struct(F.lit(0).alias("_kind"), F.struct("_lo", F.coalesce("_hi", "_lo").alias("_hi")).alias("_r"))
    # The first row of all also stands before every sample.
    start = F.struct(F.lit(-1).alias("_kind"), F.struct(F.col("_lo"), F.col("_lo").alias("_hi")).alias("_r"))
    right = linked.select(*keys, time, F.inline(F.when(F.col("_prior").isNull(), F.array(start, own)).otherwise(F.array(own))))
    left = samples.withColumns({"_kind": F.lit(1), "_tie": F.col(tie).cast("long")})
    both = left.unionByName(right, allowMissingColumns=True)
    place = F.when(F.col("_kind") == -1, F.lit(-(1 << 62))).otherwise(chunk())
    rows = scan(both, list(keys), place, [time, "_kind", "_tie"], {"_r": Running("last", F.col("_r"))}).where("_kind = 1")
    lo, hi = F.col("_r._lo"), F.col("_r._hi")
    gap = hi["t"] - lo["t"]
    share = F.when(gap > 0, (F.col(time) - lo["t"]) / gap).otherwise(0.0)
    return rows.select(*samples.columns, *[(lo[c] + (hi[c] - lo[c]) * share).alias(c) for c in columns])


def interval_matches(
    points: DataFrame,
    intervals: DataFrame,
    keys: list[str],
    at: str,
    bucket: float,
    start: str = "interval_start",
    end: str = "interval_end",
    closed: bool = True,
) -> DataFrame:
    """Every (point, interval) pair with the point inside, by an equi-join on a time bucket.

    Each interval is copied to the buckets it touches, each point has one bucket: no nested loop, no broadcast that
    grows with the data, and one long recording is spread over its buckets.
    """
    width = F.lit(float(bucket))
    cut = intervals.withColumn(
        "_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width)))
    )
    placed = points.withColumn("_bucket", F.floor(F.col(at) / width))
    inside = (F.col(at) >= F.col(start)) & ((F.col(at) <= F.col(end)) if closed else (F.col(at) < F.col(end)))
    return placed.join(cut, [*keys, "_bucket"]).where(inside).drop("_bucket")


def label_windows(
    windows: DataFrame, intervals: DataFrame, keys: list[str], window_key: str, bucket: float, default: str = "unknown"
) -> DataFrame:
    """Label each window by the severest interval that contains its centre (both ends count).

    Centres and starts of intervals become one ordered table that carries the latest end of each severity, so no pair of
    a window and an interval is formed, however many intervals overlap.
    """
    centre = 0.5 * (F.col("start_time_s") + F.col("end_time_s"))
    points = windows.select(*keys, window_key, centre.alias("_at"), F.lit(1).alias("_kind"))
    marks = intervals.where("start_time_s IS NOT NULL AND end_time_s IS NOT NULL AND label IS NOT NULL").select(
        *keys,
        F.col("start_time_s").alias("_at"),
        F.lit(0).alias("_kind"),
        F.col("end_time_s").alias("_end"),
        severity_of_label(F.col("label")).alias("_severity"),
    )
    # Of the intervals of one severity that started by a centre, one contains it if the one that ends last does.
    ends = {f"_end{n}": Running("max", F.when(F.col("_severity") == severity, F.col("_end"))) for n, severity in enumerate(SEVERITY.values())}
    chunk = F.floor(F.col("_at") / F.lit(float(bucket))).cast("long")
    swept = scan(points.unionByName(marks, allowMissingColumns=True), keys, chunk, ["_at", "_kind"], ends).where("_kind = 1")
    severity = F.greatest(*[F.when(F.col(f"_end{n}") >= F.col("_at"), F.lit(v)) for n, v in enumerate(SEVERITY.values())])
    severest = swept.groupBy(*keys, window_key).agg(F.max(severity).alias("_severity"))
    label = F.coalesce(*[F.when(F.col("_severity") == v, F.lit(name)) for name, v in SEVERITY.items()])
    hits = severest.select(*keys, window_key, label.alias("_label"))
    rest = windows.drop("label", "label_id") if "label" in windows.columns else windows
    return rest.join(hits, [*keys, window_key], "left").withColumn(
        "label", F.coalesce("_label", F.lit(default))
    ).drop("_label")


def cut_by_interval(
    samples: DataFrame,
    intervals: DataFrame,
    label_rows: DataFrame,
    experiment: str,
    rate: Column,
    bucket: int,
    attributes: list[str],
) -> DataFrame:
    """Samples of cutting interval *i* become episode *i*; interval *i* takes label row *i* of its experiment.

    ``intervals`` and ``label_rows`` carry ``position``; sample bounds are ``[round(start*fs), round(end*fs))``.
    """
    bounds = intervals.join(
        label_rows.select(experiment, "position", *attributes), [experiment, "position"], "left"
    ).withColumns(
        {
            "interval_start": F.greatest(F.bround(F.col("start") * rate).cast("long"), F.lit(0).cast("long")),
            "interval_end": F.bround(F.col("end") * rate).cast("long"),
        }
    )
    hits = interval_matches(
        samples, bounds.drop("start", "end"), [experiment], "sample_idx", float(bucket), closed=False
    )
    return hits.withColumns(
        {
            "episode": F.col("position") - 1,
            "sample_idx": F.col("sample_idx") - F.col("interval_start"),
        }
    ).drop("position", "interval_start", "interval_end")


def join_recommendations(recs: DataFrame, windows: DataFrame) -> DataFrame:
    """Recommendations with their windows' other columns; a recommendation without a window fails the job."""
    extra = [c for c in windows.columns if c not in recs.columns]
    matched = recs.join(windows.select("window_id", *extra, F.lit(True).alias("_found")), "window_id", "left")
    checked = F.when(
        F.col("_found").isNull(),
        F.raise_error(F.concat(F.lit("no window for recommendation "), F.col("window_id").cast("string"))),
    ).otherwise(F.col("window_id"))
    return matched.withColumn("window_id", checked).drop("_found")


def require_known(requested: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Requested ids that do not exist; callers raise when this is not empty."""
    return requested.select(key).distinct().join(known.select(key), key, "left_anti")
