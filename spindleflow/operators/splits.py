"""Leak-free splits.  Every random choice is an md5 of seed and key, so it is the same on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindleflow.operators.scan import Layout, Running, hash_chunk, one_row, scan, seeded, with_position
from spindleflow.schema import EPISODE


def held_out(n: Column, fraction: float) -> Column:
    """max(1, min(n - 1, round half even(n f))); nothing when a stratum has one member or the fraction is 0."""
    if fraction == 0:
        return F.lit(0)
    wanted = F.greatest(F.lit(1), F.bround(n * fraction).cast("long"))
    return F.when(n <= 1, F.lit(0)).otherwise(F.least(wanted, n - 1))


def _finish(df: DataFrame, is_test: Column) -> DataFrame:
    return df.withColumn("split", F.when(is_test, F.lit("test")).otherwise(F.lit("train")))


def row_split(df: DataFrame, stratum: str, key: str, fraction: float, seed: int) -> DataFrame:
    """Stratified by ``stratum``: the rows with the smallest digests are test."""
    ranked = with_position(
        df.withColumn("_md5", seeded(seed, F.col(key))), [stratum], hash_chunk("_md5"), ["_md5"], "_rank", "_n"
    )
    return _finish(ranked, F.col("_rank") <= held_out(F.col("_n"), fraction)).drop("_md5", "_rank", "_n")


def grouped_split(
    df: DataFrame, fraction: float, seed: int, keys: tuple[str, ...] = EPISODE, strata: tuple[str, ...] = ("scenario",)
) -> DataFrame:
    """Whole groups go to one side; chosen per stratum over the distinct groups."""
    groups = df.select(*keys).distinct().withColumn("_md5", seeded(seed, *[F.col(k) for k in keys]))
    ranked = with_position(groups, list(strata), hash_chunk("_md5"), ["_md5"], "_rank", "_n")
    chosen = ranked.select(*keys, (F.col("_rank") <= held_out(F.col("_n"), fraction)).alias("_test"))
    return _finish(df.join(chosen, list(keys)), F.col("_test")).drop("_test")


def scenario_split(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    return grouped_split(df, fraction, seed, ("scenario",), ())


def time_block_split(df: DataFrame, layout: Layout, fraction: float) -> DataFrame:
    """The last windows of each episode are test; an episode of one window is train."""
    ranked = with_position(df, list(layout.keys), layout.chunk(), layout.order, "_rank", "_n")
    return _finish(ranked, F.col("_rank") > F.col("_n") - held_out(F.col("_n"), fraction)).drop("_rank", "_n")


def parameter_family_split(
    df: DataFrame, column: str, fraction: float, tail: str = "high", keys: tuple[str, ...] = EPISODE, parts: int = 256
) -> DataFrame:
    """Groups with the most extreme mean of ``column``, taken until the target share of windows, never all."""
    if column not in df.columns:
        raise ValueError(f"holdout column {column!r} is not in the window table")
    if tail not in ("high", "low"):
        raise ValueError("tail must be high or low")
    groups = df.groupBy(*keys).agg(F.avg(column).alias("_mean"), F.count(F.lit(1)).alias("_size"))
    totals = groups.agg(
        F.sum("_size").alias("_all"), F.count(F.lit(1)).alias("_groups"), F.min("_mean").alias("_lo"), F.max("_mean").alias("_hi")
    )
    sign = -1.0 if tail == "high" else 1.0
    name = F.concat_ws("::episode=", *[F.col(k).cast("string") for k in keys])
    spread = groups.withColumns(
        {"_key": F.round(F.col("_mean"), 12) * sign, "_name": name, "_of": one_row(totals)}
    )
    lo, hi = F.col("_of._lo"), F.col("_of._hi")
    part = F.floor((F.col("_key") - F.least(lo * sign, hi * sign)) / F.greatest(hi - lo, F.lit(1e-12)) * parts).cast("long")
    order = ["_key", "_name"]
    ordered = scan(
        spread,
        [],
        part,
        order,
        {
            "_before": Running("sum", F.col("_size"), inclusive=False),
            "_place": Running("sum", F.lit(1).cast("long")),
        },
    )
    target = F.greatest(F.lit(1), F.bround(F.col("_of._all") * fraction).cast("long"))
    taken = (
        (F.coalesce("_before", F.lit(0)) < target) & (F.col("_place") < F.col("_of._groups")) & F.lit(fraction > 0)
    )
    return _finish(df.join(ordered.select(*keys, taken.alias("_test")), list(keys)), F.col("_test")).drop("_test")


def with_fallback_test(df: DataFrame) -> DataFrame:
    """When nothing was held out, evaluate on the training rows: their copies are tagged test."""
    has_test = df.agg(F.max((F.col("split") == "test").cast("int")).alias("_has"))
    copies = df.where((F.col("split") == "train") & (has_test.scalar() == 0))
    return df.unionByName(copies.withColumn("split", F.lit("test")))


def validation_split(df: DataFrame, splitter, label: str) -> DataFrame:
    """Re-split the training rows with the same mode; validation is kept only if it leaves a usable fit set.

    ``splitter`` maps the training rows to the same rows with ``split`` in train/test.  Rows become ``fit``,
    ``validation`` or ``test``.  Dropped back to ``fit`` when fewer than three training rows exist, when nothing was
    held out, or when fewer than two labels would be left to fit.
    """
    inner = splitter(df.where(F.col("split") == "train").drop("split"))
    fit = F.col("split") == "train"
    guard = inner.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(~fit, 1)).alias("held"),
        F.count_distinct(F.when(fit, F.col(label))).alias("labels"),
    ).select(((F.col("n") >= 3) & (F.col("held") > 0) & (F.col("labels") >= 2)).alias("_usable"))
    named = inner.withColumn(
        "split", F.when(guard.scalar() & ~fit, F.lit("validation")).otherwise(F.lit("fit"))
    )
    return named.unionByName(df.where(F.col("split") == "test"))


def overlap(df: DataFrame, left: str, right: str, keys: tuple[str, ...]) -> DataFrame:
    """Groups present on both sides of a split; a leak-free split has none."""
    return (
        df.where(F.col("split") == left)
        .select(*keys)
        .intersect(df.where(F.col("split") == right).select(*keys))
    )


def split_report(df: DataFrame, keys: tuple[str, ...], value: str, time: str = "start_time_s") -> DataFrame:
    """Windows, groups, time range and value range per side; groups are counted after a map-side distinct."""
    per_group = df.groupBy("split", *keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(time).alias("t0"),
        F.max(time).alias("t1"),
        F.min(value).alias("v0"),
        F.max(value).alias("v1"),
    )
    return per_group.groupBy("split").agg(
        F.sum("n").alias("windows"),
        F.count(F.lit(1)).alias("groups"),
        F.min("t0").alias("start_s"),
        F.max("t1").alias("end_s"),
        F.min("v0").alias("value_min"),
        F.max("v1").alias("value_max"),
    )
