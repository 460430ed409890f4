"""Ordered running values that never put one whole group into one task.

A plain ``Window.partitionBy(key)`` sends a group to a single task, so one recording holding a third of all rows
would stall the job.  ``scan`` splits every group into ordered chunks:

1. summarise each (group, chunk) with a partially aggregated ``groupBy``;
2. run a window over the summaries only (one row per chunk) to get what each chunk inherits;
3. join the inherited value back and finish inside (group, chunk) windows.

Rows are exchanged once, by (group, chunk).  Step 3 reuses that partitioning for the windows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """How an ordered table is split: group keys, order columns, and the width of one chunk of ``time``."""

    keys: tuple[str, ...] = ("scenario", "episode")
    time: str = "start_time_s"
    tie: str = "window_id"
    span: float = 600.0

    @property
    def order(self) -> list[str]:
        return [self.time, self.tie]

    def chunk(self) -> Column:
        return F.floor(F.col(self.time) / F.lit(float(self.span))).cast("long")


@dataclass(frozen=True)
class Running:
    """One running value: ``sum``, ``max``, ``min`` or ``last`` (last non-null) of ``value``.

    ``inclusive`` counts the current row; ``whole`` gives the value over the entire group instead; ``reverse`` runs
    from the end of the group towards its start.
    """

    kind: str
    value: Column
    inclusive: bool = True
    whole: bool = False
    reverse: bool = False

    def summarise(self, order: list[str]) -> Column:
        if self.kind == "last":
            position = F.when(self.value.isNotNull(), F.struct(*[F.col(c) for c in order]))
            return (F.min_by if self.reverse else F.max_by)(self.value, position)
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.kind](self.value)

    def over(self, value: Column, window) -> Column:
        if self.kind == "last":
            return F.last(value, ignorenulls=True).over(window)
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.kind](value).over(window)

    def merge(self, inherited: Column, local: Column) -> Column:
        if self.kind == "last":
            return F.coalesce(local, inherited)
        if self.kind == "sum":
            return F.coalesce(inherited + local, inherited, local)
        return (F.greatest if self.kind == "max" else F.least)(inherited, local)


def scan(
    df: DataFrame,
    by: list[str],
    chunk: Column,
    order: list[str],
    outputs: dict[str, Running],
    coarse: Column | None = None,
) -> DataFrame:
    """Add one column per entry of ``outputs``; ``chunk`` must not decrease along ``order``.

    ``coarse`` (an expression over ``_fine``, the chunk) splits the summaries once more, for tables whose chunks are
    themselves many: the summaries are then scanned in the same way instead of in one window per group.
    """
    # A struct is never NULL and equals another with NULLs in the same places, so groups and times that are NULL meet
    # in the join as they do in a window; the windows below reuse the join's exchange.
    rows = df.withColumn("_key", F.struct(*[F.col(c) for c in by], chunk.alias("_chunk")))
    keys = [*by, "_chunk"]
    summary = rows.groupBy("_key").agg(*[run.summarise(order).alias(f"_s_{name}") for name, run in outputs.items()])
    summary = summary.select("_key.*", *[f"_s_{name}" for name in outputs])
    group = Window.partitionBy(*by)

    def earlier(run: Running):
        if run.whole:
            return group
        ahead = F.col("_chunk").desc() if run.reverse else F.col("_chunk").asc()
        return group.orderBy(ahead).rowsBetween(Window.unboundedPreceding, -1)

    if coarse is None:
        inherited = summary.select(
            *keys, *[run.over(F.col(f"_s_{name}"), earlier(run)).alias(f"_c_{name}") for name, run in outputs.items()]
        )
    else:
        upper = {
            f"_c_{name}": Running(run.kind, F.col(f"_s_{name}"), False, run.whole, run.reverse)
            for name, run in outputs.items()
        }
        inherited = scan(summary.withColumnRenamed("_chunk", "_fine"), by, coarse, ["_fine"], upper).select(
            *by, F.col("_fine").alias("_chunk"), *upper
        )

    def inside(run: Running):
        arrange = [F.col(c).desc() if run.reverse else F.col(c).asc() for c in order]
        return Window.partitionBy("_key").orderBy(*arrange).rowsBetween(
            Window.unboundedPreceding, 0 if run.inclusive else -1
        )

    carried_on = inherited.select(F.struct(*keys).alias("_key"), *[f"_c_{name}" for name in outputs])
    joined = rows.join(carried_on, "_key", "left")
    results = []
    for name, run in outputs.items():
        carried = F.col(f"_c_{name}")
        if run.whole:
            results.append(carried.alias(name))
        else:
            results.append(run.merge(carried, run.over(run.value, inside(run))).alias(name))
    keep = [c for c in df.columns if c not in outputs]
    return joined.select(*keep, *results)


def with_position(
    df: DataFrame,
    by: list[str],
    chunk: Column,
    order: list[str],
    position: str = "position",
    total: str | None = None,
    coarse: Column | None = None,
) -> DataFrame:
    """1-based rank inside each group, and optionally the group size."""
    outputs = {position: Running("sum", F.lit(1).cast("long"))}
    if total:
        outputs[total] = Running("sum", F.lit(1).cast("long"), whole=True)
    return scan(df, by, chunk, order, outputs, coarse)


def hash_chunk(column: str) -> Column:
    """Chunk of an md5 hex column: its first four digits (65,536 ordered chunks per group)."""
    return F.conv(F.substring(F.col(column), 1, 4), 16, 10).cast("long")


def seeded(seed: int, *parts: Column) -> Column:
    """md5 of ``seed|part|part``: the same order on every engine, no state to carry."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def unit_interval(digest: Column) -> Column:
    """Uniform [0, 1) from the first 32 bits of an md5 hex digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def one_row(df: DataFrame) -> Column:
    """A one-row result as a struct value (a scalar subquery): no join, evaluated once, inlined into the tasks."""
    return df.select(F.struct(*[F.col(c) for c in df.columns])).scalar()
