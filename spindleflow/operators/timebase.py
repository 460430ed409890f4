"""Clock checks, source numbering, source caps and ingest summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindleflow.operators.metrics import count_if
from spindleflow.operators.quantiles import exact_quantiles
from spindleflow.operators.scan import Layout, Running, scan
from spindleflow.operators.staging import staged
from spindleflow.schema import LABELS

JITTER_LIMIT = 0.02  # fixed value


def timebase_summary(df: DataFrame, layout: Layout, time: str, by: tuple[str, ...]) -> DataFrame:
    """Rows, duration, rate 1/median(dt), jitter, and whether the clock strictly increases, per ``by``.

    ``layout`` gives the recording keys and the file order; steps never cross recordings.
    """
    steps = scan(
        df,
        list(layout.keys),
        layout.chunk(),
        layout.order,
        {"_prev": Running("last", F.col(time), inclusive=False)},
    ).select(*layout.keys, F.col(time).alias("t"), (F.col(time) - F.col("_prev")).alias("dt"))
    steps = staged(steps, "steps")
    totals = steps.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        (F.max("t") - F.min("t")).alias("duration_s"),
        (count_if(F.col("dt") <= 0) == 0).alias("increasing"),
    )
    median = staged(
        exact_quantiles(steps, {"dt": F.col("dt")}, [0.5], by).select(*by, F.col("value").alias("median_dt")), "median"
    )
    off = steps.join(median, list(by)).select(*by, F.abs(F.col("dt") - F.col("median_dt")).alias("off"))
    spread = exact_quantiles(off, {"off": F.col("off")}, [0.5], by).select(*by, F.col("value").alias("off"))
    out = totals.join(median, list(by), "left").join(spread, list(by), "left")
    return out.withColumns(
        {
            "rate_hz": F.try_divide(F.lit(1.0), F.col("median_dt")),
            "jitter": F.col("off") / F.greatest(F.col("median_dt"), F.lit(1e-12)),
        }
    ).withColumn("jitter_warning", F.col("jitter") > JITTER_LIMIT).drop("off", "median_dt")


def timebase_findings(summary: DataFrame, name: str, by: tuple[str, ...], min_rows: int = 4) -> DataFrame:
    """Validation rows (*by, severity, message) of a clock."""
    problems = F.array_compact(
        F.array(
            F.when(
                F.col("rows") < min_rows,
                F.struct(F.lit("error").alias("severity"), F.lit(f"{name} timebase needs at least {min_rows} rows").alias("message")),
            ),
            F.when(
                (F.col("rows") >= min_rows) & ~F.col("increasing"),
                F.struct(F.lit("error").alias("severity"), F.lit(f"{name} timebase must be strictly increasing").alias("message")),
            ),
            F.when(
                (F.col("rows") >= min_rows) & F.col("increasing") & F.col("jitter_warning"),
                F.struct(
                    F.lit("warning").alias("severity"),
                    F.format_string(f"{name} timebase jitter is %.3f; resample before high-confidence validation", F.col("jitter")).alias("message"),
                ),
            ),
        )
    )
    return summary.select(*by, F.inline(problems))


def dense_number(values: DataFrame, column: str, name: str) -> DataFrame:
    """0-based number of each row in the order of ``column``; give distinct values for a number per value.

    Rows are sorted by ranges that Spark samples, so values that all start alike spread like any others. Each row is
    numbered inside its part, and the parts, a row each, are numbered from their sizes.
    """
    sorted_rows = values.repartitionByRange(column).sortWithinPartitions(column)
    rows = staged(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33).alias("_part")
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    bases = sizes.select("_part", before.alias("_base"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = rows.withColumn("_part", F.shiftright("_at", 33)).join(bases, "_part")
    return placed.withColumn(name, F.col("_base") + inside).select(*values.columns, name)


def first_per_source(df: DataFrame, layout: Layout, k: int) -> DataFrame:
    """The first k rows of each source in source order: first k of each chunk, then first k of those.

    The ranking inside chunks spreads a long source; Spark limits each group before the exchange.
    """
    keys = [*layout.keys, "_chunk"]
    in_chunk = Window.partitionBy(*keys).orderBy(*layout.order)
    early = df.withColumn("_chunk", layout.chunk()).withColumn("_i", F.row_number().over(in_chunk)).where(F.col("_i") <= k)
    whole = Window.partitionBy(*layout.keys).orderBy(*layout.order)
    ranked = early.withColumn("position", F.row_number().over(whole)).where(F.col("position") <= k)
    return ranked.drop("_chunk", "_i")


def inspect_counts(df: DataFrame, by: tuple[str, ...], kind: str, kinds: list[str]) -> DataFrame:
    """Counts per source attribute, one column per kind."""
    return df.groupBy(*by).pivot(kind, kinds).agg(F.count(F.lit(1))).na.fill(0, kinds)


def ingest_summary(df: DataFrame, by: tuple[str, ...], label: str = "label") -> DataFrame:
    """Packages read, kept and skipped per source, with label counts of the kept ones."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("packages_read"),
        count_if(F.col(label) != "unknown").alias("packages_kept"),
        count_if(F.col(label) == "unknown").alias("packages_skipped"),
        *[count_if(F.col(label) == name).alias(name) for name in LABELS if name != "unknown"],
    )
