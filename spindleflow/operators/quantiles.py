"""Exact, linearly interpolated quantiles without sorting a whole group in one task.

Spark's exact ``percentile`` keeps every distinct value of a group in one aggregation buffer.  Here a mergeable sketch
brackets each wanted rank, everything outside the brackets is counted, and only bracketed values are ranked.  Two
passes over the input, whatever its size; the two small results in between are staged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindleflow.operators.scan import Running, scan
from spindleflow.operators.staging import staged

ACCURACY = 20_000
NARROW = 100_000  # below this many values the margin is less than a few ranks, so a bracket spans the whole range


def exact_quantiles(
    df: DataFrame, columns: dict[str, Column], probs: list[float], by: tuple[str, ...] = ()
) -> DataFrame:
    """Rows ``(*by, name, prob, value)``; NULLs are left out, values equal a linear-interpolation quantile."""
    keys = [*by, "name"]
    cells = F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("v")) for n, c in columns.items()])
    long = df.select(*by, F.inline(cells)).where(F.col("v").isNotNull())
    margin = 2.0 / ACCURACY
    edges = [min(max(p + side * margin, 0.0), 1.0) for p in probs for side in (-1, 1)]
    sketch = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("v").alias("least"),
        F.max("v").alias("most"),
        F.percentile_approx("v", edges, ACCURACY).alias("edges"),
    )
    few = F.col("n") <= NARROW
    brackets = staged(
        sketch.select(
            *keys,
            "n",
            F.array(
                *[
                    F.struct(
                        F.when(few, F.col("least")).otherwise(F.col("edges")[2 * i]).alias("lo"),
                        F.when(few, F.col("most")).otherwise(F.col("edges")[2 * i + 1]).alias("hi"),
                    )
                    for i in range(len(probs))
                ]
            ).alias("brackets"),
        ),
        "brackets",
    )
    placed = long.join(brackets.drop("n"), keys)
    inside = F.exists("brackets", lambda b: (F.col("v") >= b["lo"]) & (F.col("v") <= b["hi"]))
    below = F.array_max(F.transform("brackets", lambda b: F.when(b["hi"] < F.col("v"), b["hi"])))
    # Chunks: which bracket edges lie below, then a 64-way split of the bracket; both grow with v.
    part = F.aggregate(
        "brackets",
        F.lit(0).cast("long"),
        lambda acc, b: acc
        + F.when(F.col("v") < b["lo"], F.lit(0))
        .when(F.col("v") >= b["hi"], F.lit(65))
        .otherwise(1 + F.floor(F.lit(63.0) * (F.col("v") - b["lo"]) / F.greatest(b["hi"] - b["lo"], F.lit(1e-300))))
        .cast("long"),
    )
    counted = staged(
        placed.select(
            *keys,
            part.alias("part"),
            F.when(inside, F.col("v")).otherwise(F.coalesce(below, F.lit(float("-inf")))).alias("v"),
            (~inside).alias("skip"),
        )
        .groupBy(*keys, "part", "v", "skip")
        .agg(F.count(F.lit(1)).alias("c")),
        "ranks",
    )
    ranked = scan(counted, keys, F.col("part"), ["v", "skip"], {"upto": Running("sum", F.col("c"))})
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    rank = F.floor(F.col("prob") * (F.col("n") - 1))
    picks = (
        ranked.select(*keys, "v", "upto")
        .join(brackets.select(*keys, "n", F.explode(wanted).alias("prob")), keys)
        .groupBy(*keys, "prob", "n")
        .agg(
            F.min(F.when(F.col("upto") > rank, F.col("v"))).alias("a"),
            F.min(F.when(F.col("upto") > rank + 1, F.col("v"))).alias("b"),
        )
    )
    share = F.col("prob") * (F.col("n") - 1) - rank
    value = F.col("a") + (F.coalesce("b", "a") - F.col("a")) * share
    return picks.select(*keys, "prob", value.alias("value"))


def spread_of(
    df: DataFrame, columns: dict[str, Column], floor: float, by: tuple[str, ...] = ()
) -> DataFrame:
    """Rows ``(*by, name, median, scale)`` with scale = max(1.4826 MAD, IQR / 1.349, floor)."""
    keys = [*by, "name"]
    quartiles = staged(
        exact_quantiles(df, columns, [0.25, 0.5, 0.75], by)
        .groupBy(*keys)
        .agg(
            F.max(F.when(F.col("prob") == 0.5, F.col("value"))).alias("median"),
            (
                F.max(F.when(F.col("prob") == 0.75, F.col("value")))
                - F.max(F.when(F.col("prob") == 0.25, F.col("value")))
            ).alias("iqr"),
        ),
        "quartiles",
    )
    cells = F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("v")) for n, c in columns.items()])
    deviations = (
        df.select(*by, F.inline(cells))
        .join(quartiles.select(*keys, "median"), keys)
        .select(*keys, F.abs(F.col("v") - F.col("median")).alias("d"))
    )
    mad = exact_quantiles(deviations.withColumnRenamed("name", "_name"), {"mad": F.col("d")}, [0.5], (*by, "_name"))
    mad = mad.select(*by, F.col("_name").alias("name"), F.col("value").alias("mad"))
    return quartiles.join(mad, keys).select(
        *keys,
        "median",
        F.greatest(F.lit(1.4826) * F.col("mad"), F.col("iqr") / F.lit(1.349), F.lit(float(floor))).alias("scale"),
    )
