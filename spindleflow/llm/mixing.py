"""Mixing sources to target weights with built-in functions alone.

The words of every source are totalled, targets follow by filling sources in proportion to their weights up to a limit,
and each document is taken floor(rate) times, plus once more where a hash of its id falls below the rate's fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindleflow.llm.common import WORD, staged


def size_of(text_column: str = "text") -> Column:
    """Words of a text; NULL has none."""
    return F.coalesce(F.regexp_count(F.col(text_column), F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...], share: tuple[int, int], limit: int) -> DataFrame:
    """Target words of each source: columns source, source_size, target, rate.

    ``totals`` has one row for each source (source, source_size). Weights repeat over the sources in code point order,
    NULL last. All targets sum to ``share`` (a fraction) of all words; none exceeds ``limit`` times its source, what
    others give up is shared by weight until none is above. That is one level for all sources below their limit, found
    by sorting them by limit over weight: source k and all before it are at the limit if the level of the rest still
    reaches them. Sums stay whole numbers; only the last division is inexact.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    rank = F.row_number().over(order)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("long")
    weighed = totals.withColumn("weight", weight)
    # Compare limit * size / weight without dividing: sizes are scaled to the weights' common multiple.
    common = 1
    for w in weights:
        common *= w
    level = F.col("source_size") * F.lit(common) / F.col("weight")
    by_level = Window.orderBy(level, F.col("source").isNull(), F.col("source"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    filled = weighed.select(
        "source", "source_size", "weight",
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("held"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("gone"),
        F.sum("source_size").over(everything).alias("all_size"),
        F.sum("weight").over(everything).alias("all_weight"),
    )
    over, under = share
    # The level if exactly the sources before this one are at their limit; it holds at the first one it does not fill.
    top = F.lit(over) * F.col("all_size") - F.lit(under * limit) * F.col("held")
    bottom = F.lit(under) * (F.col("all_weight") - F.col("gone"))
    fits = F.col("level") * F.col("weight") <= F.lit(float(limit)) * F.col("source_size")
    levels = filled.withColumn("level", top / bottom).withColumn("fits", fits)
    found = levels.withColumn("found", F.min(F.when(F.col("fits"), F.struct("gone", "level"))).over(everything))
    target = F.least(F.col("source_size") * F.lit(float(limit)), F.col("found.level") * F.col("weight"))
    target = F.coalesce(target, F.col("source_size") * F.lit(float(limit)))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0))
    return found.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def copies(rate: Column, key: Column, seed: str = "mix") -> Column:
    """floor(rate), plus one where the first 32 bits of md5(seed|key) fall below the fraction; a NULL key is empty."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("")))), 1, 8), 16, 10)
    extra = draw.cast("double") / F.lit(4294967296.0) < rate - F.floor(rate)
    return (F.floor(rate) + extra.cast("long")).cast("long")


def source_rates(docs: DataFrame, weights=(3, 1, 2), share=(3, 2), limit: int = 2, source_column: str = "source", text_column: str = "text") -> DataFrame:
    """Sizes, targets and rates of the sources of ``docs``, written to the shared folder.

    One row for each source is left after the partial sums, so the two windows over them sort a summary, not documents;
    a source with a third of all rows is summed where its rows lie. The written table's size is known, so the planner
    broadcasts it only if it is small.
    """
    sized = docs.select(F.col(source_column).cast("string").alias("source"), size_of(text_column).alias("size"))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return staged(targets(totals, weights, share, limit), "source-rates")


def mix(docs: DataFrame, seed: str = "mix", id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", **options) -> DataFrame:
    """Every row with how often the mix takes it: id, size, source_size, target, copies, taken (words, repeats counted).

    NULL texts have size 0, NULL is a source of its own, empty tables give no row. Repeated rows draw alike, as they
    share an id. A source without words has target 0.
    """
    rates = source_rates(docs, source_column=source_column, text_column=text_column, **options).withColumnRenamed("source", "rate_source")
    slim = docs.select(F.col(id_column), F.col(source_column).cast("string").alias("its_source"), size_of(text_column).alias("size"))
    joined = slim.join(rates, F.col("its_source").eqNullSafe(F.col("rate_source")))
    times = copies(F.col("rate"), F.col(id_column), seed)
    return joined.select(id_column, "size", "source_size", "target", times.alias("copies"), (times * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: str = "mix", id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", **options) -> DataFrame:
    """The documents of the mix: every row as often as it is taken, with the columns of ``docs``."""
    rates = source_rates(docs, source_column=source_column, text_column=text_column, **options)
    rates = rates.select(F.col("source").alias("rate_source"), F.col("rate").alias("mix_rate"))
    row = docs.select(F.struct("*").alias("row"))
    joined = row.join(rates, F.col(f"row.{source_column}").cast("string").eqNullSafe(F.col("rate_source")))
    times = copies(F.col("mix_rate"), F.col(f"row.{id_column}"), seed)
    taken = joined.select("row", F.explode(F.array_repeat(F.lit(True), times.cast("int"))).alias("copy"))
    return taken.select("row.*")


def mix_sql(table: str = "documents", seed: str = "mix") -> str:
    """The same for DuckDB, with weights 3, 1, 2, 150% and limit 2."""
    return f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM {table}),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1] AS BIGINT) AS weight FROM totals),
filled AS (
  SELECT *, CAST(coalesce(sum(source_size) OVER o, 0) AS BIGINT) AS held, CAST(coalesce(sum(weight) OVER o, 0) AS BIGINT) AS gone,
    CAST(sum(source_size) OVER () AS BIGINT) AS all_size, CAST(sum(weight) OVER () AS BIGINT) AS all_weight
  FROM weighed
  WINDOW o AS (ORDER BY source_size * 6 / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (
  SELECT *, CAST(3 * all_size - 4 * held AS DOUBLE) / CAST(2 * (all_weight - gone) AS DOUBLE) AS level FROM filled),
found AS (SELECT arg_min(level, gone) AS level FROM levels WHERE level * weight <= 2.0::DOUBLE * source_size),
rates AS (
  SELECT l.source, l.source_size, coalesce(least(2.0::DOUBLE * l.source_size, f.level * l.weight), 2.0::DOUBLE * l.source_size) AS target
  FROM levels l, found f),
drawn AS (
  SELECT s.doc_id, s.size, r.source_size, r.target,
    CASE WHEN r.source_size > 0 THEN r.target / r.source_size ELSE 0 END AS rate,
    CAST(('0x' || substr(md5('{seed}|' || coalesce(CAST(s.doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS draw
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
  CAST((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM drawn
"""
