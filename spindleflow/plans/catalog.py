"""Registry of the queries this engine answers on the shared tables, each with its SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; its result gets plain types and doubles rounded as in the SQL."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            # The tables hold wall-clock timestamps; SQL twins read them as UTC.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return tidy(build(spark, folder))

        run.__name__ = name
        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql:
            SQL[name] = sql.strip()
        return build

    return register


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    out = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            col = F.round(col.cast("double"), digits) + F.lit(0.0)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            col = col.cast("long")
        out.append(col.alias(field.name))
    return df.select(*out)


def pick(keys: str = "", real: str = "", whole: str = "", digits: int = 6) -> str:
    """SQL select list matching ``tidy``: keys as they are, reals rounded, wholes as BIGINT."""
    parts = keys.replace(",", " ").split()
    parts += [f"round({c}, {digits}) + 0.0 AS {c}" for c in real.replace(",", " ").split()]
    parts += [f"CAST({c} AS BIGINT) AS {c}" for c in whole.replace(",", " ").split()]
    return ", ".join(parts)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")
