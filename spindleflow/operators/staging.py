"""Staged intermediate tables."""

import uuid

from pyspark.sql import DataFrame

from spindleflow.session import shared_folder


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a table to the shared folder and read it back.

    Used where a result feeds several consumers (or the next stage of a job): it is computed once, survives the loss
    of executors, and its file size lets the planner choose between broadcast and shuffle for later joins.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_in_buckets(df: DataFrame, key: str, buckets: int, name: str = "buckets") -> DataFrame:
    """Write a table to the shared folder in sorted buckets of ``key`` and read it back.

    A join on ``key`` then moves only its other side, into the same buckets. Rows are not exchanged for it: every task
    writes a file for each bucket it meets, so keep tasks x buckets in bounds.
    """
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{table}"
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)
