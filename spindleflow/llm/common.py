"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindleflow.session import shared_folder

# A word is a run of characters other than space and the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the driver and all executors reach."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: computed once, kept when an executor is lost."""
    path = shared_path(df.sparkSession, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tokenizer_path(name: str) -> str:
    """The place of an installed public vocabulary file; a path is taken as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def crc32_of(column: str) -> Column:
    """crc32 of a column's text, as an unsigned long; NULL counts as empty."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def text_slices(texts, limit: int = 1_000_000):
    """Cut an Arrow array of texts into lists of at most ``limit`` characters (one text at least): begin, end, texts.

    Only one list at a time is made of Python objects; the array itself may hold many times as much."""
    import pyarrow.compute as pc

    begin, held = 0, 0
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).tolist()
    for place, size in enumerate([*sizes, limit]):
        if place > begin and (place == len(sizes) or held + size > limit):
            yield begin, place, texts.slice(begin, place - begin).to_pylist()
            begin, held = place, 0
        held += size


def text_chunks(values: list, limit: int = 2_000_000):
    """Split a list of texts into slices of at most ``limit`` characters (one text at least)."""
    begin, held = 0, 0
    for place, value in enumerate(values):
        size = len(value)
        if held and held + size > limit:
            yield begin, place
            begin, held = place, 0
        held += size
    if begin < len(values):
        yield begin, len(values)
