"""From raw documents to encoded training text in five stages, each written as Parquet and read again.

Every stage takes ``(spark, docs, sf_dir)`` and works on all documents the one before it kept. All but the last return
the columns of ``documents``. NULL texts count as empty, rows of one id and one text as one document from the second
stage on (rows of one id and unlike texts as two), empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindleflow.llm import mixing, pieces, secret_scan, simhash, toxicity
from spindleflow.llm.common import staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below one half; the model is learnt from the table of labels."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return docs.where(toxicity.learn(docs, labels).column(docs) < 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near copies (five-word shingles, 0.8 or more).

    SimHash fingerprints propose what differs in few bits, by the generalised pigeonhole; bands of smallest values
    propose the rest. The shingles themselves decide."""
    return simhash.one_of_each_group(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mask and the number of characters counted anew."""
    masked = secret_scan.redacted(docs)
    return masked.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every document."""
    ids = docs.withColumn("piece_ids", pieces.encoded(F.col("text")))
    return ids.select("doc_id", "lang", "source", "n_chars", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("secrets", hide_secrets),
    ("mix", mix_sources),
    ("pieces", encode),
]

# Fitted models, XXH64 fingerprints and piece ids have no SQL; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
