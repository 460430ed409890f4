"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindleflow.llm import centroids, lexicon, merkle, mixing, ngram_trie, onebit, page_text, pieces, resampling, secret_scan, simhash, token_blocks, toxicity
from spindleflow.plans.catalog import read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql:
            SQL[name] = sql.strip()
        return build

    return add


@register("op1_token_blocks")
def op1_token_blocks(spark, folder):
    """Every document encoded, written as block files and read back."""
    return token_blocks.encode_documents(read(spark, folder, "documents"))


@register("op6_simhash")
def op6_simhash(spark, folder):
    """Fingerprints of four-word shingles and their components at four or fewer differing bits."""
    found = simhash.near_groups(read(spark, folder, "documents"), words=4, max_bits=4)
    digits = F.lower(F.lpad(F.hex("f0"), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), "component_id")


@register("op7_toxicity")
def op7_toxicity(spark, folder):
    """A toxicity score for every document, learnt from the labelled rows."""
    return toxicity.score_documents(read(spark, folder, "documents"), read(spark, folder, "labels"))


@register("op3_mix_sources", mixing.mix_sql())
def op3_mix_sources(spark, folder):
    """How often each document enters a mix in which sources weigh 3, 1, 2 and total 150% of all words."""
    return mixing.mix(read(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@register("op8_secret_scan")
def op8_secret_scan(spark, folder):
    """Secrets of every document: the exact patterns, and runs that pass the randomness battery."""
    return secret_scan.report(read(spark, folder, "documents"))


@register("op4_sentencepiece")
def op4_sentencepiece(spark, folder):
    """The piece ids of every document, and whether decoding gives the text back."""
    return pieces.encode_documents(read(spark, folder, "documents"))


@register("op2_merkle")
def op2_merkle(spark, folder):
    """Merkle fingerprints of every document and of its edit, and their likeness."""
    return merkle.compare_with_next(read(spark, folder, "documents"))


@register("op5_page_text")
def op5_page_text(spark, folder):
    """The main text of every page."""
    return page_text.main_text(read(spark, folder, "pages"))


@register("op10_one_bit_codes", onebit.search_sql())
def op10_one_bit_codes(spark, folder):
    """The ten nearest vectors of every hundredth one."""
    return onebit.search(read(spark, folder, "embeddings"))


@register("op9_ngram_trie")
def op9_ngram_trie(spark, folder):
    """Unigram and trie scores of every document."""
    return ngram_trie.score_documents(read(spark, folder, "documents"))


@register("op11_resampling", resampling.resample_sql())
def op11_resampling(spark, folder):
    """A tenth of the documents drawn towards the distribution of the benchmark's words."""
    found = resampling.resample(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@register("op12_centroids", centroids.cluster_sql())
def op12_centroids(spark, folder):
    """Eight clusters of the embeddings after ten rounds."""
    return centroids.cluster(read(spark, folder, "embeddings"))[0]


@register("op13_lexicon")
def op13_lexicon(spark, folder):
    """The ids of every document through the lexicon of frequent words, and their text again."""
    return lexicon.encode_documents(read(spark, folder, "documents"))
