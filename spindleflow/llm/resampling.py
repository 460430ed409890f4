"""Importance resampling towards a target distribution over hashed features.

A feature is a run of one or more consecutive words; its bucket is the unsigned crc32 of its bytes modulo the number of
buckets. A text's words are found on its bytes as arrays. The distinct features of a slice are grouped by length into
matrices of bytes, one row each; all checksums of a matrix advance together, column by column, and go back to the
features' places. Features of more than ``BLOCK`` bytes are rows of equal blocks instead, joined by the linear map that
a block of zeros applies to a checksum.

Tasks count buckets, so an exchange carries at most one row for each bucket and task, and the table of gains (one number
for each bucket, whatever the corpus holds) is all that comes back to them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindleflow.llm.common import staged

BLOCK = 1024


def _crc_table() -> np.ndarray:
    """The checksum of each byte: the reflected polynomial of crc32, applied eight times."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


CRC = _crc_table()


def crc_columns(rows: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The state of each row's checksum after all its bytes (a matrix of uint8), from the states ``start``."""
    state = start.astype(np.uint32)
    for column in range(rows.shape[1]):
        state = CRC[(state ^ rows[:, column]) & np.uint32(255)] ^ (state >> np.uint32(8))
    return state


def _over_block() -> np.ndarray:
    """What a block of zero bytes makes of each bit of a state."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    return crc_columns(np.zeros((32, BLOCK), np.uint8), bits)


def crc_of_long(data: np.ndarray, shift: np.ndarray) -> int:
    """crc32 of one long run of bytes: its blocks advance together as rows of one matrix."""
    head = len(data) % BLOCK
    state = int(crc_columns(data[None, :head], np.array([0xFFFFFFFF]))[0])
    blocks = data[head:].reshape(-1, BLOCK)
    for begin in range(0, len(blocks), 4096):
        part = blocks[begin : begin + 4096]
        for own in crc_columns(part, np.zeros(len(part), np.uint32)).tolist():
            moved = np.bitwise_xor.reduce(shift[(state >> np.arange(32)) & 1 == 1], initial=np.uint32(0))
            state = int(moved) ^ own
    return state ^ 0xFFFFFFFF


def crc_buckets(starts: np.ndarray, lengths: np.ndarray, data: np.ndarray, buckets: int) -> np.ndarray:
    """crc32 modulo ``buckets`` of each feature, given by its place in ``data``."""
    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order], prepend=-1))
    for begin, end in zip(cuts, [*cuts[1:], len(order)]):
        size = int(lengths[order[begin]])
        if size > BLOCK:
            shift = _over_block()
            for place in order[begin:end]:
                out[place] = crc_of_long(data[starts[place] : starts[place] + size], shift)
            continue
        step = max(1, 8_000_000 // max(1, size))
        for at in range(begin, end, step):
            some = order[at : min(at + step, end)]
            rows = data[starts[some][:, None] + np.arange(size)]
            out[some] = crc_columns(rows, np.full(len(some), 0xFFFFFFFF, np.uint32)) ^ np.uint32(0xFFFFFFFF)
    return (out % np.uint32(buckets)).astype(np.int64)


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each byte, itself with A-Z in lower case, and whether it belongs to a word."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    inside = np.zeros(256, bool)
    inside[48:58] = inside[97:123] = inside[128:] = True
    return lower, inside


LOWER, INSIDE = _letters()


def binary_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of byte strings and where each row begins, as arrays over Arrow's own memory."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def row_slices(begins: np.ndarray, limit: int):
    """Ranges of whole rows of at most ``limit`` bytes together, one row at least."""
    first = 0
    while first < len(begins) - 1:
        last = max(first + 1, int(np.searchsorted(begins, begins[first] + limit, "right")) - 1)
        yield first, last
        first = last


def word_places(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words joined by spaces, and each word's end in them; the words that each row has."""
    lower = LOWER[data]
    inside = INSIDE[lower]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    fresh = begins[:-1][begins[:-1] < begins[1:]]
    opens[fresh] |= inside[fresh]
    starts = np.flatnonzero(opens)
    # Every word goes to its place with one space before it; the first space is cut off.
    at = np.cumsum(inside) + np.cumsum(opens) - 1
    out = np.full(int(at[-1]) + 1 if len(at) else 0, 32, np.uint8)
    out[at[inside]] = lower[inside]
    ends = np.append(at[starts[1:]] - 1, len(out)) if len(starts) else np.zeros(0, np.int64)
    return out, ends, np.diff(np.searchsorted(starts, begins))


def feature_slices(data: np.ndarray, begins: np.ndarray, runs: int, buckets: int, limit: int = 4_000_000, step: int = 1_000_000):
    """For slices of rows: their range, the words of each row, then its rows' numbers and buckets of features, in parts.

    Yields (first row, last row, words of each row, iterator of (row, bucket) arrays).
    """
    for first, last in row_slices(begins, limit):
        text, ends, words = word_places(data[begins[first] : begins[last]], begins[first : last + 1] - begins[first])
        heads = np.concatenate([[1], ends[:-1] + 1]) if len(ends) else ends
        row = np.repeat(np.arange(first, last), words)

        def parts():
            for size in range(1, runs + 1):
                for at in range(0, max(0, len(ends) - size + 1), step):
                    here = np.arange(at, min(at + step, len(ends) - size + 1))
                    here = here[row[here] == row[here + size - 1]]
                    begin, length = heads[here], ends[here + size - 1] - heads[here]
                    held = np.cumsum(length)
                    places = np.repeat(begin - (held - length), length) + np.arange(int(held[-1]) if len(held) else 0)
                    offsets = np.concatenate([[0], held]).astype(np.int32)
                    listed = pa.Array.from_buffers(pa.binary(), len(here), [None, pa.py_buffer(offsets), pa.py_buffer(text[places])])
                    coded = listed.dictionary_encode()
                    known, known_begins = binary_column(coded.dictionary)
                    found = crc_buckets(known_begins[:-1], np.diff(known_begins), known, buckets)
                    yield row[here], found[coded.indices.to_numpy()]

        yield first, last, words, parts()


def bucket_counts(docs: DataFrame, runs: int, buckets: int, text_column: str = "text") -> np.ndarray:
    """How many features of all rows fall in each bucket. NULL texts have none."""

    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for *_, parts in feature_slices(*binary_column(batch.column(0)), runs, buckets):
                for _, found in parts:
                    counts += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(some), pa.array(counts[some])], names=["bucket", "n"])

    slim = docs.select(F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("t"))
    summed = slim.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(buckets, np.int64)
    counts[summed["bucket"].to_numpy(np.int64)] = summed["n"].to_numpy(np.int64)
    return counts


def gains_of(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's smoothed share in the target over that in the raw data, floored."""
    more, s_all, t_all = len(raw), int(raw.sum()), int(target.sum())
    over = (target + 1.0) * float(s_all + more)
    under = (raw + 1.0) * float(t_all + more)
    return np.floor(1000 * np.log(over / under)).astype(np.int64)


def weights(docs: DataFrame, gains: np.ndarray, runs: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and weight (the floored mean of the gains of a row's features; none: 0) of every row."""
    buckets = len(gains)

    def run(batches):
        for batch in batches:
            data, begins = binary_column(batch.column(1))
            n_words, n, sums = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for first, last, words, parts in feature_slices(data, begins, runs, buckets):
                n_words[first:last] = words
                for row, found in parts:
                    n += np.bincount(row, minlength=len(n))
                    # Below 2**53 sums of whole doubles are exact.
                    sums += np.bincount(row, gains[found], len(n)).astype(np.int64)
            mean = np.where(n > 0, sums // np.maximum(n, 1), 0)
            yield pa.record_batch([batch.column(0), *map(pa.array, (n_words, n, mean))], names=["doc_id", "n_words", "n_features", "weight"])

    slim = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("t"))
    return slim.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def ranked(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """Adds rank: 1, 2, 3 ... by falling score (ties: smaller id, no id last) among the rows of at least ``least_words``
    words, as far as floor(percent * their number / 100); NULL for all other rows.

    Rows are sorted by ranges that Spark samples; each is numbered in its part, and the parts from their sizes.
    """
    dealt = scored.repartitionByRange(
        F.when(F.col("n_words") >= least_words, F.col("score")).desc_nulls_last(), F.col("doc_id").asc_nulls_last(), F.xxhash64("doc_id", "n_features")
    )
    inside = dealt.sortWithinPartitions(
        F.when(F.col("n_words") >= least_words, F.col("score")).desc_nulls_last(), F.col("doc_id").asc_nulls_last(), "n_features"
    )
    rows = staged(inside.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    drawn = F.col("n_words") >= least_words
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.when(drawn, 1)).alias("_n"))
    bases = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    place = F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    kept = drawn & (place <= F.floor(F.col("_all") * percent / 100))
    joined = rows.withColumn("_part", part).join(F.broadcast(bases), "_part")
    return joined.withColumn("rank", F.when(kept, place)).drop("_at", "_part", "_base", "_all")


def resample(
    docs: DataFrame, target: DataFrame, runs: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, least_words: int = 20,
    id_column: str = "doc_id", text_column: str = "text", target_text: str = "text",
) -> DataFrame:
    """Draw ``percent`` of the rows with ``least_words`` or more words, likelier the more their features look like the
    target's: weight plus Gumbel noise from a hash of the id, the highest first.

    Columns: doc_id, n_words, n_features, weight, score, rank (NULL where not drawn). NULL texts have no word and weigh
    0; repeated rows count, score and rank as rows of their own; a NULL id hashes as the empty text; an empty table
    gives no row, an empty target the weights of its smoothing. Other columns play no part.
    """
    gains = gains_of(bucket_counts(docs, runs, buckets, text_column), bucket_counts(target, runs, buckets, target_text))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    found = weights(docs, gains, runs, id_column, text_column).withColumn("score", F.col("weight") + noise)
    return ranked(found, percent, least_words).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def resample_sql(docs: str = "documents", target: str = "benchmark", buckets: int = 10_000, seed: int = 2024, percent: int = 10, least_words: int = 20) -> str:
    """The same for single words in DuckDB; crc32 is folded byte by byte over each distinct word."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH bits AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS step
  FROM (SELECT unnest(range(256)) AS i)),
d AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [NULL] ELSE w END) AS word FROM (SELECT doc_id, {words} AS w FROM {docs})),
b AS (SELECT unnest({words}) AS word FROM {target}),
spelled AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM (SELECT word FROM d UNION ALL SELECT word FROM b) WHERE word IS NOT NULL),
coded AS (
  SELECT word, xor(list_reduce(list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)),
    lambda c, x: xor(c >> 8, step[xor(c, x) % 256 + 1]), 4294967295), 4294967295) % {buckets} AS bucket
  FROM spelled, bits),
s AS (SELECT bucket, count(*) AS n_s FROM d JOIN coded USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n_t FROM b JOIN coded USING (word) GROUP BY 1),
g AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(n_t, 0) + 1.0::DOUBLE) * (all_s + {buckets}) / ((coalesce(n_s, 0) + 1.0::DOUBLE) * (all_t + {buckets})))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (bucket), (SELECT CAST(coalesce(sum(n_s), 0) AS DOUBLE) AS all_s FROM s), (SELECT CAST(coalesce(sum(n_t), 0) AS DOUBLE) AS all_t FROM t)),
w AS (
  SELECT doc_id, count(word) AS n_features, CAST(coalesce(floor(sum(gain)::DOUBLE / count(word)), 0) AS BIGINT) AS weight
  FROM d LEFT JOIN coded USING (word) LEFT JOIN g USING (bucket) GROUP BY doc_id),
n AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{seed}:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM w),
r AS (
  SELECT *, CASE WHEN n_features >= {least_words} THEN row_number() OVER (PARTITION BY n_features >= {least_words} ORDER BY score DESC, doc_id) END AS place,
    floor({percent} * count(CASE WHEN n_features >= {least_words} THEN 1 END) OVER () / 100) AS most FROM n)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= most THEN place END AS rank FROM r
"""
