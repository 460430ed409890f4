"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the ids of whole documents in ascending document order:

    magic "PFOR1\\0\\0\\0", then little-endian: block length u32, percentile u32 (per mille), documents u64, ids u64,
    blocks u64, payload bytes u64
    document index   document id i64[d], id is NULL u8[d], number of ids u64[d]
    block index      payload offset u64[b], minimum u32[b], width u8[b], exceptions u16[b]
    payload          per block: ids less the minimum, packed at the block's width, 64 values in width words of 64 bits;
                     then the exceptions: place in the block u16[e], value less the minimum u32[e]

The width of a block is the one that a chosen share of its values needs (the percentile), or a larger one if that makes
the block shorter; values that need more bits are exceptions.
"""

from __future__ import annotations

import struct
import sys
import types
import zlib
from array import array
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindleflow.llm.common import shared_path, staged, text_chunks, tokenizer_path

MAGIC = b"PFOR1\0\0\0"
HEADER = "<8sIIQQQQ"


def bits_needed(values: np.ndarray) -> np.ndarray:
    """Bits of each unsigned value; zero needs none."""
    # Single precision holds integers of up to 24 bits; the exponent of zero is zero.
    exact = np.float32 if values.max(initial=0) < 1 << 24 else np.float64
    return np.frexp(values.astype(exact))[1].astype(np.uint8)


def choose_widths(bits: np.ndarray, percentile: float) -> np.ndarray:
    """The width of each row, from the bits its residuals need: from the percentile up, what makes the block shortest."""
    rows, length = bits.shape
    kinds = int(bits.max(initial=0)) + 1
    # How many values of each row need at most so many bits.
    within = np.bincount((np.arange(rows)[:, None] * kinds + bits).ravel(), minlength=rows * kinds).reshape(rows, kinds).cumsum(axis=1)
    best = (within <= min(length - 1, max(0, int(np.ceil(percentile * length)) - 1))).sum(axis=1).astype(np.uint8)
    least = best.copy()
    cost = np.full(len(best), np.iinfo(np.int64).max)
    for width in range(kinds):
        size = width * length + 48 * (length - within[:, width])
        better = (width >= least) & (size < cost)
        best, cost = np.where(better, width, best).astype(np.uint8), np.where(better, size, cost)
    return best


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values, a multiple of 64 each, as rows of 64-bit words."""
    rows, length = values.shape
    out = np.zeros((rows, length // 64, width), np.uint64)
    lanes = values.reshape(rows, length // 64, 64).astype(np.uint64)
    for place in range(64 if width else 0):
        word, shift = divmod(place * width, 64)
        out[:, :, word] |= lanes[:, :, place] << np.uint64(shift)
        if shift + width > 64:
            out[:, :, word + 1] |= lanes[:, :, place] >> np.uint64(64 - shift)
    return out.reshape(rows, length // 64 * width)


def _unpack(words: np.ndarray, width: int, length: int) -> np.ndarray:
    rows = len(words)
    out = np.zeros((rows, length // 64, 64), np.uint64)
    lanes = words.reshape(rows, length // 64, width)
    mask = np.uint64((1 << width) - 1)
    for place in range(64 if width else 0):
        word, shift = divmod(place * width, 64)
        value = lanes[:, :, word] >> np.uint64(shift)
        if shift + width > 64:
            value |= lanes[:, :, word + 1] << np.uint64(64 - shift)
        out[:, :, place] = value & mask
    return out.reshape(rows, length).astype(np.uint32)


def encode_file(doc_ids: list, counts: np.ndarray, ids: np.ndarray, block: int = 128, percentile: float = 0.9) -> bytes:
    """The bytes of one file. ``ids`` holds the ids of all documents, ``counts`` how many belong to each."""
    if block % 64:
        raise ValueError("the block length must be a multiple of 64")
    blocks = -(-len(ids) // block)
    padded = np.zeros(blocks * block, np.uint32)
    padded[: len(ids)] = ids
    if len(ids):
        padded[len(ids) :] = ids[-1]
    table = padded.reshape(blocks, block)
    least = table.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rest = table - least[:, None]
    bits = bits_needed(rest)
    widths = choose_widths(bits, percentile) if blocks else np.zeros(0, np.uint8)
    over = bits > widths[:, None]
    extra = over.sum(axis=1).astype(np.uint16)
    sizes = widths.astype(np.uint64) * np.uint64(block // 8) + extra.astype(np.uint64) * np.uint64(6)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.uint64)
    payload = np.zeros(int(starts[-1]), np.uint8)
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        if width:
            low = rest[rows] & np.uint32((1 << int(width)) - 1)
            packed = _pack(low, int(width)).astype("<u8").view(np.uint8)
            payload[starts[rows].astype(np.int64)[:, None] + np.arange(packed.shape[1])] = packed
    rows, places = np.nonzero(over)
    first, second = _exception_bytes(rows, starts, widths, extra, block)
    payload[first] = places.astype("<u2").view(np.uint8).reshape(-1, 2)
    payload[second] = rest[rows, places].astype("<u4").view(np.uint8).reshape(-1, 4)
    head = struct.pack(HEADER, MAGIC, block, round(percentile * 1000), len(doc_ids), len(ids), blocks, len(payload))
    parts = (
        np.array([0 if d is None else d for d in doc_ids], "<i8"),
        np.array([d is None for d in doc_ids], np.uint8),
        np.asarray(counts).astype("<u8"),
        starts[:-1].astype("<u8"),
        least.astype("<u4"),
        widths.astype(np.uint8),
        extra.astype("<u2"),
        payload,
    )
    return head + b"".join(p.tobytes() for p in parts)


def _exception_bytes(rows: np.ndarray, starts: np.ndarray, widths: np.ndarray, extra: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The payload bytes of each exception's place and of its value; ``rows`` names the blocks of the exceptions, in order."""
    held = extra.astype(np.int64)
    begin = starts[: len(widths)].astype(np.int64) + widths.astype(np.int64) * (block // 8)
    nth = np.arange(len(rows)) - (np.cumsum(held) - held)[rows]
    return (begin[rows] + 2 * nth)[:, None] + np.arange(2), (begin[rows] + 2 * held[rows] + 4 * nth)[:, None] + np.arange(4)


def decode_file(content: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, numbers of ids and all ids of a file."""
    magic, block, _, docs, total, blocks, size = struct.unpack_from(HEADER, content)
    if magic != MAGIC:
        raise ValueError("not a token block file")
    at = struct.calcsize(HEADER)

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(content, kind, count, at)
        at += out.nbytes
        return out

    names, missing, counts = take("<i8", docs), take("u1", docs), take("<u8", docs).astype(np.int64)
    starts, least = take("<u8", blocks).astype(np.int64), take("<u4", blocks)
    widths, extra, payload = take("u1", blocks), take("<u2", blocks), take("u1", size)
    out = np.zeros((blocks, block), np.uint32)
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        if width:
            at_bytes = starts[rows][:, None] + np.arange(int(width) * (block // 8))
            out[rows] = _unpack(payload[at_bytes].view("<u8"), int(width), block)
    rows = np.repeat(np.arange(blocks), extra)
    first, second = _exception_bytes(rows, starts, widths, extra, block)
    out[rows, payload[first].view("<u2").reshape(-1)] = payload[second].view("<u4").reshape(-1)
    out += least[:, None]
    return [None if m else int(d) for d, m in zip(names, missing)], counts, out.reshape(-1)[:total]


class WordEncoder:
    """Encodes texts with a tokenizer that treats white space as a mere separator, word by word, keeping what it saw.

    Words of common letters are cut by the tokenizer's own pattern and given to the library's model; all other words go
    through the library's whole chain. Equal to encoding each text whole, and many times faster where words repeat.
    """

    # The pattern by which the vocabulary's word splitter cuts a word.
    PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, keep: int = 400_000, keep_pieces: int = 700_000):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.keep, self.keep_pieces = Tokenizer.from_file(path), keep, keep_pieces
        self.model = self.tokenizer.model
        self.cut = regex.compile(self.PIECE).findall
        # Below U+0250 no letter changes under composition, and lower case is letter by letter. "<" may start a mark
        # that the vocabulary treats as one id.
        self.plain = regex.compile("[\x21-\x3b\x3d-\x7e\xa1-\u024f]+").fullmatch
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        # The model spells every byte as one visible letter.
        self.letters = {b: chr(256 + n) for n, b in enumerate(others)}
        self.pieces: dict[str, bytes] = {}
        self.clear()

    def clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.starts, self.sizes, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.uses = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Drop the words that one slice only has asked for; drop all if that leaves more than half."""
        stay = self.uses > 1
        if 2 * int(stay.sum()) > self.keep:
            self.clear()
            return
        words = [w for w, held in zip(self.codes, stay.tolist()) if held]  # codes are in the order of their numbers
        sizes = self.sizes[stay]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[stay] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
        self.codes = dict(zip(words, range(len(words))))
        self.pool, self.starts, self.sizes, self.uses = self.pool[at], ends - sizes, sizes, np.zeros(len(words), np.int64)

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            found = self.pieces[piece] = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return found

    def _ids(self, word: str) -> bytes:
        simple = word.isascii() and (word.isalpha() or (word[:-1].isalpha() and word[-1] in ".,"))
        if not simple and not self.plain(word):
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, np.uint32).tobytes()
        word = word.lower()
        known = self.pieces.get(word)
        if known is not None:
            return known
        if word.isalpha():
            return self._piece(word)
        if simple or (word[:-1].isalpha() and word[-1] in ".,"):
            return self._piece(word[:-1]) + self._piece(word[-1])
        return b"".join(map(self._piece, self.cut(word)))

    def _learn(self, words: list) -> None:
        if not words:
            return
        if len(self.pieces) > self.keep_pieces:
            self.pieces.clear()
        found = list(map(self._ids, words))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        self.codes.update(zip(words, range(len(self.codes), len(self.codes) + len(found))))
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.uses = np.concatenate([self.uses, np.zeros(len(found), np.int64)])
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(found), np.uint32)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each text has."""
        if len(self.codes) > self.keep:
            self._forget()
        # Words are told apart by Arrow: only distinct ones become objects and are looked up.
        split = pc.split_pattern(pa.array([t.replace("\n", " ") for t in texts], pa.string()), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn(list(filterfalse(self.codes.__contains__, words)))
        kinds = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        self.uses[kinds] += 1
        codes = kinds[coded.indices.to_numpy()]
        sizes = self.sizes[codes]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[codes] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        bounds = np.cumsum(split.value_lengths().to_numpy())
        per_text = np.diff(np.concatenate([[0], ends[bounds - 1]])) if len(split) else np.zeros(0, np.int64)
        return self.pool[at], per_text


def word_encoder(path: str) -> WordEncoder:
    """The encoder of this worker process; Spark reuses its workers, so later tasks find the words already known."""
    held = sys.modules.setdefault("spindleflow_worker_state", types.ModuleType("spindleflow_worker_state"))
    known = held.__dict__.setdefault("encoders", {})
    if path not in known:
        known[path] = WordEncoder(path)
    return known[path]


def _put(folder: str, name: str, content: bytes) -> None:
    """Write a file under a name of its own and rename it: a repeated task replaces it whole."""
    import uuid

    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    attempt = f"{path}/_{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(attempt) as out:
        out.write(content)
    system.move(attempt, f"{path}/{name}")


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, shard_ids: int = 2_000_000, block: int = 128,
    percentile: float = 0.9, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Encode every text, append ``end_id`` to each document and write files to ``folder`` in ascending id order.

    Rows are dealt by ranges of (id, hash of the text), so rows that repeat one id do not meet in one task unless they
    are equal. NULL texts count as empty, NULL ids come first. Returns one row per file: part, place in the part, name,
    documents and ids. A file closes once it holds ``shard_ids``; a document is never cut.
    """
    path = tokenizer_path(tokenizer)

    def run(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        encoder = word_encoder(path)
        names, counts, ids, held = [], [], [], 0

        def close():
            nonlocal names, counts, ids, held, seq
            name = f"part-{part:06d}-{seq:05d}.pfor"
            _put(folder, name, encode_file(names, np.concatenate(counts), np.concatenate(ids), block, percentile))
            row = pa.record_batch([[part], [seq], [name], [len(names)], [held]], schema=schema)
            names, counts, ids, held, seq = [], [], [], 0, seq + 1
            return row

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for begin, end in text_chunks(texts, 4_000_000):
                got, per_text = encoder.encode(texts[begin:end])
                bounds = np.cumsum(per_text)
                with_end = np.insert(got, bounds, np.uint32(end_id))
                names += keys[begin:end]
                counts.append(per_text + 1)
                ids.append(with_end)
                held += len(with_end)
                if held >= shard_ids:
                    yield close()
        if names:
            yield close()

    schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("name", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])
    # Folders are made by Spark's own file system, so that any store it reaches will do.
    spark = docs.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)
    slim = docs.select(F.col(id_column).cast("long").alias("k"), F.col(text_column).alias("t"))
    dealt = slim.repartitionByRange("k", F.xxhash64("t")).sortWithinPartitions("k", F.xxhash64("t"), "t")
    return staged(dealt.mapInArrow(run, "part long, seq long, name string, docs long, ids long"), "token-files")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the files: file name, place in the file, id, ids before it in the file, its number of ids
    and the crc32 of its ids as little-endian 32-bit integers."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                names, counts, ids = decode_file(content.as_py())
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist())]
                yield pa.record_batch(
                    [
                        pa.array([path.rsplit("/", 1)[-1]] * len(names), pa.string()),
                        pa.array(np.arange(len(names)), pa.int64()),
                        pa.array(names, pa.int64()),
                        pa.array(ends - counts, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(crcs, pa.int64()),
                    ],
                    names=["name", "place", "doc_id", "before", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder).select("path", "content")
    return files.mapInArrow(run, "name string, place long, doc_id long, before long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", folder: str | None = None, **options) -> DataFrame:
    """Write the token files of all documents, read them back and give each document's place in the whole stream.

    Columns: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, file. An empty table writes no file
    and gives no row; repeated rows are documents of their own.
    """
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "tokens")
    files = write_token_files(docs, folder, tokenizer, **options)
    # Starts come from two short levels: files within a part, and the totals of the parts.
    inside = F.sum("ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("ids")
    totals = files.groupBy("part").agg(F.sum("ids").alias("total"))
    bases = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    starts = files.select("name", "part", inside.alias("inside")).join(bases, "part")
    found = read_token_files(spark, folder).join(starts, "name")
    return found.select(
        "doc_id", (F.col("base") + F.col("inside") + F.col("before")).alias("start"), "n_tokens", "ids_crc32",
        F.col("name").alias("file"),
    )
