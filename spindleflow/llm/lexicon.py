"""Byte-pair encoding through a minimal acyclic transducer of frequent words, and decoding.

A word is what the tokenizer's own cutting leaves after its normalisation. Words are counted over all texts; the most
frequent ones, a bounded number, are encoded by their merges and compiled into an automaton that shares beginnings and
endings. Its arcs carry numbers whose sum along a word is the word's place in the lexicon, and that place holds the
word's ids (and how its ids and pieces are spelled, so that no text is put together id by id). The file is written to the
shared folder, handed to every executor once and memory-mapped by its workers; all words of a slice walk it together,
letter by letter. A word it does not hold is merged exactly, pair by pair in the order of the ranks.

Texts are cut on their bytes as arrays. A run between white space that has letters beyond Latin-1 or may hold a special
token is cut by the library's own normaliser and splitter instead; it joins the others as one unit.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindleflow.llm.common import shared_path, staged, tokenizer_path
from spindleflow.llm.ngram_trie import map_arrays
from spindleflow.llm.resampling import binary_column
from spindleflow.llm.token_blocks import _put

# The parts of a tokenizer file that this operator follows.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALISERS = ["NFC", "Replace", "Lowercase"]


class Merges:
    """Exact encoding of words by the merges of a tokenizer file; words are bytes, already normalised and cut."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if splits != [SPLIT] or kinds != NORMALISERS or spec["decoder"] is not None or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} cuts or spells its words in another way")
        self.tokenizer = Tokenizer.from_file(path)
        model = spec["model"]
        self.vocabulary, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        self.ranks = {tuple(p): n for n, p in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.spelling = {n: piece for piece, n in self.vocabulary.items()} | {n: mark for mark, n in self.special.items()}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        # Bytes are spelled as one visible letter each.
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}
        self.bytes_of = {letter: b for b, letter in self.letters.items()}

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: of all pairs the one of the lowest rank is merged first, the leftmost of equals."""
        if not word:
            return []
        symbols = [self.letters[b] for b in word]
        symbols[-1] += self.end
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        ranks = self.ranks
        heap = [(r, i) for i in range(len(symbols) - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if symbols[i] is None or j >= len(symbols) or ranks.get((symbols[i], symbols[j])) != rank:
                continue
            symbols[i] += symbols[j]
            symbols[j] = None
            after[i] = after[j]
            if after[j] < len(symbols):
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(symbols) and (r := ranks.get((symbols[a], symbols[b]))) is not None:
                    heapq.heappush(heap, (r, a))
        return [self.vocabulary[s] for s in symbols if s is not None]

    def cut(self, run: str) -> list:
        """The words (bytes) and special tokens (ids) of a run without plain white space."""
        out: list = []
        for part in self.marks.split(run):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                whole = self.tokenizer.normalizer.normalize_str(part)
                out += [bytes(self.bytes_of[c] for c in piece) for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(whole)]
        return out

    def spelled(self, ids: list[int]) -> tuple[bytes, bytes]:
        """The ids as decimals and as their pieces, a space before each."""
        return "".join(f" {n}" for n in ids).encode(), "".join(" " + self.spelling[n] for n in ids).encode()


# Cutting texts


def _classes() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    kind = np.full(256, OTHER, np.uint8)
    kind[[9, 10, 11, 12, 13, 32]] = SPACE
    kind[97:123] = LETTER
    kind[48:58] = DIGIT
    return lower, kind


SPACE, LETTER, DIGIT, OTHER = range(4)
LOWER, KIND = _classes()


def text_slices(data: np.ndarray, begins: np.ndarray, limit: int = 2_000_000):
    """Ranges of bytes of about ``limit``, ended between rows or at white space; longer only where a run has none."""
    at, end = 0, int(begins[-1])
    while at < end:
        to = min(at + limit, end)
        if to < end:
            row = int(begins[np.searchsorted(begins, to, "right") - 1])
            if row > at + limit // 2:
                to = row
            else:
                while to < end:
                    gaps = np.flatnonzero(KIND[data[to : to + 65_536]] == SPACE)
                    if len(gaps):
                        to += int(gaps[0])
                        break
                    to = min(to + 65_536, end)
        yield at, to
        at = to


def _listed(sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def units(data: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, pa.DictionaryArray, np.ndarray, pa.DictionaryArray]:
    """Cut bytes, in which rows begin at ``heads``: the places of all plain words and the words themselves, then the
    places of all other runs and the runs, as they are."""
    low = LOWER[data]
    follow = np.append(data[1:], np.uint8(0))
    # Letters of Latin-1: two bytes, of which the first is C3; the signs for times and divided by are no letters.
    pair = (data == 0xC3) & (follow >= 0x80) & (follow != 0x97) & (follow != 0xB7)
    second = np.append(False, pair[:-1])
    low[second & (data < 0x9F)] += 32
    kind = KIND[low]
    kind[pair | second] = LETTER
    hard = ((data >= 0x80) & ~pair & ~second) | ((data == 0x3C) & (follow == 0x7C))
    fresh = np.zeros(len(data) + 1, bool)
    fresh[heads] = True
    fresh = fresh[:-1]
    word = kind != SPACE
    begins = word & (np.append(True, ~word[:-1]) | fresh)
    new = word & (begins | np.append(True, kind[1:] != kind[:-1]) | (kind == DIGIT))
    # An apostrophe alone and the letters of a short form behind it are one word; what follows is another.
    ticks = np.flatnonzero((low == 0x27) & new)
    ticks = ticks[ticks + 1 < len(data)]
    ticks = ticks[(kind[ticks + 1] == LETTER) & ~fresh[ticks + 1]]
    one = low[ticks + 1]
    inner = np.minimum(ticks + 2, len(data) - 1)
    two = np.where((ticks + 2 < len(data)) & (kind[inner] == LETTER) & ~fresh[inner], low[inner], 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    size = np.where(short, 2, np.where(long, 3, 0))
    ticks, size = ticks[size > 0], size[size > 0]
    new[ticks + 1] = False
    rest = ticks + size
    rest = rest[rest < len(data)]
    new[rest] |= (kind[rest] == LETTER) & ~fresh[rest]
    runs = np.flatnonzero(begins)
    if hard.any():
        number = np.cumsum(begins) - 1
        other = np.zeros(len(runs), bool)
        other[number[hard]] = True
        outside = word & other[number]
        hard_runs = runs[other]
        sizes = np.bincount(number[outside], minlength=len(runs))[other]
        others = _listed(sizes, data[outside]).dictionary_encode()
        new &= ~outside
        word &= ~outside
    else:
        hard_runs, others = np.zeros(0, np.int64), _listed(np.zeros(0, np.int64), data[:0]).dictionary_encode()
    places = np.flatnonzero(new)
    held = np.append(0, np.cumsum(word))
    sizes = np.diff(np.append(held[places], held[-1]))
    return places, _listed(sizes, low[word]).dictionary_encode(), hard_runs, others


# The lexicon


def minimal_automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """Arcs of the smallest automaton that accepts the words, given in order without repeats.

    State and letter of an arc make its key; ``targets`` and ``numbers`` belong to the sorted keys. The numbers along a
    word add up to its place among the words.
    """
    known: dict[tuple, int] = {}
    sizes: list[int] = []  # words that each state accepts
    path: list[list] = [[False, []]]  # states that may still grow: final, arcs

    def freeze(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            shape = (final, tuple(arcs))
            state = known.get(shape)
            if state is None:
                state = known[shape] = len(known)
                sizes.append(final + sum(sizes[t] for _, t in arcs))
            letter = letters[len(path) - 1]
            path[-1][1].append((letter, state))

    letters: bytes = b""
    for word in words:
        same = 0
        while same < min(len(word), len(letters)) and word[same] == letters[same]:
            same += 1
        freeze(same)
        letters = word
        path += [[False, []] for _ in word[same:]]
        path[-1][0] = True
    freeze(0)
    states = [*known, (path[0][0], tuple(path[0][1]))]
    keys, targets, numbers = [], [], []
    for state, (final, arcs) in enumerate(states):
        before = int(final)
        for letter, target in arcs:
            keys.append(state << 8 | letter)
            targets.append(target)
            numbers.append(before)
            before += sizes[target]
    return {
        "keys": np.array(keys, np.int64), "targets": np.array(targets, np.int64), "numbers": np.array(numbers, np.int64),
        "finals": np.array([f for f, _ in states], bool), "longest": np.array([max(map(len, words), default=0)]),
    }


def look_up(lexicon: dict[str, np.ndarray], words: pa.Array) -> np.ndarray:
    """The place of each word in the lexicon, or -1; all words walk together, letter by letter."""
    data, begins = binary_column(words)
    sizes = np.diff(begins)
    out = np.full(len(sizes), -1, np.int64)
    keys, finals = lexicon["keys"], lexicon["finals"]
    walking = np.flatnonzero((sizes > 0) & (sizes <= lexicon["longest"][0])) if len(keys) else np.zeros(0, np.int64)
    state, number = np.full(len(walking), len(finals) - 1), np.zeros(len(walking), np.int64)
    depth = 0
    while len(walking):
        key = state << 8 | data[begins[walking] + depth].astype(np.int64)
        arc = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        there = keys[arc] == key
        walking, arc = walking[there], arc[there]
        state, number = lexicon["targets"][arc], number[there] + lexicon["numbers"][arc]
        depth += 1
        done = sizes[walking] == depth
        ended = done & finals[state]
        out[walking[ended]] = number[ended]
        walking, state, number = walking[~done], state[~done], number[~done]
    return out


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    """One file of arrays, as ``map_arrays`` maps it."""
    index, at = [], 0
    for name, value in arrays.items():
        index.append([name, value.dtype.str, list(value.shape), at])
        at += -(-value.nbytes // 64) * 64
    head = json.dumps(index).encode()
    start = -(-(8 + len(head)) // 64) * 64
    out = bytearray(start + at)
    out[: 8 + len(head)] = len(head).to_bytes(8, "little") + head
    for (_, _, _, offset), value in zip(index, arrays.values()):
        out[start + offset : start + offset + value.nbytes] = np.ascontiguousarray(value).tobytes()
    return bytes(out)


def strings(values: list[bytes], name: str) -> dict[str, np.ndarray]:
    return {f"{name}_ends": np.cumsum([0, *map(len, values)]).astype(np.int32), f"{name}_bytes": np.frombuffer(b"".join(values), np.uint8)}


def compile_lexicon(words: list[bytes], merges: Merges) -> dict[str, np.ndarray]:
    """The automaton of the words and, by the place of each, the number of its ids, its ids and their spellings."""
    words = sorted(set(words))
    ids = [merges.merge(w) for w in words]
    spelled = [merges.spelled(i) for i in ids]
    sizes = np.array([len(i) for i in ids], np.int64)
    flat = np.array([n for i in ids for n in i], np.uint32)
    return minimal_automaton(words) | {"sizes": sizes, "ids": flat} | strings([s[0] for s in spelled], "decimals") | strings([s[1] for s in spelled], "pieces")


def _table(lexicon: dict[str, np.ndarray], name: str) -> pa.Array:
    ends, data = lexicon[f"{name}_ends"], lexicon[f"{name}_bytes"]
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _texts(docs: DataFrame, text_column: str):
    return F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("t")


def _heads(begins: np.ndarray, at: int, to: int) -> np.ndarray:
    """Where rows begin inside a slice of bytes."""
    first, last = np.searchsorted(begins, [at, to])
    return begins[first:last] - at


def word_counts(docs: DataFrame, tokenizer: str, text_column: str = "text", keep: int = 300_000) -> DataFrame:
    """word (bytes) and n, its number in all texts. Tasks add up first and send what they hold whenever it gets large."""
    path = tokenizer_path(tokenizer)

    def run(batches):
        merges, held = None, {}

        def out():
            yield pa.record_batch([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            data, begins = binary_column(batch.column(0))
            for at, to in text_slices(data, begins):
                _, plain, _, other = units(data[at:to], _heads(begins, at, to))
                for word, n in zip(plain.dictionary.to_pylist(), np.bincount(plain.indices, minlength=len(plain.dictionary)).tolist()):
                    held[word] = held.get(word, 0) + n
                if len(other):
                    merges = merges or worker_merges(path)
                    for run_, n in zip(other.dictionary.to_pylist(), np.bincount(other.indices, minlength=len(other.dictionary)).tolist()):
                        for word in merges.cut(run_.decode("utf-8", "replace")):
                            if isinstance(word, bytes):
                                held[word] = held.get(word, 0) + n
                if len(held) > keep:
                    yield from out()
                    held.clear()
        if held:
            yield from out()

    return docs.select(_texts(docs, text_column)).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most_words: int) -> list[bytes]:
    """Words by falling frequency, whole steps of it (a sixteenth of a doubling) as long as ``most_words`` hold them.

    The number of steps is bounded, so the limit comes from a short table and no task sends more than its share of the
    answer."""
    step = F.floor(16 * F.log2("n"))
    sizes = sorted(((r.step, r["count"]) for r in counts.groupBy(step.alias("step")).count().collect()), reverse=True)
    held, least = 0, None
    for place, size in sizes:
        held += size
        if held > most_words:
            break
        least = place
    if least is None:
        return []
    return [bytes(r.word) for r in counts.where(step >= least).select("word").collect()]


def build_lexicon(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", most_words: int = 40_000, longest: int = 64, text_column: str = "text") -> str:
    """Compile the most frequent words (``most_words`` at most, of at most ``longest`` bytes and met twice or more) and
    hand the file to all executors; returns its name. The bound holds whatever the corpus holds; rarer words are merged
    exactly."""
    counts = staged(word_counts(docs, tokenizer, text_column).where((F.length("word") <= longest) & (F.col("n") > 1)), "words")
    frequent = frequent_words(counts, most_words)
    content = packed(compile_lexicon(frequent, Merges(tokenizer_path(tokenizer))))
    spark, name = docs.sparkSession, f"lexicon-{uuid.uuid4().hex}"
    folder = shared_path(spark, "lexicon")
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)
    _put(folder if "://" in folder else f"file://{folder}", name, content)
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


def worker_merges(path: str) -> Merges:
    """The merges of this worker process, read once."""
    import sys
    import types

    held = sys.modules.setdefault("spindleflow_merges", types.ModuleType("spindleflow_merges")).__dict__.setdefault("known", {})
    if path not in held:
        held[path] = Merges(path)
    return held[path]


class SliceEncoder:
    """Encodes slices of texts with the mapped lexicon, and keeps the words and runs it had to merge."""

    def __init__(self, path: str, lexicon: dict[str, np.ndarray], keep: int = 200_000):
        self.merges, self.lexicon, self.keep, self.known = worker_merges(path), lexicon, keep, {}
        self.decimals, self.pieces = _table(lexicon, "decimals"), _table(lexicon, "pieces")
        self.words = len(lexicon["sizes"])
        self.starts = np.cumsum(lexicon["sizes"]) - lexicon["sizes"]

    def _unseen(self, key, words: list) -> tuple[list[int], bytes, bytes]:
        found = self.known.get(key)
        if found is None:
            ids = [n for w in words for n in (self.merges.merge(w) if isinstance(w, bytes) else [w])]
            found = self.known[key] = (ids, *self.merges.spelled(ids))
        return found

    def encode(self, data: np.ndarray, heads: np.ndarray):
        """Places of all units of the slice, and their sizes, decimals and pieces; their ids are made when asked for."""
        if len(self.known) > self.keep:
            self.known.clear()
        places, plain, runs, other = units(data, heads)
        code = look_up(self.lexicon, plain.dictionary)
        misses = np.flatnonzero(code < 0)
        merged = [self._unseen(w, [w]) for w in plain.dictionary.take(pa.array(misses)).to_pylist()]
        code[misses] = self.words + np.arange(len(misses))
        # A run is kept under another kind of key than a plain word.
        merged += [self._unseen((r,), self.merges.cut(r.decode("utf-8", "replace")) if (r,) not in self.known else []) for r in other.dictionary.to_pylist()]
        run_code = self.words + len(misses) + np.arange(len(other.dictionary))
        codes = np.concatenate([code[plain.indices.to_numpy()], run_code[other.indices.to_numpy()]])
        order = np.argsort(np.concatenate([places, runs]), kind="stable")
        codes, places = codes[order], np.concatenate([places, runs])[order]
        sizes = np.concatenate([self.lexicon["sizes"], np.array([len(m[0]) for m in merged], np.int64)])[codes]
        take = pa.array(codes)
        spelled = [pa.concat_arrays([table, pa.array([m[k] for m in merged], pa.binary())]).take(take) for table, k in ((self.decimals, 1), (self.pieces, 2))]

        def ids() -> np.ndarray:
            pool = np.concatenate([self.lexicon["ids"], np.array([n for m in merged for n in m[0]], np.uint32)])
            lengths = np.array([len(m[0]) for m in merged], np.int64)
            starts = np.concatenate([self.starts, len(self.lexicon["ids"]) + np.cumsum(lengths) - lengths])
            ends = np.cumsum(sizes)
            return pool[np.repeat(starts[codes] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]

        return places, sizes, *spelled, ids


def encode_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", with_ids: bool = False, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The number of ids of every text and the digests of its ids and of the text decoded from them, and, where asked,
    the ids (array<int>): doc_id, n_tokens, ids_sha256, decoded_sha256 (, ids).

    NULL texts count as empty: no ids, digests of the empty string. Repeated rows are encoded each; an empty table gives
    no row; other columns play no part. Special tokens in a text become their ids, as in the library. Texts are worked
    off in slices, so a long one needs no more memory than its bytes (and its ids, where asked).
    """
    path = tokenizer_path(tokenizer)
    name = build_lexicon(docs, tokenizer, text_column=text_column, **options)

    def run(batches):
        encoder = SliceEncoder(path, map_arrays(SparkFiles.get(name)))
        for batch in batches:
            data, begins = binary_column(batch.column(1))
            rows = batch.num_rows
            counts = np.zeros(rows, np.int64)
            digests = [[hashlib.sha256() for _ in range(rows)] for _ in range(2)]
            ids = []
            for at, to in text_slices(data, begins):
                places, sizes, decimals, pieces, made = encoder.encode(data[at:to], _heads(begins, at, to))
                if with_ids:
                    ids.append(made())
                first, last = int(np.searchsorted(begins, at, "right")) - 1, int(np.searchsorted(begins, to, "left"))
                cuts = np.searchsorted(places, begins[first : last + 1] - at)
                totals = np.concatenate([[0], np.cumsum(sizes)])
                spelled = []
                for listed in (decimals, pieces):
                    blob, ends = binary_column(listed)
                    spelled.append((memoryview(np.ascontiguousarray(blob)), ends[cuts].tolist()))
                for row, (a, b) in enumerate(zip(totals[cuts[:-1]].tolist(), totals[cuts[1:]].tolist()), first):
                    if a == b:
                        continue
                    begun = counts[row] > 0  # the first id of a text has no space before it
                    for digest, (blob, ends) in zip(digests, spelled):
                        digest[row].update(blob[ends[row - first] + (not begun) : ends[row - first + 1]])
                    counts[row] += b - a
            columns = [batch.column(0), pa.array(counts), *(pa.array([d.hexdigest() for d in some], pa.string()) for some in digests)]
            if with_ids:
                flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat.astype(np.int32))))
            yield pa.record_batch(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    slim = docs.select(F.col(id_column).cast("long").alias("doc_id"), _texts(docs, text_column))
    return slim.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, tokenizer: str = "word_bpe_49k.json", ids_column: str = "ids") -> DataFrame:
    """Adds ``decoded``: the pieces of a column of ids joined by one space, special tokens included. The vocabulary has no
    decoder, so this is what the library gives too. NULL ids decode to NULL, ids outside the vocabulary to nothing."""
    path = tokenizer_path(tokenizer)

    @F.pandas_udf("string")
    def decoded(column):
        spelling = worker_merges(path).spelling
        return column.map(lambda ids: None if ids is None else " ".join(spelling[n] for n in ids if n in spelling))

    return encoded.withColumn("decoded", decoded(F.col(ids_column)))
