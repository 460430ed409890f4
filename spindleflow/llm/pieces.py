"""SentencePiece encoding and decoding by a batched lattice walk in numpy.

The distinct words of a slice of texts are cut together: words of equal length form a matrix whose columns advance in
step. The hash of every substring that ends at a column probes the sorted hashes of the pieces, and the best way to
reach the column is kept as a backpointer by a maximum over the candidate lengths.

For a unigram model the maximum is Viterbi's: the sum of the pieces' scores. The score of a piece in a byte-pair model is
only the rank of its merge, and the best sum of ranks is not what such a model yields. Its lattice holds exactly one path
whose neighbouring pieces do not merge in any other way (a merge across a border depends on the two pieces beside it
alone), so there the walk keeps the one candidate that stands beside the piece already reached.
"""

from __future__ import annotations

import sys
import types
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindleflow.llm.common import text_chunks, text_slices, tokenizer_path

SPACE = "▁"
BASE = 0x9E3779B97F4A7C15
UNIGRAM, BPE = 1, 2
NORMAL, BYTE, USER = 1, 6, 4


class PieceModel:
    """The pieces of a model file, and what has been learnt about words and neighbours so far."""

    def __init__(self, content: bytes, keep_words: int = 200_000, keep_pairs: int = 3_000_000):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(content)
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError("only models that leave texts as they are can be walked here")
        self.kind = proto.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and byte-pair models have a lattice")
        self.prefix = spec.add_dummy_prefix
        self.names = [p.piece for p in proto.pieces]
        self.kinds = np.array([p.type for p in proto.pieces])
        self.scores = np.array([p.score for p in proto.pieces], np.float64)
        self.unknown = next(k for k, p in enumerate(proto.pieces) if p.type == 2)
        self.bytes_at = {int(p.piece[3:5], 16): k for k, p in enumerate(proto.pieces) if p.type == BYTE}
        if any(p.type == USER for p in proto.pieces):
            raise ValueError("user-defined pieces are not supported")
        self.ids = {p.piece: k for k, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.rank = {p: -float(self.scores[k]) for p, k in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.inside = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.breaks = all("\n" not in p for p in self.ids)
        listed = list(self.ids)
        keys = np.array([self._hash(p) for p in listed], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array([self.ids[listed[k]] for k in order], np.int64)
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.lowest = float(self.scores[list(self.ids.values())].min()) - 10.0
        self.keep_words, self.keep_pairs = keep_words, keep_pairs
        # Pieces that their own merges never yield cannot stand anywhere.
        self.whole = np.ones(len(self.names), bool)
        if self.kind == BPE:
            for piece, k in self.ids.items():
                self.whole[k] = self._merged(piece) == [piece]
        self.pairs: dict[int, bool] = {}
        self.pair_keys, self.pair_fits = np.zeros(0, np.int64), np.zeros(0, bool)
        self.clear()
        spelled = [p.replace(SPACE, " ").encode() for p in self.names]
        for value, k in self.bytes_at.items():
            spelled[k] = bytes([value])
        for k, kind in enumerate(self.kinds):
            if kind == 3:
                spelled[k] = b""
        spelled[self.unknown] = " ⁇ ".encode()
        self.spelled = spelled

    @staticmethod
    def _hash(piece: str) -> int:
        held = 0
        for letter in piece:
            held = (held * BASE + ord(letter) + 1) % 2**64
        return held

    def clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.starts, self.sizes, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    # Byte-pair merges, in the model's own order: the best ranked pair first, the leftmost of equals.
    def _merged(self, text: str) -> list[str]:
        parts, rank = list(text), self.rank.get
        ranks = [rank(a + b, 1e30) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == 1e30:
                break
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = rank(parts[k] + parts[k + 1], 1e30)
            if k:
                ranks[k - 1] = rank(parts[k - 1] + parts[k], 1e30)
        return parts

    def _beside(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each piece stays beside the one before it. Negative pieces are letters that no piece holds."""
        code = (left << np.int64(32)) ^ right
        kinds, first, back = np.unique(code, return_index=True, return_inverse=True)
        out = np.zeros(len(kinds), bool)
        at = np.minimum(np.searchsorted(self.pair_keys, kinds), max(0, len(self.pair_keys) - 1))
        known = self.pair_keys[at] == kinds if len(self.pair_keys) else out.copy()
        out[known] = self.pair_fits[at[known]]
        for k in np.flatnonzero(~known).tolist():
            fits = self.pairs.get(int(kinds[k]))
            if fits is None:
                a, b = (self.names[p] if p >= 0 else chr(-p - 1) for p in (int(left[first[k]]), int(right[first[k]])))
                fits = self.pairs[int(kinds[k])] = self._merged(a + b) == [a, b]
            out[k] = fits
        if len(self.pairs) > 30_000:
            # New pairs move from the dictionary to sorted arrays of nine bytes each.
            if len(self.pair_keys) > self.keep_pairs:
                self.pair_keys, self.pair_fits = np.zeros(0, np.int64), np.zeros(0, bool)
            keys = np.concatenate([self.pair_keys, np.fromiter(self.pairs, np.int64, len(self.pairs))])
            fits = np.concatenate([self.pair_fits, np.fromiter(self.pairs.values(), bool, len(self.pairs))])
            order = np.argsort(keys, kind="stable")
            self.pair_keys, self.pair_fits = keys[order], fits[order]
            self.pairs.clear()
        return out[back]

    def _walk(self, words: list[str]) -> list[bytes]:
        """The ids of words of one length, as bytes of 32-bit integers."""
        length, count = len(words[0]), len(words)
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(count, length).astype(np.uint64)
        # prefix[:, j] hashes the first j letters; a substring's hash follows from two of them.
        prefix = np.zeros((count, length + 1), np.uint64)
        for j in range(length):
            prefix[:, j + 1] = prefix[:, j] * np.uint64(BASE) + letters[:, j] + np.uint64(1)
        best = np.full((count, length + 1), -np.inf)
        best[:, 0] = 0
        last = np.full((count, length + 1), np.iinfo(np.int64).min)
        size = np.zeros((count, length + 1), np.int64)
        for j in range(1, length + 1):
            power = 1
            powers = []
            for n in range(1, min(j, self.longest) + 1):
                power = power * BASE % 2**64
                powers.append(power)
            for n in range(len(powers), 0, -1):
                key = prefix[:, j] - prefix[:, j - n] * np.uint64(powers[n - 1])
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                piece = np.where(self.keys[at] == key, self.key_ids[at], -1)
                if n == 1:
                    piece = np.where(piece < 0, -letters[:, j - 1].astype(np.int64) - 1, piece)
                    usable = np.isfinite(best[:, j - 1])
                else:
                    usable = (piece >= 0) & np.isfinite(best[:, j - n])
                rows = np.flatnonzero(usable)
                if not len(rows):
                    continue
                piece = piece[rows]
                if self.kind == BPE:
                    # The longest way in that may stand: of all candidates one does.
                    fits = np.isneginf(best[rows, j])
                    if n > 1:
                        fits &= self.whole[piece]
                    inner = np.flatnonzero(fits) if j > n else np.zeros(0, np.int64)
                    if len(inner):
                        fits[inner] = self._beside(last[rows[inner], j - n], piece[inner])
                    value = np.where(fits, 0.0, -np.inf)
                else:
                    value = best[rows, j - n] + np.where(piece >= 0, self.scores[np.maximum(piece, 0)], self.lowest)
                better = value > best[rows, j]
                rows, piece, value = rows[better], piece[better], value[better]
                best[rows, j], last[rows, j], size[rows, j] = value, piece, n
        steps, here = [], np.full(count, length)
        every = np.arange(count)
        while (here > 0).any():
            steps.append(np.where(here > 0, last[every, here], np.iinfo(np.int64).min))
            here = here - size[every, here]
        table = np.stack(steps[::-1], axis=1)
        out = []
        for row in table.tolist():
            ids, gap = array("i"), False
            for piece in row:
                if piece >= 0:
                    ids.append(piece)
                elif piece > -0x120000:
                    if self.bytes_at:
                        ids.extend([self.bytes_at[b] for b in chr(-piece - 1).encode()])
                    elif not gap:
                        ids.append(self.unknown)  # neighbouring unknown letters are one
                gap = -0x120000 < piece < 0
            out.append(ids.tobytes())
        return out

    def _learn(self, words: list[str], cells: int = 400_000) -> None:
        by_length: dict[int, list[str]] = {}
        for word in words:
            by_length.setdefault(len(word), []).append(word)
        for length, some in by_length.items():
            step = max(1, cells // max(1, length))
            for k in range(0, len(some), step):
                found = self._walk(some[k : k + step])
                sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
                self.codes.update(zip(some[k : k + step], range(len(self.codes), len(self.codes) + len(found))))
                self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
                self.sizes = np.concatenate([self.sizes, sizes])
                self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(found), np.int32)])

    def words_of(self, text: str) -> list[str]:
        """Cut a text where no piece can reach across: before a run of spaces, and at line ends if no piece has one."""
        import re

        if not text:
            return []
        text = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        if self.inside:
            return [text]
        stop = r"\n" if self.breaks else ""
        return re.findall(rf"{SPACE}*[^{SPACE}{stop}]+|{SPACE}+" + ("|\n" if self.breaks else ""), text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each has."""
        if len(self.codes) > self.keep_words:
            self.clear()
        split = [self.words_of(t) for t in texts]
        words = [w for s in split for w in s]
        self._learn(list(set(words).difference(self.codes)))
        codes = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        sizes = self.sizes[codes]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[codes] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)
        reached = np.concatenate([[0], ends])[bounds]
        return self.pool[at], np.diff(reached)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; broken byte sequences become replacement marks, ids out of range raise."""
        text = b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def piece_model(path: str) -> PieceModel:
    """The model of this worker process; later tasks of the same worker find its words already cut."""
    held = sys.modules.setdefault("spindleflow_worker_state", types.ModuleType("spindleflow_worker_state"))
    known = held.__dict__.setdefault("piece_models", {})
    if path not in known:
        with open(path, "rb") as file:
            known[path] = PieceModel(file.read())
    return known[path]


def _hinted(run):
    from collections.abc import Iterator

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return run


def ids_of(walker: PieceModel, texts: pa.Array):
    """The piece ids of an array of texts, one array for each slice of it: what a worker holds beside the texts does not
    grow with them."""
    for _, _, some in text_slices(texts):
        ids, sizes = walker.encode(some)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))


def encoded(text: Column, model: str = "piece_bpe_32k.model") -> Column:
    """The piece ids of each whole text, as array<int>; NULL and empty texts give an empty array."""
    path = tokenizer_path(model)

    def run(batches):
        walker = piece_model(path)
        for batch in batches:
            yield from ids_of(walker, batch)

    return F.arrow_udf(_hinted(run), "array<int>")(F.coalesce(text, F.lit("")))


def decoded(ids: Column, model: str = "piece_bpe_32k.model") -> Column:
    """The text of piece ids; NULL counts as no id and gives an empty text."""
    path = tokenizer_path(model)

    def run(batches):
        walker = piece_model(path)
        for batch in batches:
            yield pa.array([walker.decode(row.as_py() or []) for row in batch], pa.string())

    return F.arrow_udf(_hinted(run), "string")(ids)


def encode_documents(docs: DataFrame, model: str = "piece_bpe_32k.model", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row with its ids: id, n_pieces, piece_ids, and round_trip (whether decoding gives the text back).

    A text that itself holds the mark for a space decodes to a space there, so its round trip is false.
    """
    path = tokenizer_path(model)

    def run(batches):
        walker = piece_model(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for begin, end in text_chunks(texts, 4_000_000):
                ids, sizes = walker.encode(texts[begin:end])
                ends = np.cumsum(sizes)
                same = [walker.decode(ids[e - n : e].tolist()) == t for t, e, n in zip(texts[begin:end], ends.tolist(), sizes.tolist())]
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                yield pa.record_batch(
                    [batch.column(0).slice(begin, end - begin), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array(same)],
                    names=["id", "n_pieces", "piece_ids", "round_trip"],
                )

    slim = docs.select(F.col(id_column).cast("long"), F.col(text_column))
    rows = slim.mapInArrow(run, "id long, n_pieces long, piece_ids array<int>, round_trip boolean")
    return rows.withColumnRenamed("id", id_column)
