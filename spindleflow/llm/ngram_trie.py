"""Language-model scores from an Elias-Fano n-gram trie in shards.

Every run of one, two and three words of the training documents is counted, however rare: what the model gathers grows
with the corpus. Documents are cut into blocks of whole texts. A block sends each of its distinct runs once, with its
count in training documents, to the shard that the hash of the run's first two words names; runs of one word go by
their own hash. So a run that a third of all rows repeat arrives once from each block.

A shard holds the contexts of two words that fall to it and the words after them as a trie. The hashes of contexts and
of following words are monotone sequences, as are the children of all contexts, numbered context * words + word; another
one points to where each context's children begin. Discounted probabilities and back-off weights are one byte each that
refers to a code book. The task that builds a shard writes it to the shared folder, maps the file and answers from it
for the very runs that the blocks sent; the answers go back to the blocks, which add up their documents' scores. Nothing
passes through the driver but the number of training tokens and of distinct words.

Probabilities are interpolated with absolute discounting:
p(w|uv) = (c(uvw) - D) / c(uv) + D t(uv) / c(uv) p(w|v), and so on down to p(w) = (c(w) + 1) / (N + V + 1),
t being the number of distinct words after a context. Words are told apart by 62 bits of their XXH64, contexts by 62 bits
of a mix of two of these.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindleflow.llm.common import crc32_of, shared_path, staged, text_chunks
from spindleflow.llm.elias_fano import EliasFano
from spindleflow.llm.token_blocks import _put

HASHES = 1 << 62


def words_of(text: str) -> list[bytes]:
    """Words of a text, A-Z in lower case, and the end."""
    return [*text.encode("utf-8", "surrogatepass").lower().split(), b"\n"]


def file_of(arrays: dict[str, np.ndarray]) -> bytes:
    """One file: length of the index, index (name, type, shape, offset) as JSON, arrays at multiples of 64 bytes."""
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


def map_arrays(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped."""
    return arrays_of(np.memmap(path, np.uint8, "r"))


def arrays_of(raw: np.ndarray) -> dict[str, np.ndarray]:
    size = int.from_bytes(raw[:8].tobytes(), "little")
    start = -(-(8 + size) // 64) * 64
    out = {}
    for name, kind, shape, offset in json.loads(raw[8 : 8 + size].tobytes()):
        count = int(np.prod(shape)) * np.dtype(kind).itemsize
        out[name] = raw[start + offset : start + offset + count].view(kind).reshape(shape)
    return out


def quantised(values: np.ndarray, bits: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Codes and code book: half of the edges fill bins equally, half are evenly spaced, so that neither frequent values
    nor the few at the ends are far from their bin's mean, for which the code stands."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1)
    parts = np.linspace(0, 1, 2 ** (bits - 1) + 1)
    edges = np.unique([*np.quantile(values, parts[1:-1]), *(values.min() + parts[1:-1] * np.ptp(values))])
    codes = np.searchsorted(edges, values, "right")
    sums, sizes = np.bincount(codes, values, len(edges) + 1), np.bincount(codes, minlength=len(edges) + 1)
    return codes.astype(np.uint8), sums / np.maximum(sizes, 1)


class Trie:
    """One shard over mapped arrays: contexts of two words, and the words after them."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a = arrays
        parts = {name: {n[len(name) + 1 :]: v for n, v in arrays.items() if n.startswith(name + ".")} for name in ("contexts", "words", "keys", "pointers")}
        self.contexts, self.words, self.keys, self.pointers = (EliasFano(parts[n]) for n in ("contexts", "words", "keys", "pointers"))

    @staticmethod
    def arrays(contexts: np.ndarray, joint: np.ndarray, words: np.ndarray, parents: np.ndarray, after: np.ndarray, own: np.ndarray, back: np.ndarray) -> dict[str, np.ndarray]:
        """Arrays of a shard: sorted hashes of contexts and words; children by (parent, word); log10 of all values."""
        begins = np.concatenate([[0], np.cumsum(np.bincount(parents, minlength=len(contexts)))])
        out = {}
        for name, values, universe in (
            ("contexts", contexts, HASHES), ("words", words, HASHES), ("keys", parents * len(words) + after, max(1, len(contexts) * len(words))), ("pointers", begins, len(parents) + 1),
        ):
            out |= {f"{name}.{n}": v for n, v in EliasFano.arrays(values, universe).items()}
        for name, values in (("joint", joint), ("own", own), ("back", back)):
            out[name], out[f"{name}_book"] = quantised(values)
        return out

    def children(self, parents: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The child of each parent for each word, or -1. Parents or words of -1 have none."""
        out = np.full(len(parents), -1, np.int64)
        live = np.flatnonzero((parents >= 0) & (words >= 0))
        if not len(live) or not self.keys.size:
            return out
        live = live[self.pointers.get(parents[live] + 1) > self.pointers.get(parents[live])]
        out[live] = self.keys.find(parents[live] * self.words.size + words[live])
        return out

    def value(self, name: str, nodes: np.ndarray, missing: float) -> np.ndarray:
        """log10 of the probability or weight of each node; ``missing`` for -1."""
        if not len(self.a[name]):
            return np.full(len(nodes), missing)
        return np.where(nodes >= 0, self.a[f"{name}_book"][self.a[name][np.maximum(nodes, 0)]], missing)


def squeezed(*arrays: np.ndarray, level: int = 3) -> bytes:
    """Arrays of known types as one compressed message: their lengths, then their bytes."""
    raw = b"".join([np.array([len(a) for a in arrays], np.int64).tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(raw, asbytes=True)


def unsqueezed(message: bytes, *types: str) -> list[np.ndarray]:
    raw = pa.decompress(message[8:], int.from_bytes(message[:8], "little"), "zstd", asbytes=True)
    at, out = 8 * len(types), []
    for size, kind in zip(np.frombuffer(raw, np.int64, len(types)).tolist(), types):
        out.append(np.frombuffer(raw, kind, size, at))
        at += size * np.dtype(kind).itemsize
    return out


def halves(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2^32 as low and high parts: the high ones are mostly zero and take next to no room."""
    return (numbers & 0xFFFF).astype(np.uint16), (numbers >> 16).astype(np.uint16)


def whole(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.int64) | high.astype(np.int64) << 16


def joined(messages: list[bytes], *types: str) -> tuple[list[np.ndarray], list[list[int]]]:
    """The arrays of all messages end to end, and each array's length in each message."""
    parts = [unsqueezed(m, *types) for m in messages]
    whole = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind) for k, kind in enumerate(types)]
    return whole, [[len(p[k]) for p in parts] for k in range(len(types))]


def split_back(values: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(values, np.cumsum(sizes)[:-1]) if sizes else []


def context_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """62 bits of a mix of two words' hashes."""
    x = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(2)).astype(np.int64)


def by_shard(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of the hashes by shard, stable, and each shard's stretch of it: shard, begin, end."""
    of = hashes % shards
    order = np.argsort(of, kind="stable")
    begins = np.flatnonzero(np.diff(of[order], prepend=-1))
    return order, list(zip(of[order][begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(order)]))


class Runs:
    """The distinct runs of two and three words of a block, by shard, then by their words.

    ``ids`` number the block's words by their place in ``hashes``; no run crosses the border of two texts.
    """

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, shards: int):
        words = max(1, len(hashes))
        inner = np.ones(len(ids), bool)
        inner[np.cumsum(sizes) - sizes] = False  # a text's first token ends no run
        self.second = np.flatnonzero(inner)
        distinct, back = np.unique(ids[self.second - 1] * words + ids[self.second], return_inverse=True)
        left, right = distinct // words, distinct % words
        order, self.stretches = by_shard(context_hash(hashes[left], hashes[right]), shards)
        self.left, self.right = left[order], right[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.pair = rank[back]  # of each token in ``second``
        at = np.full(len(ids), -1, np.int64)
        at[self.second] = self.pair
        self.third = self.second[inner[self.second - 1]]
        self.above = at[self.third - 1]
        distinct, self.triple = np.unique(self.above * words + ids[self.third], return_inverse=True)
        self.parent, self.word = distinct // words, distinct % words


BLOCKS = "kind string, block long, shard long, train_tokens long, content binary"
SELF = ("i8", "?", "?", "i8", "u2", "u2", "i8")
PAIRS = ("i8", "u2", "u2", "u2", "u2", "u4", "u4", "u2", "u2", "u4")


def cut_blocks(slim: DataFrame, shards: int, block_chars: int) -> DataFrame:
    """Rows k, h, t (id, held out, text) to blocks: a row ``self`` of tokens, and messages ``words``."""

    def run(batches):
        import xxhash
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            keys, held, texts = (batch.column(k).to_pylist() for k in range(3))
            for begin, end in text_chunks(texts, block_chars):
                split = [words_of(t) for t in texts[begin:end]]
                sizes = np.fromiter(map(len, split), np.int64, len(split))
                seen: dict[bytes, int] = {}
                ids = np.fromiter((seen.setdefault(w, len(seen)) for s in split for w in s), np.int64, int(sizes.sum()))
                hashes = np.fromiter((xxhash.xxh64_intdigest(w) >> 2 for w in seen), np.int64, len(seen))
                del split, seen
                # Frequent words have small numbers.
                order = np.argsort(-np.bincount(ids, minlength=len(hashes)), kind="stable")
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                ids, hashes = rank[ids], hashes[order]
                out_of_fit = np.array([bool(h) for h in held[begin:end]])
                counted = np.repeat(~out_of_fit, sizes).astype(np.float64)
                ks = keys[begin:end]
                own = squeezed(np.array([k or 0 for k in ks], np.int64), np.array([k is None for k in ks]), out_of_fit, sizes, *halves(ids), hashes, level=9)
                rows = [("self", -1, int(counted.sum()), own)]
                count = np.bincount(ids, counted, len(hashes)).astype(np.uint32)
                order, stretches = by_shard(hashes, shards)
                for s, i, j in stretches:
                    rows.append(("words", s, 0, squeezed(hashes[order[i:j]], count[order[i:j]])))
                columns = list(zip(*rows))
                yield pa.record_batch([columns[0], [block] * len(rows), columns[1], columns[2], pa.array(columns[3], pa.binary())], names=["kind", "block", "shard", "train_tokens", "content"])
                block += 1

    return slim.mapInArrow(run, BLOCKS)


def send_pairs(own: DataFrame, shards: int) -> DataFrame:
    """Rows ``self`` of blocks to messages ``pairs``: the distinct runs of two and three words that fall to a shard, in
    numbers of the message's own list of words, with their counts in training texts."""

    def run(batches):
        for batch in batches:
            for block, content in zip(batch.column(1).to_pylist(), batch.column(3)):
                _, _, held, sizes, low, high, hashes = unsqueezed(content.as_py(), *SELF)
                counted = np.repeat(~held, sizes).astype(np.float64)
                runs = Runs(whole(low, high), sizes, hashes, shards)
                pairs = np.bincount(runs.pair, counted[runs.second], len(runs.left)).astype(np.uint32)
                triples = np.bincount(runs.triple, counted[runs.third], len(runs.parent)).astype(np.uint32)
                kids = np.bincount(runs.parent, minlength=len(runs.left)).astype(np.uint32)
                rows = []
                for s, i, j in runs.stretches:
                    m, n = np.searchsorted(runs.parent, (i, j)).tolist()
                    left, right, word = runs.left[i:j], runs.right[i:j], runs.word[m:n]
                    used = np.zeros(len(hashes), bool)
                    used[left] = used[right] = used[word] = True
                    number = np.cumsum(used) - 1
                    steps = np.diff(number[left], prepend=0)
                    part = squeezed(hashes[used], *halves(steps), *halves(number[right]), pairs[i:j], kids[i:j], *halves(number[word]), triples[m:n])
                    rows.append((s, part))
                if rows:
                    part = [pa.array(["pairs"] * len(rows)), pa.array([block] * len(rows), pa.int64()), pa.array([s for s, _ in rows], pa.int64()), pa.array([c for _, c in rows], pa.binary())]
                    yield pa.record_batch(part, names=ANSWER_NAMES)

    return own.mapInArrow(run, ANSWERS)


ANSWERS = "kind string, block long, shard long, content binary"
ANSWER_NAMES = ["kind", "block", "shard", "content"]


def _answer_table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * 4
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=ANSWER_NAMES)


def open_shard(folder: str, name: str) -> Trie:
    """A shard's file: memory-mapped where the shared folder is a mounted one, else read whole."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    path = f"{path}/{name}"
    if isinstance(system, fs.LocalFileSystem):
        return Trie(map_arrays(path))
    with system.open_input_stream(path) as file:
        return Trie(arrays_of(np.frombuffer(file.read(), np.uint8)))


def answer_pairs(messages: DataFrame, shards: int, total: int, discount: float, folder: str) -> DataFrame:
    """Build each shard from its messages, write it, and answer: per block the joint probability of each context, its
    back-off weight and the own share of each run of three. Rows ``roots``: first words and their distinct followers."""

    def run(key, table):
        shard = key[0].as_py()
        blocks = table.column("block").to_pylist()
        parts, sizes = [], ([], [])
        for message in table.column("content"):
            hashes, *left, right, right_high, pairs, kids, word, word_high, triples = unsqueezed(message.as_py(), *PAIRS)
            lead = hashes[np.cumsum(whole(*left))]
            parts.append((context_hash(lead, hashes[whole(right, right_high)]), lead, pairs, kids, hashes[whole(word, word_high)], triples))
            sizes[0].append(len(pairs))
            sizes[1].append(len(triples))
        context, first, pairs, kids, word, triples = map(np.concatenate, zip(*parts))
        contexts, lead, at = np.unique(context, return_index=True, return_inverse=True)
        count2 = np.bincount(at, pairs, len(contexts))
        words, word_at = np.unique(word, return_inverse=True)
        keys, key_at = np.unique(np.repeat(at, kids) * max(1, len(words)) + word_at, return_inverse=True)
        count3 = np.bincount(key_at, triples, len(keys))
        parents, after = keys // max(1, len(words)), keys % max(1, len(words))

        live, live3 = np.flatnonzero(count2 > 0), np.flatnonzero(count3 > 0)
        place = np.full(len(contexts), -1, np.int64)
        place[live] = np.arange(len(live))
        up, learnt = place[parents[live3]], np.unique(after[live3])
        followers = np.bincount(up, minlength=len(live))
        name = f"shard-{shard:08d}.trie"
        arrays = Trie.arrays(
            contexts[live], np.log10((count2[live] - discount) / max(1, total)), words[learnt], up, np.searchsorted(learnt, after[live3]),
            np.log10((count3[live3] - discount) / count2[parents[live3]]), np.log10(discount * np.maximum(followers, 1) / count2[live]),
        )
        _put(folder, name, file_of(arrays))
        trie = open_shard(folder, name)
        node = trie.contexts.find(contexts)
        child = trie.children(node[parents], trie.words.find(words)[after])
        # Answers are logarithms in half precision; the joint one is taken times all tokens, which keeps it small.
        joint, back, own = trie.value("joint", node, -np.inf) + np.log10(max(1, total)), trie.value("back", node, 0.0), trie.value("own", child, -np.inf)
        joint, back, own = (v.astype(np.float16) for v in (joint[at], back[at], own[key_at]))
        parts = zip(split_back(joint, sizes[0]), split_back(back, sizes[0]), split_back(own, sizes[1]))
        rows = [("pairs", block, shard, squeezed(*part)) for block, part in zip(blocks, parts)]
        roots, distinct = np.unique(first[lead[live]], return_counts=True)
        order, stretches = by_shard(roots, shards)
        for s, i, j in stretches:
            rows.append(("roots", -1, s, squeezed(roots[order[i:j]], distinct[order[i:j]])))
        return _answer_table(rows)

    return messages.groupBy("shard").applyInArrow(run, ANSWERS)


def answer_words(messages: DataFrame) -> DataFrame:
    """Messages ``words`` and ``roots`` to each block's counts of words and of their distinct followers; rows ``kinds``
    hold how many of a shard's words are in training texts."""

    def run(key, table):
        shard, kinds = key[0].as_py(), table.column("kind").to_pylist()
        contents, blocks = table.column("content").to_pylist(), table.column("block").to_pylist()
        asked = [n for n, kind in enumerate(kinds) if kind == "words"]
        (hashes, counts), sizes = joined([contents[n] for n in asked], "i8", "u4")
        (roots, distinct), _ = joined([contents[n] for n, kind in enumerate(kinds) if kind == "roots"], "i8", "i8")
        words, at = np.unique(hashes, return_inverse=True)
        count = np.bincount(at, counts, len(words)).astype(np.int64)
        followers = np.bincount(np.searchsorted(words, roots), distinct, len(words)).astype(np.int64)  # every root is a word
        parts = zip(split_back(count[at], sizes[0]), split_back(followers[at], sizes[0]))
        rows = [("words", blocks[n], shard, squeezed(*part)) for n, part in zip(asked, parts)]
        return _answer_table([*rows, ("kinds", int((count > 0).sum()), shard, b"")])

    return messages.groupBy("shard").applyInArrow(run, ANSWERS)


def score_blocks(rows: DataFrame, shards: int, total: int, kinds: int, discount: float, id_column: str) -> DataFrame:
    """Rows ``self`` and all answers of each block to one row per document."""
    names = [id_column, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(key, table):
        kind, shard, content = (table.column(n).to_pylist() for n in ("kind", "shard", "content"))
        order = sorted(range(len(kind)), key=lambda n: shard[n])
        own = content[kind.index("self")]
        keys, no_key, held, sizes, low, high, hashes = unsqueezed(own, *SELF)
        ids = whole(low, high)
        got, _ = joined([content[n] for n in order if kind[n] == "words"], "i8", "i8")
        (joint, back, share), _ = joined([content[n] for n in order if kind[n] == "pairs"], "f2", "f2", "f2")
        joint, back, share = (10.0 ** v.astype(np.float64) for v in (joint, back, share))
        count, followers = np.empty((2, len(hashes)), np.int64)
        count[by_shard(hashes, shards)[0]], followers[by_shard(hashes, shards)[0]] = got
        runs = Runs(ids, sizes, hashes, shards)
        base = (count[ids] + 1.0) / (total + 1.0 * (kinds + 1))
        p = base.copy()
        left = ids[runs.second - 1]
        seen = np.maximum(count[left], 1)
        p[runs.second] = np.where(
            count[left] > 0, joint[runs.pair] / seen + discount * followers[left] / seen * p[runs.second], p[runs.second]
        )
        p[runs.third] = share[runs.triple] + back[runs.above] * p[runs.third]
        heads = np.cumsum(sizes) - sizes
        sums = [np.add.reduceat(v, heads) for v in ((count[ids] > 0).astype(np.int64), np.log10(base), np.log10(np.minimum(p, 1.0)))]
        columns = [pa.array(keys, mask=no_key), held, sizes, sums[0], np.full(len(keys), total, np.int64), sums[1], sums[2]]
        return pa.table([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    schema = f"`{id_column}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("block").applyInArrow(run, schema)


def score_documents(
    docs: DataFrame, folds: int = 7, held_fold: int = 2, id_column: str = "doc_id", text_column: str = "text", discount: float = 0.75,
    shard_bytes: int = 16_000_000, block_chars: int = 6_000_000, folder: str | None = None,
) -> DataFrame:
    """Scores of every row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32(id as text) mod ``folds`` is ``held_fold`` are left out of all counts. NULL texts count as empty
    and have the end alone; repeated rows count and score like any other; without training rows every token is unknown.
    There is a shard for each ``shard_bytes`` of text; ``folder`` (a fresh shared one by default) keeps their files.
    A block is whole texts of ``block_chars`` characters together, one text at least.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_column), F.lit("")).alias("t")
    held_out = F.pmod(crc32_of(id_column), F.lit(folds)) == held_fold
    slim = docs.select(F.col(id_column).cast("long").alias("k"), held_out.alias("h"), text)
    shards = max(1, -(-(docs.agg(F.sum(F.octet_length(text_column))).first()[0] or 0) // shard_bytes))
    blocks = staged(cut_blocks(slim, shards, block_chars), "blocks", "kind")
    total = blocks.where("kind = 'self'").agg(F.coalesce(F.sum("train_tokens"), F.lit(0))).first()[0]
    folder = folder or shared_path(spark, "trie")
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)

    of_kind = {k: blocks.where(F.col("kind") == k).select(*ANSWER_NAMES) for k in ("self", "words")}
    pairs = staged(answer_pairs(send_pairs(of_kind["self"], shards), shards, total, discount, folder), "answers", "kind")
    roots = pairs.where("kind = 'roots'").select(*ANSWER_NAMES)
    words = staged(answer_words(of_kind["words"].unionByName(roots)), "word-answers", "kind")
    kinds = words.where("kind = 'kinds'").agg(F.coalesce(F.sum("block"), F.lit(0))).first()[0]
    answers = [t.where(F.col("kind") == k).select(*ANSWER_NAMES) for t, k in ((pairs, "pairs"), (words, "words"))]
    rows = of_kind["self"].unionByName(answers[0]).unionByName(answers[1])
    return score_blocks(rows, shards, total, kinds, discount, id_column)
