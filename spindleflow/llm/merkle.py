"""Document fingerprints: Merkle trees over sections and paragraphs.

A text falls into sections (a blank line or a heading begins one), sections into paragraphs (lines), paragraphs into
passages. A passage ends after a word whose own hash says so, eight words on the average and sixteen at most, so an edit moves only the
borders beside it. Hashes of children make the hash of their parent: equal roots mean equal texts, and where two trees
differ, the differing branches lead to the edits.

The fingerprint is the root's hash and, after a colon, the leaves in order, 24 bits each, in base64: the passages, or
the single words of texts of up to 64 words. Words are hashed over their letters and the white space behind them.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindleflow.llm.common import staged

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
FEW = 64


def _digest(parts) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16).digest()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, count: int) -> np.ndarray:
    """Powers of an odd number modulo 2**64, kept and grown on demand."""
    held = _POWERS.get(name)
    if held is None or len(held) < count:
        with np.errstate(over="ignore"):
            held = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(count, 65_536), base, np.uint64)]), dtype=np.uint64)
        _POWERS[name] = held
    return held[:count]


def leaves(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (with the white space behind it) and whether a passage ends with it."""
    if not raw:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    letters = np.frombuffer(raw, np.uint8)
    blank = (letters == 32) | ((letters >= 9) & (letters <= 13))
    begins = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    # White space before the first word belongs to it.
    begins = np.concatenate([[0], begins[1:]]) if len(begins) else np.zeros(1, np.int64)
    ends = np.append(begins[1:], len(letters))
    summed = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * _powers("up", BASE, len(letters)), out=summed[1:])
    words = _mix((summed[ends] - summed[begins]) * _powers("down", INVERSE, len(letters) + 1)[begins] + (ends - begins).astype(np.uint64))
    lines = np.concatenate([[0], np.cumsum(letters == 10)])
    ended = lines[ends] > lines[begins]
    stop = ((words >> np.uint64(40)) % np.uint64(8) == 0) | ended
    stop[-1] = True
    # Repeated words may never stop by themselves: sixteen are enough.
    heads = np.concatenate([[0], np.flatnonzero(stop)[:-1] + 1])
    place = np.arange(len(words)) - np.repeat(heads, np.diff(np.append(heads, len(words))))
    return words, stop | (place % 16 == 15)


def passages(words: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """24-bit hash of each passage, from the 24-bit hashes of its words and their places in it."""
    if not len(words):
        return words
    heads = np.concatenate([[0], np.flatnonzero(stop)[:-1] + 1])
    place = np.arange(len(words)) - np.repeat(heads, np.diff(np.append(heads, len(words))))
    mixed = _mix(words + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE))
    return _mix(np.add.reduceat(mixed, heads)) >> np.uint64(40)


def nodes(text: str) -> list[tuple[int, int, bytes]]:
    """(section, paragraph, hash of the paragraph) in order; sections and paragraphs are numbered from 0."""
    out, section, number, fresh = [], -1, 0, True
    for line in text.split("\n"):
        if fresh or line.startswith("#") or section < 0:
            section, number = section + 1, 0
        out.append((section, number, _digest([line.encode("utf-8", "surrogatepass")])))
        fresh, number = not line.strip(), number + 1
    return out


def root_of(listed: list[tuple[int, int, bytes]]) -> bytes:
    sections: dict[int, list[bytes]] = {}
    for section, _, digest in listed:
        sections.setdefault(section, []).append(digest)
    return _digest([_digest(parts) for parts in sections.values()])


def fingerprint(text: str) -> str:
    """Root and leaves of a text as one string. Words come with a bit each: whether a passage ends there."""
    words, stop = leaves(text.encode("utf-8", "surrogatepass"))
    shown, marks = _mix(words) >> np.uint64(40), ""
    if len(words) > FEW:
        shown = passages(shown, stop)
    else:
        marks = base64.b64encode(np.packbits(stop).tobytes()).decode() + "."
    short = shown.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    return f"{root_of(nodes(text)).hex()}:{marks}{base64.b64encode(short.tobytes()).decode()}"


def _leaves_of(mark: str, lift: bool) -> Counter:
    head, _, data = mark[33:].rpartition(".")
    raw = np.frombuffer(base64.b64decode(data), np.uint8).reshape(-1, 3).astype(np.uint64)
    shown = raw[:, 0] | raw[:, 1] << np.uint64(8) | raw[:, 2] << np.uint64(16)
    if lift and "." in mark:
        stop = np.unpackbits(np.frombuffer(base64.b64decode(head), np.uint8))[: len(shown)].astype(bool)
        shown = passages(shown, stop)
    return Counter(shown.tolist())


def likeness(left: str, right: str) -> float:
    """Twice the leaves in common over all leaves of two fingerprints; 1 for equal roots. Where one has passages, the
    passages of the other are built from its words."""
    if left[:32] == right[:32]:
        return 1.0
    lift = ("." in left) != ("." in right)
    a, b = _leaves_of(left, lift), _leaves_of(right, lift)
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


def tree(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The nodes of every row's tree: id, level (root, section, paragraph), section, paragraph, hash. NULL texts count
    as empty: one empty paragraph in one section."""

    def run(batches):
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                listed = nodes(text or "")
                sections: dict[int, list[bytes]] = {}
                for section, _, digest in listed:
                    sections.setdefault(section, []).append(digest)
                rows = [("root", None, None, root_of(listed))]
                rows += [("section", s, None, _digest(parts)) for s, parts in sections.items()]
                rows += [("paragraph", s, p, d) for s, p, d in listed]
                for k in range(0, len(rows), 10_000):
                    level, section, paragraph, digest = zip(*rows[k : k + 10_000])
                    yield pa.record_batch(
                        [pa.array([key] * len(level), pa.int64()), pa.array(level), pa.array(section, pa.int64()), pa.array(paragraph, pa.int64()), pa.array([d.hex() for d in digest])],
                        names=["id", "level", "section", "paragraph", "hash"],
                    )

    slim = docs.select(F.col(id_column).cast("long"), F.col(text_column))
    return slim.mapInArrow(run, "id long, level string, section long, paragraph long, hash string")


def differing_branches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Nodes of two tables of trees that differ: id, level, section, paragraph, left_hash, right_hash (NULL where one
    side has no such node). Only documents whose roots differ are walked."""
    roots = left.where("level = 'root'").select("id", F.col("hash").alias("a")).join(right.where("level = 'root'").select("id", F.col("hash").alias("b")), "id", "full")
    edited = roots.where(~F.col("a").eqNullSafe(F.col("b"))).select("id")
    place = F.struct(F.col("level"), F.coalesce("section", F.lit(-1)).alias("section"), F.coalesce("paragraph", F.lit(-1)).alias("paragraph"))
    sides = [df.join(edited, "id", "left_semi").select("id", place.alias("place"), F.col("hash").alias(name)) for df, name in ((left, "left_hash"), (right, "right_hash"))]
    both = sides[0].join(sides[1], ["id", "place"], "full").where(~F.col("left_hash").eqNullSafe(F.col("right_hash")))
    return both.select("id", "place.level", F.nullif("place.section", F.lit(-1)).alias("section"), F.nullif("place.paragraph", F.lit(-1)).alias("paragraph"), "left_hash", "right_hash")


RESULT = (
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
)
TYPES = {pa.int64(): "long", pa.string(): "string", pa.float64(): "double"}


def _row(key, text: str, mark: str, following: str, its_mark: str) -> tuple:
    """One finished row: the text against its edit and against the next document."""
    share = len(text) // 4
    edited = text[: len(text) - share] + following[:share]
    edited_mark = fingerprint(edited)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return key, len(text), digest, mark, edited_mark, likeness(mark, edited_mark), likeness(mark, its_mark)


def _batch(rows: list[tuple], fields) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.record_batch([pa.array(c, kind) for c, (_, kind) in zip(columns, fields)], names=[n for n, _ in fields])


def compare_with_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edit with the next one's beginning; likeness to both.

    Rows are dealt and sorted by (id, hash of the text), texts are shuffled once, and each task walks its rows with one
    row in hand. What a task cannot finish, its last row, meets the first row of the next task that has any: two texts
    a task, kept in a table and joined by the number of the task. The last document of all is followed by the first; a
    lone document by itself. NULL texts count as empty, rows that repeat an id follow one another in the order of their
    hashes, NULL ids come first.
    """
    extra = (("part", pa.int64()), ("role", pa.string()), ("text", pa.string()))
    fields = (*RESULT, *extra)

    def run(batches):
        from pyspark import TaskContext

        part, held, out = TaskContext.get().partitionId(), None, []
        nothing = (None,) * 3
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                mark = fingerprint(text)
                if held is None:
                    out.append((key, None, None, mark, None, None, None, part, "first", text))
                else:
                    out.append((*_row(*held, text, mark), None, "done", None))
                held = key, text, mark
                if len(out) >= 2_000:
                    yield _batch(out, fields)
                    out = []
        if held is not None:
            out.append((held[0], *nothing[:2], held[2], *nothing, part, "last", held[1]))
            yield _batch(out, fields)

    def finish(batches):
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)))
            done = [_row(*row) for row in rows]
            if done:
                yield _batch(done, RESULT)

    schema = ", ".join(f"{n} {TYPES[kind]}" for n, kind in fields)
    slim = docs.select(F.col(id_column).cast("long").alias("k"), F.col(text_column).alias("t"))
    dealt = slim.repartitionByRange("k", F.xxhash64("t")).sortWithinPartitions("k", F.xxhash64("t"), "t")
    walked = staged(dealt.mapInArrow(run, schema), "fingerprints")
    names = [n for n, _ in RESULT]
    first = walked.where("role = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_mark"))
    last = walked.where("role = 'last'").select("part", "doc_id", "text", "fingerprint")
    # One row for each task: the next task that has rows, the first one after the last.
    parts = walked.where("role = 'last'").select("part")
    order = Window.orderBy("part")
    following = F.coalesce(F.lead("part").over(order), F.first("part").over(order))
    open_rows = last.join(parts.select("part", following.alias("next_part")), "part").join(first, "next_part")
    finished = open_rows.select("doc_id", "text", "fingerprint", "next_text", "next_mark").mapInArrow(finish, ", ".join(f"{n} {TYPES[kind]}" for n, kind in RESULT))
    return walked.where("role = 'done'").select(names).unionByName(finished)
