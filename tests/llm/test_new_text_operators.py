"""Resampling, clustering and the lexicon against SQL, loops and the library, and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from oracle import compare, connect
from spindleflow.llm import centroids, lexicon, resampling
from spindleflow.llm.common import tokenizer_path

LONG = " ".join(f"word{n % 977} filler" for n in range(40_000))
TEXTS = [
    (1, "Hello World, the end; don't 'start O'Neill 12"),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, LONG),
    (6, "same text here and there again " * 5),
    (6, "same text here and there again " * 5),
    (7, "same text here and there again " * 5),
    (None, "a row without an id " * 6),
    (8, "日本語 ▁ 😀 \x00 é É× <|endoftext|>x 'S"),
    (9, "x" * 30_000 + " " + "日本" * 3_000),
]


@pytest.fixture(scope="module")
def awkward(spark):
    schema = "doc_id long, text string, vec_id int, t string, v string, n_words string, bucket int, rank string, score string, word string, n string, ids int"
    return spark.createDataFrame([(*r, 1, "t", "v", "w", 3, "r", "s", "w", "n", 4) for r in TEXTS], schema)


# Resampling


def test_checksums_equal_zlib():
    rng = random.Random(4)
    words = [rng.randbytes(n) for n in (*range(40), 1023, 1024, 1025, 2048, 9_999)] * 2
    data = np.frombuffer(b"".join(words), np.uint8)
    sizes = np.array([len(w) for w in words])
    got = resampling.crc_buckets(np.cumsum(sizes) - sizes, sizes, data, 10_000)
    assert got.tolist() == [zlib.crc32(w) % 10_000 for w in words]


def test_resampling_equals_sql(spark, sf):
    name = "op11_resampling"
    assert compare(spark, connect(sf), entry.queries()[name], entry.oracle_sql()[name], sf) == ""


def features(text, runs):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, runs + 1) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("runs", [1, 3])
def test_resampling_on_awkward_rows(spark, awkward, runs):
    target = spark.createDataFrame([("same text", 1), (None, 2), ("here and there the end", 3)], "text string, doc_id int")
    found = resampling.resample(awkward, target, runs=runs, buckets=97, percent=50, least_words=5).collect()
    code = lambda f: zlib.crc32(f.encode()) % 97
    raw, aim = Counter(), Counter()
    for _, text in TEXTS:
        raw.update(map(code, features(text, runs)[1]))
    for text in ("same text", "here and there the end"):
        aim.update(map(code, features(text, runs)[1]))
    s, t = sum(raw.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (s + 97) / ((raw[b] + 1) * (t + 97)))) for b in range(97)]
    want = []
    for doc_id, text in TEXTS:
        words, own = features(text, runs)
        weight = sum(gain[code(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        want.append((doc_id, len(words), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    eligible = sorted((w for w in want if w[1] >= 5), key=lambda w: (-w[4], w[0] is None, w[0]))
    drawn = Counter((*w, n) for n, w in enumerate(eligible[: len(eligible) // 2], 1))
    drawn.update((*w, None) for w in eligible[len(eligible) // 2 :])
    drawn.update((*w, None) for w in want if w[1] < 5)
    assert Counter(map(tuple, found)) == drawn


def test_resampling_of_empty_tables(spark, awkward):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none).count() == 0
    assert resampling.resample(awkward, none).count() == len(TEXTS)


# Clustering


def test_clusters_equal_sql(spark, sf):
    name = "op12_centroids"
    assert compare(spark, connect(sf), entry.queries()[name], entry.oracle_sql()[name], sf) == ""


@pytest.mark.parametrize("k", [1, 2, 9, 40])
def test_orchard_search_is_exact_and_spares_distances(k):
    rng = np.random.default_rng(k)
    seeds = rng.integers(-30, 30, (k, 3))
    points = seeds[rng.integers(0, k, 3_000)] + rng.integers(-3, 4, (3_000, 3))
    at, best, measured = centroids.nearest(points, seeds, centroids.neighbour_lists(seeds))
    every = ((points[:, None] - seeds[None]) ** 2).sum(axis=2)
    assert (at == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert measured <= 3_000 * k and (k < 40 or measured < 3_000 * k * 0.7)


def brute_clusters(rows, k, rounds):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v and len(v) == 3 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    middle = [v for _, v in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(middle))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        middle = [[sum(x) // len(groups[c]) for x in zip(*groups[c])] if c in groups else m for c, m in enumerate(middle)]
    out = [(i, *nearest(v)[::-1]) for i, v in kept]
    sums = Counter()
    for _, c, d in out:
        sums[c] += d
    return [(i, c, d, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, middle[c])).encode()).hexdigest()) for i, c, d in out]


def test_clusters_of_awkward_rows(spark):
    rng = random.Random(8)
    rows = [(n, [rng.gauss(n % 4, 0.3) for _ in range(3)]) for n in range(60)]
    rows += [(3, [0.5, 0.5, 0.5])] * 3 + [(None, [1.0, -1.0, 2.0]), (70, None), (71, [1.0, 2.0]), (72, [1.0, None, 2.0]), (73, [float("nan"), 0.0, 0.0]), (74, [float("inf"), 0.0, 0.0]), (75, []), (76, [0.0] * 3)]
    table = spark.createDataFrame([(*r, 1, "v", 0.5) for r in rows], "vec_id long, embedding array<double>, cluster int, v string, distance double")
    for k in (5, 500):
        found, _ = centroids.cluster(table, k=k, rounds=4, size=3)
        assert Counter(map(tuple, found.collect())) == Counter(brute_clusters(rows, k, 4))
    assert centroids.cluster(table.where("vec_id = 70"), size=3)[0].count() == 0
    huge = spark.createDataFrame([(1, [1e300, 0.0, 0.0]), (2, [-1e300, 0.0, 0.0])], "vec_id long, embedding array<double>")
    assert centroids.cluster(huge, k=1, rounds=1, size=3)[0].count() == 2


# Lexicon


def library(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    out = []
    for text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        digests = [hashlib.sha256(s.encode()).hexdigest() for s in (" ".join(map(str, ids)), tokenizer.decode(ids, skip_special_tokens=False))]
        out.append((len(ids), *digests, ids))
    return out


def test_lexicon_equals_the_library(spark, sf):
    table = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    want = Counter((d, *w[:3]) for d, w in zip(table["doc_id"], library(table["text"])))
    assert Counter(map(tuple, entry.queries()["op13_lexicon"](spark, sf).collect())) == want


@pytest.mark.parametrize("most_words", [3, 40_000])
def test_lexicon_on_awkward_rows(spark, awkward, most_words):
    found = lexicon.encode_documents(awkward, with_ids=True, most_words=most_words)
    want = Counter((d, *w[:3], tuple(w[3])) for (d, _), w in zip(TEXTS, library([t for _, t in TEXTS])))
    assert Counter((*r[:4], tuple(r.ids)) for r in found.collect()) == want
    decoded = lexicon.decode_documents(found).select("decoded_sha256", "decoded").collect()
    assert all(hashlib.sha256(r.decoded.encode()).hexdigest() == r.decoded_sha256 for r in decoded)
    assert lexicon.encode_documents(awkward.where("doc_id < 0"), with_ids=True).count() == 0


@pytest.mark.parametrize("limit", [7, 1_000])
def test_slices_and_odd_letters_change_no_id(limit):
    rng = random.Random(limit)
    letters = [*"abcdestlmrvABC ''''  \n\t0123.,-<|>!éÉÀßñ×÷\x00\x1c\x85", "́", "日", "😀", "\xa0", "　", "ſ", "İ", "Σ", "²", "٣", "ﬁ", "<|endoftext|>", "'re", "we'll"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    column = pa.array([t.encode() for t in texts], pa.binary())
    data, begins = lexicon.binary_column(column)
    merges = lexicon.Merges(tokenizer_path("word_bpe_49k.json"))
    encoder = lexicon.SliceEncoder(tokenizer_path("word_bpe_49k.json"), lexicon.compile_lexicon([b"a", b"ab", b"'s", b"cab", b"dab"], merges))
    got = [[] for _ in texts]
    for at, to in lexicon.text_slices(data, begins, limit):
        places, sizes, _, _, ids = encoder.encode(data[at:to], lexicon._heads(begins, at, to))
        rows = np.repeat(np.searchsorted(begins, places + at, "right") - 1, sizes)
        for row, n in zip(rows.tolist(), ids().tolist()):
            got[row].append(n)
    assert got == [w[3] for w in library(texts)]


def test_frequent_words_keep_to_the_bound(spark):
    counts = spark.createDataFrame([(bytes([k]), 1000 // (k + 1)) for k in range(200)], "word binary, n long")
    for most in (0, 1, 7, 50, 500):
        found = lexicon.frequent_words(counts, most)
        assert len(found) <= most and found.sort() is None
        assert found == [bytes([k]) for k in range(len(found))] and len(found) >= min(200, most) * 0.6 - 1


def test_automaton_shares_endings_and_numbers_words():
    words = sorted({b"tap", b"taps", b"top", b"tops", b"stop", b"stops", b"s"})
    found = lexicon.minimal_automaton(words)
    asked = pa.array([*words, b"", b"ta", b"tapss", b"zebra"], pa.binary())
    assert lexicon.look_up(found, asked).tolist() == [*range(len(words)), -1, -1, -1, -1]
    # As few states as the words have different sets of endings.
    prefixes = {w[:k] for w in words for k in range(len(w) + 1)}
    assert len(found["finals"]) == len({frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes})
    assert lexicon.look_up(lexicon.minimal_automaton([]), asked).tolist() == [-1] * len(asked)
