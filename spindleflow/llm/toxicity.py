"""Toxicity by class-conditional Kneser-Ney models.

Expressions (words) are spelled by two character models, one learnt from toxic and one from ordinary documents. Both
interpolate absolute-discounted counts of their own class down to the counts of both classes together: below three
letters the number of distinct words that show a pair of letters, shared by the classes, smooths what is rare in
either. A word's evidence is the difference of its two log-likelihoods. A document compares its length-normalised
log-likelihoods as a whole (mean per word) and in its worst expressions; a logistic curve fitted on labelled documents
outside the models' counts turns these into a score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindleflow.llm.common import crc32_of, staged, text_chunks

WORDS = re.compile(r"[^\W\d_]+")
BASE = 0x9E3779B97F4A7C15


@dataclass
class Table:
    """Counts by hashed letters: sorted keys and a row of values for each."""

    keys: np.ndarray
    values: np.ndarray

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros((len(keys), self.values.shape[1]), self.values.dtype)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys)[:, None], self.values[at], 0)

    @classmethod
    def of(cls, keys: np.ndarray, weights: np.ndarray) -> Table:
        """Sums of the weights by key."""
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], weights[order]
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        sums = np.add.reduceat(weights, heads, axis=0) if len(keys) else weights
        return cls(keys[heads], sums.astype(np.float32))

    @classmethod
    def joined(cls, tables: list[Table]) -> Table:
        """One table of tables that share no key."""
        keys = np.concatenate([t.keys for t in tables])
        order = np.argsort(keys)
        return cls(keys[order], np.concatenate([t.values for t in tables])[order])


def spell(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all words, each between two marks; the place of each letter in its word; the word of each letter."""
    letters = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int32, len(words)) + 2
    word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    return letters, np.arange(len(letters), dtype=np.int32) - np.repeat(np.cumsum(sizes, dtype=np.int32) - sizes, sizes), word


def hashes(letters: np.ndarray, order: int):
    """For each length from 1 to ``order``, a hash of the letters that end at each place (wrong before a word's start)."""
    power, held = 1, np.zeros_like(letters)
    for length in range(1, order + 1):
        more = np.ones(len(letters), np.uint64)
        more[length - 1 :] += letters[: max(0, len(letters) - length + 1)]
        more *= np.uint64(power)
        more += held
        held = more
        power = power * BASE % 2**64
        yield held


@dataclass
class KneserNey:
    """Both classes' letter models. Columns of all tables: ordinary, toxic (grams); and totals, then types (contexts)."""

    order: int
    discount: float
    letters: int
    shared: list[tuple[Table, Table]] = field(default_factory=list)
    classes: list[tuple[Table, Table]] = field(default_factory=list)

    @classmethod
    def fit(cls, words: list[str], counts: np.ndarray, order: int = 7, discount: float = 0.75, least: int = 2) -> KneserNey:
        """``counts``: occurrences of each word in ordinary and in toxic text. Grams seen less than ``least`` times in
        all are left to the lower orders; their context's totals still count them."""
        letters, place, word = spell(words)
        counts = counts.astype(np.float32)
        model, shorter = cls(order, discount, len(np.unique(letters)) + 1), None
        for length, keys in enumerate(hashes(letters, order), 1):
            at = np.flatnonzero(place >= max(1, length - 1)).astype(np.int32)
            if length == 1:
                grams, total = np.unique(keys[at], return_counts=True)
                counted = Table(grams, total.astype(np.float32)[:, None]), Table(np.zeros(1, np.uint64), np.array([[len(at), len(grams)]], np.float32))
                model.shared.append(counted)
                shorter = keys
                continue
            shares = (shorter[at - 1] * np.uint64(BASE) >> np.uint64(60)).astype(np.uint8)
            tables = []
            for share in range(16):  # all grams of a context are in one share
                some = at[shares == share]
                weights = np.ones((len(some), 1), np.float32) if length == 2 else counts[word[some]]
                tables.append(cls._counted(keys[some], shorter[some - 1], weights, least if length > 2 else 0))
            shorter = keys
            del at, shares, some, weights
            grams, contexts = (Table.joined([t[k] for t in tables]) for k in (0, 1))
            (model.shared if length <= 2 else model.classes).append((grams, contexts))
        return model

    @staticmethod
    def _counted(gram: np.ndarray, before: np.ndarray, weights: np.ndarray, least: int) -> tuple[Table, Table]:
        """Tables of grams and of contexts, without those seen less than ``least`` times in all."""
        contexts = Table.of(before, weights)
        grams, first = Table.of(gram, weights), np.unique(gram, return_index=True)[1]
        kinds = Table.of(before[first], (grams.values > 0).astype(np.float32))
        # Both are sorted by the same contexts.
        values = np.concatenate([contexts.values, kinds.values], axis=1)
        often, seen = grams.values.sum(axis=1) >= least, contexts.values.sum(axis=1) >= least
        return Table(grams.keys[often], grams.values[often]), Table(contexts.keys[seen], values[seen])

    def plain(self) -> tuple:
        """The model as bare numbers and arrays: executors need not have this package to unpickle a broadcast of it."""
        tables = [[(a.keys, a.values, b.keys, b.values) for a, b in pairs] for pairs in (self.shared, self.classes)]
        return self.order, self.discount, self.letters, *tables

    @classmethod
    def of_plain(cls, parts: tuple) -> KneserNey:
        tables = [[(Table(a, b), Table(c, d)) for a, b, c, d in pairs] for pairs in parts[3:]]
        return cls(*parts[:3], *tables)

    def evidence(self, words: list[str]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of each word."""
        if not words:
            return np.zeros(0)
        letters, place, word = spell(words)
        keys = list(hashes(letters, self.order))
        at = np.flatnonzero(place >= 1)
        p = np.full(len(at), 1.0 / self.letters)
        for length, (grams, contexts) in enumerate(self.shared, 1):
            before = keys[0][at - 1] if length > 1 else np.zeros(len(at), np.uint64)
            total, kinds = contexts.find(before).T.astype(np.float64)
            own = np.maximum(grams.find(keys[length - 1][at])[:, 0] - self.discount, 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                p = np.where(total > 0, own / total + self.discount * kinds / total * p, p)
        both = np.stack([p, p], axis=1)
        live = np.arange(len(at))
        for length, (grams, contexts) in enumerate(self.classes, 3):
            live = live[place[at[live]] >= length - 1]
            found = contexts.find(keys[length - 2][at[live] - 1]).astype(np.float64)
            known = found[:, :2].sum(axis=1) > 0
            live, found = live[known], found[known]
            if not len(live):
                break
            total, kinds = found[:, :2], found[:, 2:]
            own = np.maximum(grams.find(keys[length - 1][at[live]]) - self.discount, 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                mixed = own / total + self.discount * kinds / total * both[live]
            both[live] = np.where(total > 0, mixed, both[live])
        return np.bincount(word[at], np.log(both[:, 1]) - np.log(both[:, 0]), len(words))


FEATURES = ("mean", "worst", "worst_three", "log_words")


def document_features(texts: list[str], model: KneserNey, known: dict, evidence: list, keep: int = 300_000) -> np.ndarray:
    """Evidence of whole texts: mean per word, the worst word, the mean of the worst three, log of one plus the words."""
    out = np.zeros((len(texts), len(FEATURES)))
    for begin, end in text_chunks(texts):
        if len(known) > keep:
            known.clear()
            evidence.clear()
        split = [WORDS.findall(t.lower()) for t in texts[begin:end]]
        fresh = list({w for s in split for w in s}.difference(known))
        for k in range(0, len(fresh), 20_000):
            some = fresh[k : k + 20_000]
            known.update(zip(some, range(len(evidence), len(evidence) + len(some))))
            evidence.extend(model.evidence(some).tolist())
        held = np.array(evidence)
        for row, words in enumerate(split, begin):
            if words:
                x = held[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]
                worst = np.sort(x[np.argpartition(x, -3)[-3:]] if len(x) > 3 else x)
                out[row] = x.mean(), worst[-1], worst.sum() / 3, np.log1p(len(x))
    return out


@dataclass
class Classifier:
    """The letter models and the curve over the document features; without both classes, one constant score."""

    model: KneserNey | None
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    constant: float = 0.0

    def score(self, features: np.ndarray) -> np.ndarray:
        z = (features - self.centre) / self.scale @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def column(self, docs: DataFrame, text_column: str = "text") -> Column:
        """The score of each row's whole text. The model travels as a broadcast; its size is bounded by the sample."""
        if self.model is None:
            return F.lit(self.constant)
        shared = docs.sparkSession.sparkContext.broadcast(self.model.plain())
        curve = Classifier(None, self.centre, self.scale, self.weights)

        def run(series):
            model, known, evidence = KneserNey.of_plain(shared.value), {}, []
            for texts in series:
                listed = [t if isinstance(t, str) else "" for t in texts]
                yield pd.Series(curve.score(document_features(listed, model, known, evidence)))

        from collections.abc import Iterator

        run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, "double")(F.coalesce(F.col(text_column), F.lit("")))


def fit_curve(features: np.ndarray, label: np.ndarray, ridge: float = 0.05) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, scale and weights of a ridge-penalised logistic curve (Newton steps)."""
    centre, scale = features.mean(axis=0), features.std(axis=0)
    scale[scale == 0] = 1
    x = np.concatenate([np.ones((len(label), 1)), (features - centre) / scale], axis=1)
    w, penalty = np.zeros(x.shape[1]), np.diag([0.0] + [ridge] * features.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (label - p) - penalty @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return centre, scale, w


def learn(
    docs: DataFrame, labels: DataFrame, sample_docs: int = 3_000, sample_chars: int = 20_000, order: int = 7,
    id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
) -> Classifier:
    """Fit on labelled rows whose crc32(id as text) mod 5 is not 0: remainders 1 to 3 feed the models, 4 the curve.

    The fit takes a bounded sample: of each class and purpose the first ``sample_docs`` ids of documents in hash order, or
    as many of them as first reach ``sample_docs`` times ``sample_chars`` characters; a text of any length is taken whole,
    and a label without a document takes no place. Labels that are NULL are ignored, of repeated ids the highest counts.
    Without documents of both classes the score is the share of toxic labels (0 without labels).
    """
    fold = F.pmod(crc32_of(id_column), F.lit(5))
    named = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull()).groupBy(id_column)
    named = named.agg(F.max(F.col(label_column).cast("int")).alias("y")).where(fold != 0).withColumn("curve", fold == 4)
    texts = docs.select(F.col(id_column), F.coalesce(F.col(text_column), F.lit("")).alias("t"))
    sizes = texts.select(id_column, F.length("t").alias("chars"))  # no text enters the exchange
    known = sizes.join(named, id_column).groupBy(id_column, "y", "curve").agg(F.sum("chars").alias("chars"))
    known = staged(known, "labelled")
    picks = []
    for y in (0, 1):
        for curve in (False, True):
            order_of = [F.xxhash64(id_column), F.col(id_column)]
            some = known.where((F.col("y") == y) & (F.col("curve") == curve)).orderBy(*order_of).limit(sample_docs)
            before = F.sum("chars").over(Window.orderBy(*order_of)) - F.col("chars")
            picks.append(some.withColumn("before", before).where(F.col("before") < sample_docs * sample_chars).drop("before", "chars"))
    picked = picks[0].unionAll(picks[1]).unionAll(picks[2]).unionAll(picks[3])
    sample = texts.join(picked, id_column).select("t", "y", "curve")

    def count(batches):
        from collections import Counter

        for batch in batches:
            held = [Counter(), Counter()]
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[y].update(WORDS.findall(text.lower()))
            for y in (0, 1):
                yield pa.record_batch(
                    [pa.array(list(held[y]), pa.string()), pa.array([y] * len(held[y]), pa.int32()), pa.array(list(held[y].values()), pa.int64())],
                    names=["word", "y", "n"],
                )

    counted = sample.where(~F.col("curve")).select("t", "y").mapInArrow(count, "word string, y int, n long")
    table = counted.groupBy("word").agg(
        F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("ordinary"), F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("toxic")
    )
    table = table.toArrow().sort_by("word")
    words, counts = table["word"].to_pylist(), np.stack([table[c].to_numpy().astype(np.float32) for c in ("ordinary", "toxic")], axis=1)
    del table
    if not words or not (counts.sum(axis=0) > 0).all():
        share = named.agg(F.avg("y")).first()[0]
        return Classifier(None, np.zeros(0), np.zeros(0), np.zeros(0), float(share or 0.0))
    model = KneserNey.fit(words, counts, order)
    shared = docs.sparkSession.sparkContext.broadcast(model.plain())

    def features(batches):
        own, known, evidence = KneserNey.of_plain(shared.value), {}, []
        for batch in batches:
            x = document_features(batch.column(0).to_pylist(), own, known, evidence)
            yield pa.record_batch([*(pa.array(x[:, k]) for k in range(x.shape[1])), batch.column(1)], names=[*FEATURES, "y"])

    schema = ", ".join([*(f"{f} double" for f in FEATURES), "y int"])
    held = sample.where("curve").select("t", "y").mapInArrow(features, schema).toPandas()
    if held["y"].nunique() < 2:
        held = sample.select("t", "y").mapInArrow(features, schema).toPandas()
    held = held.sort_values(list(held.columns))  # the order of rows changes no digit of the fit
    return Classifier(model, *fit_curve(held[list(FEATURES)].to_numpy(), held["y"].to_numpy(np.float64)))


def score_documents(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """Columns id, held_out, score and predicted for every row; NULL texts count as empty, repeated rows score alike."""
    classifier = learn(docs, labels, id_column=id_column, text_column=text_column, **options)
    held = F.pmod(crc32_of(id_column), F.lit(5)) == 0
    scored = docs.select(F.col(id_column), held.alias("held_out"), classifier.column(docs, text_column).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
