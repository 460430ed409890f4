"""Boosted trees over counted cells: a tree sees a row through its bins only, so rows alike in all bins are one cell.

Rows are counted by cell and label over the whole table.  However many rows there are, the trees are grown from these
counts, all rounds of a label in one task and the labels beside one another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindleflow.operators.staging import staged

BINS = 32  # of a feature, as in Spark ML's trees
POINTS = 1024  # steps between the quantiles that stand for a feature's values of one label
CELLS = 1 << 19  # what one task grows trees from
KNOWN = 1 << 17  # cells whose scores a partition keeps
_NO_SPLIT = 255


@dataclass
class Forest:
    """Edges of each feature's bins and, by label, the trees: for each round the feature and bin of every node, level by
    level, and the value of every leaf, to be added up."""

    edges: list[list[float]]
    features: list[list[list[int]]]
    bins: list[list[list[int]]]
    values: list[list[list[float]]]

    def scores(self, columns: list[Column]) -> Column:
        """One probability for each label, against the rest.  A cell is scored once in a partition."""
        edges = [np.array(e, np.float64) for e in self.edges]
        trees = [(np.array(f), np.array(b), np.array(v)) for f, b, v in zip(self.features, self.bins, self.values)]

        def run(batches):
            known, found = {}, np.zeros((0, len(trees)))
            for batch in batches:
                bins = _binned(batch, edges)
                cells, first, where = np.unique(_as_cells(bins), return_index=True, return_inverse=True)
                if len(known) > KNOWN:
                    known, found = {}, found[:0]
                cells = cells.tolist()
                fresh = [i for i, cell in enumerate(cells) if cell not in known]
                if fresh:
                    known.update(zip([cells[i] for i in fresh], range(len(known), len(known) + len(fresh))))
                    margins = np.stack([_margins(bins[first[fresh]], *tree) for tree in trees], 1)
                    found = np.concatenate([found, 1.0 / (1.0 + np.exp(-2.0 * margins))])
                places = np.array([known[cell] for cell in cells], np.int64)[where.ravel()]
                offsets = np.arange(len(batch) + 1, dtype=np.int32) * len(trees)
                yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(found[places].ravel()))

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, "array<double>")(_inputs(columns))


def _inputs(columns: list[Column]) -> Column:
    return F.array(*[c.cast("double") for c in columns])


def _binned(rows: pa.Array, edges: list[np.ndarray]) -> np.ndarray:
    """For each row and feature, how many edges lie below the value."""
    x = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), len(edges))
    if np.isnan(x).any():
        raise ValueError("a feature is NULL or NaN")
    return np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], 1).astype(np.uint8)


def _as_cells(bins: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(bins).view(f"V{bins.shape[1]}").ravel()


def _margins(cells: np.ndarray, features: np.ndarray, bins: np.ndarray, values: np.ndarray) -> np.ndarray:
    n, wide = cells.shape
    flat, start = cells.ravel(), np.arange(n) * wide
    out = np.zeros(n)
    for f, b, v in zip(features, bins, values):
        node = np.zeros(n, np.int64)
        for _ in range(len(v).bit_length() - 1):
            node = 2 * node + 1 + (flat[start + f[node]] > b[node])
        out += v[node - len(f)]
    return out


def bin_edges(df: DataFrame, features: tuple[str, ...], label: str) -> list[list[float]]:
    """Edges between neighbouring values of each feature: all of them, or at even shares where each label counts alike.

    A label's values are its quantiles over all rows, so a label sends a thousand numbers a feature to the driver.
    """
    shares = F.expr(f"array({', '.join(f'{i / POINTS!r}D' for i in range(POINTS + 1))})")  # one call to the JVM
    quantiles = [F.percentile_approx(F.col(f).cast("double"), shares, 10_000).alias(f"q{i}") for i, f in enumerate(features)]
    found = df.groupBy(label).agg(*quantiles).collect()
    return [_edges(np.concatenate([r[f"q{i}"] or [] for r in found])) for i in range(len(features))]


def _edges(points: np.ndarray) -> list[float]:
    values, counts = np.unique(points, return_counts=True)
    upto = np.cumsum(counts)
    cuts = np.arange(len(values) - 1)
    if len(cuts) >= BINS:
        shares = np.arange(1, BINS) * (upto[-1] / BINS)
        cuts = np.unique(np.abs(upto[:-1, None] - shares).argmin(0))
    with np.errstate(over="ignore", invalid="ignore"):
        middle = (values[cuts] + values[cuts + 1]) / 2.0
    return np.where(np.isfinite(middle), middle, values[cuts]).tolist()


def count_cells(
    df: DataFrame, features: tuple[str, ...], label: str, classes: list[int], edges: list[list[float]]
) -> DataFrame:
    """``cell`` (a byte for each feature's bin) and how many of its rows have each label: ``n0``, ``n1``, .."""
    held = [np.array(e, np.float64) for e in edges]

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, where = np.unique(_as_cells(_binned(batch["x"], held)), return_inverse=True)
            place = np.searchsorted(classes, batch["y"].to_numpy())
            rows = np.bincount(where.ravel() * len(classes) + place, minlength=len(cells) * len(classes))
            rows = rows.reshape(-1, len(classes))
            yield pa.RecordBatch.from_pydict({"cell": pa.array(cells.tolist(), pa.binary()), **{f"n{j}": r for j, r in enumerate(rows.T)}})

    names = [f"n{j}" for j in range(len(classes))]
    slim = df.select(_inputs([F.col(f) for f in features]).alias("x"), F.col(label).cast("long").alias("y"))
    counted = slim.mapInArrow(tally, ", ".join(["cell binary", *[f"{n} long" for n in names]]))
    return staged(counted.groupBy("cell").agg(*[F.sum(n).alias(n) for n in names]), "cells")


def grow(
    cells: DataFrame, weights: list[float], edges: list[list[float]], max_iter: int, step: float, depth: int, min_rows: int
) -> Forest:
    """Trees of each label against the rest."""
    many, wide = len(weights), len(edges)

    def fit(table: pa.Table) -> pa.Table:
        one = table["_class"][0].as_py()
        bins = np.frombuffer(b"".join(table["cell"].to_pylist()), np.uint8).reshape(-1, wide)
        rows = np.stack([table[f"n{j}"].to_numpy() for j in range(many)], 1).astype(np.float64)
        order = np.lexsort(bins.T)  # sums do not depend on how cells arrive
        bins, rows = bins[order], rows[order]
        mass = rows * weights
        trees = _boost(bins, mass[:, one], np.delete(mass, one, 1).sum(1), rows.sum(1), max_iter, step, depth, min_rows)
        kinds = (pa.int32(), pa.int32(), pa.float64())
        found = [pa.array([v.tolist()], pa.list_(pa.list_(kind))) for v, kind in zip(trees, kinds)]
        return pa.table([pa.array([one], pa.int32()), *found], ["_class", "features", "bins", "trees"])

    shared = cells.withColumn("_class", F.explode(F.array(*[F.lit(j) for j in range(many)])))
    schema = "_class int, features array<array<int>>, bins array<array<int>>, trees array<array<double>>"
    # A task for each label.
    grown = shared.repartitionByRange(many, "_class").groupBy("_class").applyInArrow(fit, schema).collect()
    grown.sort(key=lambda r: r["_class"])
    return Forest(edges, [r["features"] for r in grown], [r["bins"] for r in grown], [r["trees"] for r in grown])


def _boost(
    cells: np.ndarray, yes: np.ndarray, no: np.ndarray, rows: np.ndarray, max_iter: int, step: float, depth: int, min_rows: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trees as Spark ML's ``GBTClassifier`` grows them: the first on the labels -1 and 1, each later one on the slope
    of the log loss, scaled by ``step``; splits by the largest fall in variance.

    ``yes`` and ``no`` are the weights of a cell's rows of the label and of the rest.
    """
    inner, leaves = 2**depth - 1, 2**depth
    features, splits = np.zeros((max_iter, inner), int), np.full((max_iter, inner), _NO_SPLIT)
    values, margin, weight = np.zeros((max_iter, leaves)), np.zeros(len(cells)), yes + no
    columns = [np.ascontiguousarray(c, np.int64) for c in cells.T]
    for k in range(max_iter):
        if k:
            far = np.exp(2.0 * margin)
            pull = 4.0 * (yes / (1.0 + far) - no / (1.0 + 1.0 / far))
        else:
            pull = yes - no
        node = np.zeros(len(cells), np.int64)
        for level in range(depth):
            n, base = 2**level, 2**level - 1
            slots = [node * BINS + c for c in columns]
            # Sums left of each split: (weight, pull, rows) x node x feature x bin.
            left = np.stack([[np.bincount(s, x, n * BINS) for s in slots] for x in (weight, pull, rows)])
            left = left.reshape(3, len(columns), n, BINS).swapaxes(1, 2).cumsum(3)
            whole = left[:, :, :1, -1:]
            right = whole - left
            fits = (left[2] >= min_rows) & (right[2] >= min_rows)
            with np.errstate(divide="ignore", invalid="ignore"):
                least = whole[1] ** 2 / whole[0]
                gain = np.where(fits, left[1] ** 2 / left[0] + right[1] ** 2 / right[0] - least, -np.inf).reshape(n, -1)
            best = gain.argmax(1)
            split = gain[np.arange(n), best] > 1e-12 * np.nan_to_num(least[:, 0, 0])
            f, b = np.where(split, best // BINS, 0), np.where(split, best % BINS, _NO_SPLIT)
            features[k, base : base + n], splits[k, base : base + n] = f, b
            node = 2 * node + (cells[np.arange(len(cells)), f[node]] > b[node])
        mass, total = np.bincount(node, weight, leaves), np.bincount(node, pull, leaves)
        values[k] = np.divide(total, mass, out=np.zeros(leaves), where=mass > 0) * (step if k else 1.0)
        margin += values[k][node]
    return features, splits, values
