"""Nearest neighbours over randomly rotated one-bit codes.

Vectors are centred, scaled to unit length and turned by a random rotation; a code keeps the sign of each coordinate, 64
to a word, and two scalars: the length of the centred vector and the inner product of the unit vector with its code.
From a query's rotated coordinates and the packed bits follows an estimate of the inner product whose error is bounded,
with a probability set by ``margin``, by a term of the same scalars. Bounds on the distance choose the vectors that are
compared exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindleflow.llm.common import staged


def rotation(size: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix (QR of a Gaussian one, signs fixed)."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, lengths and inner products with the code of rows of vectors."""
    moved = vectors - centre
    length = np.sqrt((moved**2).sum(axis=1))
    unit = moved / np.where(length > 0, length, 1.0)[:, None] @ turn
    packed = np.packbits(unit >= 0, axis=1)
    fit = np.abs(unit).sum(axis=1) / np.sqrt(vectors.shape[1])
    return packed, length, fit


def bounds(packed, length, fit, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds on the squared distances, a row for each query and a column for each code."""
    size = queries.shape[1]
    moved = queries - centre
    far = np.sqrt((moved**2).sum(axis=1))
    unit = (moved / np.where(far > 0, far, 1.0)[:, None] @ turn).astype(np.float32)
    signs = np.unpackbits(packed, axis=1)[:, :size].astype(np.float32) * 2 - 1
    product = unit @ signs.T / np.float32(np.sqrt(size))
    safe = np.where(fit > 0, fit, 1.0)
    angle = product / safe
    slack = margin * np.sqrt(np.maximum(1 - safe**2, 0) / safe**2 / max(1, size - 1)) + 1e-5
    base = length[None, :] ** 2 + far[:, None] ** 2
    scale = 2 * far[:, None] * length[None, :]
    return base - scale * (angle + slack), base - scale * (angle - slack)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows with rows; components are added from the first to the last, so every engine gets the same digits."""
    out = np.zeros(len(a))
    for place in range(a.shape[1]):
        out += (a[:, place] - b[:, place]) ** 2
    return out


def smallest(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest scores, ties to the smaller id."""
    return np.lexsort((ids, scores))[:k]


def usable(column: str) -> F.Column:
    """Whether a vector is there, has no NULL and no component that is not finite, and is not all zeros."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def build(vectors: DataFrame, seed: int = 7, sample: int = 20_000, id_column: str = "vec_id", vector_column: str = "embedding") -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The table of codes of all usable rows, and the centre and rotation they were made with.

    Columns: vec_id, vector (doubles), code, length, fit. Rows are coded in Arrow batches, each by itself. The centre is
    the mean of at most ``sample`` rows, the first in hash order; it only moves the codes' accuracy. All vectors must be
    of one size: rows of another size than the most common of the sample raise.
    """
    slim = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    slim = slim.where(F.col("vec_id").isNotNull() & usable("vector"))
    some = slim.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").toPandas()["vector"]
    size = int(some.map(len).mode()[0]) if len(some) else 1
    centre = np.mean([v for v in some if len(v) == size], axis=0) if len(some) else np.zeros(size)
    turn = rotation(size, seed)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(1)
            table = flat.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            if table.shape[1] != size:
                raise ValueError(f"vectors of {table.shape[1]} and of {size} components")
            packed, length, fit = encode(table, centre, turn)
            yield pa.record_batch(
                [batch.column(0), flat, pa.array([row.tobytes() for row in packed], pa.binary()), pa.array(length), pa.array(fit)],
                names=["vec_id", "vector", "code", "length", "fit"],
            )

    codes = slim.mapInArrow(run, "vec_id long, vector array<double>, code binary, length double, fit double")
    return staged(codes, "codes"), centre, turn


def search(vectors: DataFrame, every: int = 100, k: int = 10, margin: float = 4.0, query_block: int = 8_192, scan_rows: int = 4_096, id_column: str = "vec_id", vector_column: str = "embedding", **options) -> DataFrame:
    """The k nearest rows of each row whose id is divisible by ``every``: query_id, rank, vec_id, score (distance).

    Codes are scanned once for each block of ``query_block`` queries (a bounded broadcast: the block, never the table).
    A task keeps k rows for each query of the block and drops what cannot come before them, so it sends on at most k
    rows a query, whatever it reads. A row repeated under one id counts once for each time it is there, but a query's
    own id never. Vectors that are NULL, zero or not finite take no part; an empty table gives no row.
    """
    codes, centre, turn = build(vectors, id_column=id_column, vector_column=vector_column, **options)
    asked = codes.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "vector").distinct()
    numbered = staged(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-asked.count() // query_block))))), "queries", "block")
    blocks = sorted(r[0] for r in numbered.select("block").distinct().collect())
    out = None
    for block in blocks:
        got = numbered.where(F.col("block") == block).select("vec_id", "vector").orderBy("vec_id").toPandas()
        shared = codes.sparkSession.sparkContext.broadcast((got["vec_id"].to_numpy(np.int64), np.stack(got["vector"].to_numpy()).astype(np.float64)))

        def run(batches, shared=shared):
            names, queries = shared.value
            best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in names]
            worst = np.full(len(names), np.inf)
            for batch in batches:
                for begin in range(0, batch.num_rows, scan_rows):
                    part = batch.slice(begin, scan_rows)
                    ids, length, fit = (part.column(c).to_numpy() for c in (0, 3, 4))
                    table = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    packed = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                    for first in range(0, len(names), 512):
                        rows = slice(first, first + 512)
                        low, high = bounds(packed, length, fit, queries[rows], centre, turn, margin)
                        own = names[rows, None] == ids[None, :]
                        low[own] = high[own] = np.inf
                        # No more than k rows can be nearer than the k-th smallest upper bound.
                        if part.num_rows > k:
                            limit = np.minimum(worst[rows], np.partition(high, k - 1, axis=1)[:, k - 1])
                        else:
                            limit = worst[rows]
                        q, v = np.nonzero((low <= limit[:, None]) & ~own)
                        exact = np.empty(len(q))
                        for at in range(0, len(q), 200_000):
                            step = slice(at, at + 200_000)
                            exact[step] = squared_distances(queries[rows][q[step]], table[v[step]])
                        cuts = np.searchsorted(q, np.arange(len(low) + 1))
                        for n in np.flatnonzero(np.diff(cuts)):
                            mine = slice(cuts[n], cuts[n + 1])
                            scores = np.concatenate([best[first + n][0], exact[mine]])
                            found = np.concatenate([best[first + n][1], ids[v[mine]]])
                            keep = smallest(scores, found, k)
                            best[first + n] = scores[keep], found[keep]
                            if len(keep) == k:
                                worst[first + n] = scores[keep[-1]] * (1 + 1e-9) + 1e-12
            for n in range(0, len(names), 1_000):
                some = range(n, min(n + 1_000, len(names)))
                sizes = [len(best[i][0]) for i in some]
                yield pa.record_batch(
                    [
                        pa.array(np.repeat(names[n : n + 1_000], sizes)), pa.array(np.concatenate([best[i][1] for i in some])),
                        pa.array(np.concatenate([best[i][0] for i in some])),
                    ],
                    names=["query_id", "vec_id", "squared"],
                )

        found = codes.select("vec_id", "vector", "code", "length", "fit").mapInArrow(run, "query_id long, vec_id long, squared double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return codes.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # Partial top-k lists of the tasks: at most k rows for each query and task.
    listed = out.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("squared", "vec_id"))), 1, k).alias("near"))
    ranked = listed.select("query_id", F.posexplode("near").alias("place", "n"))
    return ranked.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("vec_id"), F.sqrt("n.squared").alias("score"))


def search_sql(table: str = "embeddings", every: int = 100, k: int = 10) -> str:
    """Exact search in DuckDB."""
    return f"""
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM {table}
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])))) AS score
  FROM v q JOIN v c ON q.vec_id % {every} = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {k}
"""
