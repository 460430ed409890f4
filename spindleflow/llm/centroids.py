"""Centroid clustering of integer vectors, assigned by Orchard's search.

Each centroid keeps the others in the order of their distance from it. A vector walks the list of the centroid it is at;
a nearer one found there (or an equally near one of a smaller number) becomes the new place and its list is walked from
the start. Centroids already met are marked and not measured again. The walk ends where the list's next centroid lies
strictly beyond twice the vector's distance: neither it nor any later one can be as near. Distances are squared and
whole, so that is exact: beyond twice the distance means beyond four times the square.

Vectors stay where they are: in every round a task adds up its vectors by centroid and sends one row for each centroid
it met; only the new centroids, a few numbers each, go back to the tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindleflow.llm.common import staged

# Larger components count as this bound, so that squared distances stay exact in 64 bits.
BOUND = 1 << 26


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows of whole numbers."""
    return ((a - b) ** 2).sum(axis=-1)


def neighbour_lists(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid all others, nearest first (ties: smaller number), and their squared distances."""
    k = len(centroids)
    apart = np.array([squared(centroids, c) for c in centroids])
    order = np.empty((k, max(0, k - 1)), np.int64)
    for c in range(k):
        ranked = np.lexsort((np.arange(k), apart[c]))
        order[c] = ranked[ranked != c]
    return order, np.take_along_axis(apart, order, axis=1)


def nearest(vectors: np.ndarray, centroids: np.ndarray, lists: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector, its squared distance, and how many distances were measured.

    All vectors walk together; each step takes every walking vector one place on in its own list.
    """
    order, apart = lists
    m, k = len(vectors), len(centroids)
    at, place = np.zeros(m, np.int64), np.zeros(m, np.int64)
    best = squared(vectors, centroids[0])
    met = np.zeros((m, k), bool)
    met[:, 0] = True
    walking, measured = np.arange(m) if k > 1 else np.zeros(0, np.int64), m
    while len(walking):
        # A vector stops at the end of a list, or where the next centroid is strictly beyond twice its distance.
        walking = walking[place[walking] < k - 1]
        walking = walking[apart[at[walking], place[walking]] <= 4 * best[walking]]
        other = order[at[walking], place[walking]]
        place[walking] += 1
        new = ~met[walking, other]
        rows, other = walking[new], other[new]
        met[rows, other] = True
        far = squared(vectors[rows], centroids[other])
        measured += len(rows)
        closer = (far < best[rows]) | ((far == best[rows]) & (other < at[rows]))
        rows = rows[closer]
        at[rows], best[rows], place[rows] = other[closer], far[closer], 0
    return at, best, measured


def whole_vectors(table: DataFrame, size: int, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """vec_id and v (array of long, floor(scale * component)) of the rows that have ``size`` finite components."""
    v = F.col(vector_column).cast("array<double>")
    kept = v.isNotNull() & (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    bounded = F.transform(v, lambda x: F.floor(F.greatest(F.least(x * float(scale), F.lit(float(BOUND))), F.lit(-float(BOUND)))))
    return table.where(kept).select(F.col(id_column).cast("long").alias("vec_id"), bounded.alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of "seed:id" (ties: smaller components), in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.v for r in vectors.orderBy(digest, "v").limit(k).select("v").collect()], np.int64)


def _tables(batch: pa.RecordBatch, size: int, step: int = 16_384):
    """The vectors of a batch as matrices of at most ``step`` rows, with where they begin."""
    table = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(batch.num_rows, size)
    for begin in range(0, batch.num_rows, step):
        yield begin, table[begin : begin + step]


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: centroids after every non-empty one is replaced by the floored mean of its vectors."""
    k, size = centroids.shape
    lists = neighbour_lists(centroids)

    def run(batches):
        sums, counts = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, table in _tables(batch, size):
                at, _, _ = nearest(table, centroids, lists)
                for c in np.unique(at):
                    sums[c] += table[at == c].sum(axis=0)
                counts += np.bincount(at, minlength=k)
        some = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(some), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], names=["c", "n", "s"])

    parts = vectors.mapInArrow(run, "c long, n long, s array<bigint>")
    # At most one row for each centroid and task; sums of all tasks may pass 64 bits.
    total = parts.groupBy("c").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)])
    out = centroids.copy()
    for row in total.collect():
        out[row.c] = [int(row[f"s{i}"]) // row.n for i in range(size)]
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance (squared) of every vector."""
    size, lists = centroids.shape[1], neighbour_lists(centroids)

    def run(batches):
        for batch in batches:
            for begin, table in _tables(batch, size):
                at, best, _ = nearest(table, centroids, lists)
                yield pa.record_batch([batch.column(0).slice(begin, len(table)), pa.array(at.astype(np.int32)), pa.array(best)], names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(
    table: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, size: int = 64, scale: int = 1024, id_column: str = "vec_id", vector_column: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """Assignments after ``rounds`` rounds of k-means on whole numbers, and the final centroids.

    Columns: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256. Vectors that are NULL, of another size
    or hold a NULL or non-finite component take no part. Repeated rows count each; a NULL id hashes as the empty text;
    fewer vectors than k make as many centroids; no vector gives no row. Scaled components beyond 2**26 count as that
    bound. Inertias beyond 64 bits are NULL. Memory of a task: k * k numbers of the neighbour lists, k marks a vector.
    """
    vectors = staged(whole_vectors(table, size, scale, id_column, vector_column), "vectors")
    centroids = first_centroids(vectors, k, seed)
    spark = table.sparkSession
    if not len(centroids):
        empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], empty), centroids.reshape(0, size)
    for _ in range(rounds):
        after = moved(vectors, centroids)
        if np.array_equal(after, centroids):
            break  # further rounds change nothing
        centroids = after
    rows = staged(assigned(vectors, centroids), "assigned")
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    each = {r.cluster: int(r.s) for r in sums.collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    fits = lambda n: n if n < 1 << 63 else None
    facts = [(c, fits(each.get(c, 0)), fits(sum(each.values())), digests[c]) for c in range(len(centroids))]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids


def cluster_sql(table: str = "embeddings", k: int = 8, rounds: int = 10, seed: int = 3, size: int = 64, scale: int = 1024) -> str:
    """The same in DuckDB: every vector meets every centroid, one step for each round."""
    parts = [
        f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor({scale} * x) AS BIGINT)) AS e FROM {table}
  WHERE embedding IS NOT NULL AND len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, e AS m FROM v ORDER BY sha256('{seed}:' || vec_id) LIMIT {k})"""
    ]
    far = f"list_sum(list_transform(range(1, {size + 1}), lambda i: (e[i] - m[i]) * (e[i] - m[i])))"
    for r in range(rounds + 1):
        parts.append(
            f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, any_value(e) AS e, min(struct_pack(d := d, c := c)) AS best FROM (SELECT vec_id, e, c, CAST({far} AS BIGINT) AS d FROM v, c{r}) GROUP BY vec_id)"""
        )
        if r < rounds:
            parts.append(
                f"""
c{r + 1} AS MATERIALIZED (
  SELECT c, coalesce(n.m, c{r}.m) AS m FROM c{r} LEFT JOIN (
    SELECT c, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS m FROM (
      SELECT best.c AS c, i, CAST(sum(e[i]) AS DOUBLE) AS s, count(*) AS n FROM a{r}, range(1, {size + 1}) t(i) GROUP BY 1, 2) GROUP BY c) n USING (c))"""
            )
    return (
        ",".join(parts)
        + f"""
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c = best.c
"""
    )
