"""k-means by Lloyd steps on partial sums, with a k-means|| start.

Only the centres (k x d numbers, and about ``2 k`` candidates per seeding round)
travel to the tasks; a task passes on its sums per centre, never its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiscope.operators.similarity import vector_rows

ROUNDS = 5
ROWS_AT_ONCE = 4096


@dataclass
class Clusters:
    centers: np.ndarray
    iterations: int
    cost: float


def nearest(x: np.ndarray, centers: np.ndarray, digits: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """(centre, squared distance) of each row; distances equal to ``digits`` places count as ties, the first centre wins."""
    best, at = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
    for c, center in enumerate(centers):
        d = np.round(((x - center) ** 2).sum(axis=1), digits)
        closer = d < best
        best[closer], at[closer] = d[closer], c
    return at, best


def _slices(batches: Iterator[pa.RecordBatch], dim: int, column: int = 0):
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(a, ROWS_AT_ONCE)
            yield part, vector_rows(part.column(column), dim)


def _sums(vectors: DataFrame, centers: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Per centre the sum and the number of its rows, the cost, and the sum of squared norms."""
    k, dim = centers.shape

    def run(batches):
        held = np.zeros((k, dim + 3))
        for _, x in _slices(batches, dim):
            at, cost = nearest(x, centers, digits)
            for c in np.unique(at).tolist():
                own = at == c
                held[c] += np.concatenate([x[own].sum(axis=0), [own.sum(), cost[own].sum(), (x[own] ** 2).sum()]])
        used = np.flatnonzero(held[:, dim])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(list(held[used]), pa.list_(pa.float64()))],
                                         names=["c", "v"])

    found = (vectors.mapInArrow(run, "c long, v array<double>").select("c", F.posexplode("v").alias("i", "x"))
             .groupBy("c", "i").agg(F.sum("x").alias("x")).collect())  # at most k x (d + 3) numbers
    total = np.zeros((k, dim + 3))
    for r in found:
        total[r["c"], r["i"]] = r["x"]
    return total[:, :dim], total[:, dim], float(total[:, dim + 1].sum()), float(total[:, dim + 2].sum())


def farthest(vectors: DataFrame, centers: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` rows farthest from their centre (equals: by their values)."""
    dim = centers.shape[1]

    def run(batches):
        for part, x in _slices(batches, dim):
            _, d = nearest(x, centers)
            top = np.lexsort((*x.T[::-1], -d))[:n]
            yield pa.RecordBatch.from_arrays([pa.array(d[top]), part.column(0).take(pa.array(top))], names=["d", "v"])

    rows = vectors.mapInArrow(run, "d double, v array<double>").orderBy(F.desc("d"), "v").limit(n).collect()
    return np.array([r["v"] for r in rows]).reshape(-1, dim)


def lloyd(df: DataFrame, vec_col: str, centers: np.ndarray, max_iter: int = 300, tol: float = 1e-4,
          digits: int = 9) -> Clusters:
    """Lloyd steps from ``centers`` until they move by no more than ``tol`` times the mean variance.

    A centre without rows moves to the row farthest from its centre.  Ends after
    ``max_iter`` steps at the latest (``iterations`` tells).
    """
    vectors = df.select(F.col(vec_col).cast("array<double>").alias("v")).filter("v is not null")
    centers = np.asarray(centers, np.float64)
    cost = float("nan")
    for step in range(1, max_iter + 1):
        sums, counts, cost, squares = _sums(vectors, centers, digits)
        n = counts.sum()
        if not n:
            return Clusters(centers, step, 0.0)
        moved = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
        empty = np.flatnonzero(counts == 0)
        if len(empty):
            far = farthest(vectors, centers, len(empty))
            moved[empty[:len(far)]] = far
        mean = sums.sum(axis=0) / n
        variance = max(0.0, squares / n - (mean ** 2).sum()) / centers.shape[1]
        shift = ((moved - centers) ** 2).sum()
        centers = moved
        if shift <= tol * variance:
            break
    return Clusters(centers, step, cost)


def seeds(df: DataFrame, id_col: str, vec_col: str, k: int, seed: int = 42, rounds: int = ROUNDS) -> np.ndarray:
    """``k`` start centres: candidates drawn by their share of the cost in a few rounds (k-means||), then weighted k-means++."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter("v is not null")
    rows = rows.withColumn("h", F.xxhash64(F.col("id").cast("string"), F.lit(seed)))
    first = rows.orderBy("h", "v").first()
    if first is None:
        return np.zeros((0, 0))
    candidates = np.array([first["v"]], np.float64)
    dim = candidates.shape[1]
    vectors = rows.select("v")
    for turn in range(rounds):
        known = candidates
        cost = _sums(vectors, known, 12)[2]
        if cost <= 0:
            break

        def draw(batches, known=known, cost=cost):
            for part, x in _slices(batches, dim):
                chance = np.minimum(1.0, 2 * k * nearest(x, known, 12)[1] / cost)
                own = np.flatnonzero(part.column(1).to_numpy() < chance)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own))], names=["v"])

        luck = F.pmod(F.xxhash64("h", F.lit(turn)), F.lit(1 << 40)) / float(1 << 40)
        found = rows.select("v", luck.alias("luck")).mapInArrow(draw, "v array<double>").distinct().collect()  # about 2 k rows
        candidates = np.concatenate([candidates, np.array(sorted(r["v"] for r in found)).reshape(-1, dim)])
    candidates = np.unique(candidates, axis=0)
    weight = _sums(vectors, candidates, 12)[1]
    rng = np.random.default_rng(seed)
    chosen = [candidates[int(weight.argmax())]]
    while len(chosen) < min(k, len(candidates)):
        d = weight * nearest(candidates, np.array(chosen), 12)[1]
        if d.sum() <= 0:
            break
        chosen.append(candidates[int(rng.choice(len(candidates), p=d / d.sum()))])
    for _ in range(20):  # Lloyd on the weighted candidates
        at, _ = nearest(candidates, np.array(chosen), 12)
        chosen = [np.average(candidates[at == c], axis=0, weights=np.maximum(weight[at == c], 1e-12))
                  if (at == c).any() else chosen[c] for c in range(len(chosen))]
    return np.array(chosen)


def assigned(df: DataFrame, id_col: str, vec_col: str, centers: np.ndarray, digits: int = 9) -> DataFrame:
    """``(id, cluster)`` by the nearest centre; a null vector has none."""
    dim = centers.shape[1] if centers.size else 0
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("cluster", T.LongType())])

    def run(batches):
        for part, x in _slices(batches, dim, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nearest(x, centers, digits)[0])], names=schema.names)

    rows = df.select(id_col, F.col(vec_col).cast("array<double>").alias("v"))
    if not dim:
        return rows.select(id_col, F.lit(None).cast("bigint").alias("cluster"))
    return rows.filter("v is not null").mapInArrow(run, schema).unionByName(
        rows.filter("v is null").select(id_col, F.lit(None).cast("bigint").alias("cluster")))


def kmeans(df: DataFrame, id_col: str, vec_col: str, k: int, seed: int = 42, max_iter: int = 300,
           tol: float = 1e-4) -> DataFrame:
    """``(id, cluster)`` after Lloyd steps from a k-means|| start."""
    start = seeds(df, id_col, vec_col, k, seed)
    centers = lloyd(df, vec_col, start, max_iter, tol).centers if start.size else start
    return assigned(df, id_col, vec_col, centers)
