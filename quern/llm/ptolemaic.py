"""Exact centroid clustering in whole numbers, pruned by Ptolemy's inequality.

For any pivots p and q, d(x, c) * d(p, q) >= |d(x, p) * d(c, q) - d(x, q) * d(c, p)|. Each vector's distances to a few fixed
pivots are kept in its table; those of the centroids are made anew each round. The largest bound over pairs of pivots
rules centroids out, rounded so that none is lost; the survivors' distances are exact integers.

A round is one pass over the table: tasks send sums by cluster, and the driver sees one row a cluster.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, give_back, materialise, plain

#: Relative error that a bound may have gathered from roots, products and a quotient in double precision, many times over.
_SLACK = 2.0**-46
#: Survivors that are compared at once.
_AT_ONCE = 1 << 14


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of c."""
    return ((x**2).sum(axis=1)[:, None] + (c**2).sum(axis=1) - 2 * (x @ c.T)) if len(c) else np.zeros((len(x), 0), np.int64)


def far_apart(points: np.ndarray, k: int) -> np.ndarray:
    """At most k rows, each the farthest from those before it: distinct ones only."""
    chosen = [0]
    near = squared(points, points[:1])[:, 0]
    while len(chosen) < k and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, squared(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def lower_bounds(to_pivots: np.ndarray, centre_to_pivots: np.ndarray, between: np.ndarray) -> np.ndarray:
    """Conservative bounds of the distance of every row to every centroid, from pairs of pivots."""
    low = np.zeros((len(to_pivots), len(centre_to_pivots)))
    for p, q in combinations(range(len(between)), 2):
        a, b = to_pivots[:, p, None] * centre_to_pivots[:, q], to_pivots[:, q, None] * centre_to_pivots[:, p]
        np.maximum(low, (np.abs(a - b) - (a + b) * _SLACK) / (between[p, q] * (1 + _SLACK)), out=low)
    return low


def nearest_centroid(x: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, ties to the smaller; squared distance; distances that had to be computed)."""
    low = lower_bounds(to_pivots, np.sqrt(squared(centroids, pivots)), np.sqrt(squared(pivots, pivots)))
    first = low.argmin(axis=1)
    best = ((x - centroids[first]) ** 2).sum(axis=1)
    alive = low**2 * (1 - _SLACK) <= best[:, None]
    row, number = np.nonzero(alive)
    found = np.full(low.shape, np.iinfo(np.int64).max)
    for at in range(0, len(row), _AT_ONCE):
        r, c = row[at : at + _AT_ONCE], number[at : at + _AT_ONCE]
        found[r, c] = ((x[r] - centroids[c]) ** 2).sum(axis=1)
    near = found.argmin(axis=1)
    return near, found[np.arange(len(x)), near], len(row) + len(x)


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def whole_vectors(vectors: DataFrame, *, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, x) of vectors with just `dims` components, none null or non-finite; x: floor(scale * component)."""
    rows = plain(vectors, id_col, vector_col).toDF("vec_id", "v").withColumn("v", F.col("v").cast("array<double>"))
    proper = (F.size("v") == dims) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    largest = math.isqrt(2**62 // dims) // 2  # keeps all squared distances within 63 bits

    def whole(c: Column) -> Column:
        n = F.floor(c * F.lit(float(scale)))
        return F.when(F.abs(c * F.lit(float(scale))) < F.lit(float(min(largest, 1 << 30))), n).otherwise(F.raise_error(F.lit(f"a component times {scale} is beyond {largest}: its distances don't fit 63 bits"))).cast("int")

    return rows.where(F.coalesce(proper, F.lit(False))).select("vec_id", F.transform("v", whole).alias("x"))


def clusters(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2, pivots: int = 6) -> tuple[DataFrame, list[list[int]], float]:
    """((vec_id, cluster, distance) of every kept vector, the centroids, share of distances that were computed in the last pass).

    Vectors of another length than dims, null ones and those with null or non-finite components take no part. The first centroids
    are those of least sha256 of `seed:id`; of rows that repeat an id the smaller vectors come first, a null id hashes as an empty text.
    With fewer than k vectors each starts a cluster of its own; without any the result is empty. Ties go to the smaller
    number. A component whose distances could pass 63 bits (some 500,000 at 64 components) is an error. Other columns are ignored.
    """
    spark = vectors.sparkSession
    kept = whole_vectors(vectors, id_col=id_col, vector_col=vector_col, dims=dims, scale=scale)
    kind = kept.schema["vec_id"].dataType.simpleString()
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centroids = np.array([r["x"] for r in kept.withColumn("digest", digest).orderBy("digest", "x").limit(k).collect()], np.int64)
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long"), [], 0.0
    fixed = far_apart(centroids, pivots)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = np.sqrt(squared(_matrix(batch.column(1), np.int64), fixed))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(far))], ["vec_id", "x", "far"])

    def placed(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[tuple]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), np.int64)
                yield batch, x, *nearest_centroid(x, _matrix(batch.column(2), float), centres, fixed)
        give_back()

    def summed(centres: np.ndarray):
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros_like(centres), np.zeros(len(centres), np.int64)
            for _, x, near, _, _ in placed(batches, centres):
                n += np.bincount(near, minlength=len(n))
                for c in np.unique(near):
                    total[c] += x[near == c].sum(axis=0)
            held = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(n[held]), pa.array(list(total[held]), pa.list_(pa.int64()))], ["cluster", "n", "total"])

        return sums

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, near, distance, computed in placed(batches, centroids):
            share = np.zeros(batch.num_rows, np.int64)
            share[0] = computed
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near.astype(np.int32)), pa.array(distance), pa.array(share)], ["vec_id", "cluster", "distance", "computed"])

    table = materialise(kept.mapInArrow(measured, f"vec_id {kind}, x array<int>, far array<double>"))
    for _ in range(rounds):
        found = table.mapInArrow(summed(centroids), "cluster int, n long, total array<bigint>").groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(dims)]).alias("total"))
        moved = centroids.copy()
        for r in found.collect():  # a row a cluster
            moved[r["cluster"]] = [t // r["n"] for t in r["total"]]
        centroids = moved
    out = materialise(table.mapInArrow(assigned, f"vec_id {kind}, cluster int, distance long, computed long"))
    computed, n = out.agg(F.sum("computed"), F.count("*")).first()
    discard(table)
    return out.drop("computed"), centroids.tolist(), computed / (n * len(centroids))


def cluster_report(vectors: DataFrame, **options) -> DataFrame:
    """clusters() with the inertia of each cluster and of all, and a digest of each centroid: the form of query op13."""
    rows, centroids, _ = clusters(vectors, **options)
    kind = rows.schema["vec_id"].dataType.simpleString()
    spark = rows.sparkSession
    if not centroids:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    by_cluster = {r["cluster"]: r["inertia"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # a row a cluster
    lines = [(c, by_cluster.get(c, 0), sum(by_cluster.values()), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)]
    table = spark.createDataFrame(lines, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
