"""Centroid clustering: each vector's nearest centroid by the threshold algorithm over sorted lists."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh, settle

BLOCK = 1 << 20  # cells of a block of vectors beside centroids or components
FAR = np.iinfo(np.int64).max


class Lists(NamedTuple):
    """Centroids, and for each dimension their values in order with whose they are; a sentinel stands at
    either end, further away than any value can be."""

    centroids: np.ndarray
    values: np.ndarray
    whose: np.ndarray


def sorted_lists(centroids: np.ndarray) -> Lists:
    order = np.argsort(centroids, axis=0, kind="stable").T
    values = np.take_along_axis(centroids.T, order, 1)
    wall = np.full((len(values), 1), 1 << 40, np.int64)
    return Lists(centroids, np.hstack([-wall, values, wall]), order)


def nearest(rows: np.ndarray, lists: Lists) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, squared distance) of each row, and how many distances were taken.

    Each dimension's list is walked outward from the row's own value, one centroid a round in every dimension.
    A centroid met for the first time has its exact distance taken. One not met yet lies in every dimension at
    least as far as that list's frontier, so that the sum of squared frontier gaps bounds its distance from
    below: a row is done when this sum strictly exceeds its best distance. An equal sum isn't enough, as a
    centroid of a smaller number may then tie."""
    n, d = rows.shape
    k = len(lists.centroids)
    right = np.stack([np.searchsorted(v[1:-1], rows[:, j]) for j, v in enumerate(lists.values)], 1) + 1
    left = right - 1
    far = np.full((n, k), FAR, np.int64)
    at, dims, taken = np.arange(n), np.arange(d), 0
    for step in range(k):
        x, lo, hi = rows[at], left[at], right[at]
        below, above = x - lists.values[dims, lo], lists.values[dims, hi] - x
        down = below <= above
        met = np.zeros((len(at), k), bool)
        met[np.arange(len(at))[:, None], lists.whose[dims, np.where(down, lo, hi) - 1]] = True
        i, c = np.nonzero(met & (far[at] == FAR))
        taken += len(i)
        for s in range(0, len(i), BLOCK // d):
            p, q = at[i[s : s + BLOCK // d]], c[s : s + BLOCK // d]
            gap = rows[p] - lists.centroids[q]
            far[p, q] = np.einsum("ij,ij->i", gap, gap)
        if step == k - 1:
            break
        lo, hi = lo - down, hi + ~down
        left[at], right[at] = lo, hi
        front = np.minimum(x - lists.values[dims, lo], lists.values[dims, hi] - x)
        at = at[np.einsum("ij,ij->i", front, front) <= far[at].min(axis=1)]
        if not len(at):
            break
    best = far.argmin(axis=1)
    return best, far[np.arange(n), best], taken


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), dims)


def blocks(rows: np.ndarray, k: int) -> Iterator[slice]:
    size = max(1, BLOCK // max(k, rows.shape[1]))
    return (slice(a, a + size) for a in range(0, len(rows), size))


def whole_numbers(vectors: DataFrame, dims: int, scale: int, name: str) -> DataFrame:
    """Rows whose ``embedding`` has ``dims`` finite components, as the column ``name`` of whole numbers:
    floor(scale * component), in doubles. Numbers beyond what lets a distance fit 64 bits (2^27 for 64
    components) count as that bound."""
    bound = float(1 << int(math.log2((1 << 62) / dims) / 2 - 1))
    x = lambda v: v.cast("double")
    finite = F.forall("embedding", lambda v: v.isNotNull() & (F.abs(x(v)) < float("inf")))  # what isn't a number counts as larger
    cell = lambda v: F.floor(F.greatest(F.least(x(v) * scale, F.lit(bound)), F.lit(-bound))).cast("int")
    return vectors.filter((F.size("embedding") == dims) & F.coalesce(finite, F.lit(False))).withColumn(name, F.transform("embedding", cell)).drop("embedding")


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: str = "3") -> DataFrame:
    """``vec_id, embedding`` and any others -> rows with ``cluster, distance, cluster_inertia, inertia, centroid``.

    Kept are vectors of exactly ``dims`` components, none null or non-finite, as whole numbers (see
    ``whole_numbers``). The first centroids are the ``k`` kept vectors of smallest sha256 of ``salt:vec_id``;
    rows of a null vec_id seed none but are clustered; where rows repeat a vec_id each counts, the smaller
    vector first. Fewer kept vectors than ``k`` give as many centroids. Each round assigns every vector to its
    nearest centroid by squared Euclidean distance, ties to the smaller number, and replaces centroids that
    have vectors by their componentwise floor(sum / count), exactly; empty ones stay. Then all are assigned
    once more. Repeated rows stay; no kept vectors give no rows; columns named like the added ones are replaced.

    A round is one pass over the numbers, which are written to the shared folder once: a task walks the sorted
    lists for blocks of its vectors and returns a sum for each centroid, at most ``k`` rows, which Spark adds
    up. Only the ``k`` centroids go through the driver, whatever the number of vectors, so that neither a hot
    vector nor a cluster that holds all is ever in one task.
    """
    spark = vectors.sparkSession
    vectors = vectors.drop("cluster", "distance", "cluster_inertia", "inertia", "centroid")
    (cells,) = fresh(vectors, "cells")
    own = [c for c in vectors.columns if c != "embedding"]
    kept = settle(whole_numbers(vectors, dims, scale, cells), "cells")
    hashed = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.filter("vec_id is not null").select(hashed.alias("h"), F.col(cells).alias("v")).orderBy("h", "v").limit(k).collect()
    centroids = np.array([r.v for r in first], np.int64).reshape(len(first), dims)
    if not len(first):
        return kept.drop(cells).withColumns({c: F.lit(None).cast(t) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid", "array<long>"))})

    def summed(lists: Lists):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(len(lists.centroids), np.int64)
            total = np.zeros(lists.centroids.shape, np.int64)
            for batch in batches:
                rows = matrix(batch.column(0), dims)
                for part in blocks(rows, len(n)):
                    best, _, _ = nearest(rows[part], lists)
                    order = np.argsort(best, kind="stable")
                    own, at = np.unique(best[order], return_index=True)
                    n[own] += np.diff(np.append(at, len(best)))
                    total[own] += np.add.reduceat(rows[part][order], at, axis=0)
            got = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.int32()), pa.array(n[got]), pa.array(list(total[got]), pa.list_(pa.int64()))], ["cluster", "n", "total"])

        return task

    added = F.array(*[F.sum(F.col("total")[j]) for j in range(dims)]).alias("total")
    for _ in range(rounds):
        sums = kept.select(cells).mapInArrow(summed(sorted_lists(centroids)), "cluster int, n long, total array<long>")
        for r in sums.groupBy("cluster").agg(F.sum("n").alias("n"), added).collect():  # a row for each centroid
            centroids[r.cluster] = [t // r.n for t in r.total]
    lists = sorted_lists(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column(batch.num_columns - 1), dims)
            got = [nearest(rows[part], lists) for part in blocks(rows, len(lists.centroids))]
            best, far = (np.concatenate([g[i] for g in got]) if got else np.empty(0, np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(best, pa.int32()), pa.array(far, pa.int64())], [*own, "cluster", "distance"])

    schema = kept.select(*[F.col(f"`{c}`") for c in own]).withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long")}).schema
    done = settle(kept.select(*[F.col(f"`{c}`") for c in own], cells).mapInArrow(assign, schema), "clusters")
    inertia = {r.cluster: r.s for r in done.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row for each centroid
    facts = spark.createDataFrame([(c, s, sum(inertia.values()), centroids[c].tolist()) for c, s in sorted(inertia.items())], "c int, cluster_inertia long, inertia long, centroid array<long>")
    return done.join(F.broadcast(facts), F.col("cluster") == F.col("c")).drop("c")  # at most k rows

