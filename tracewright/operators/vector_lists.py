"""Nearest vectors by inverted lists: documents near a learned centroid stand together, and a bound tells
which of these cells a query can leave out."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..checkpoints import written

SAMPLE_CELLS = 1 << 21  # numbers of the sample that centroids are learned from, and first bounds come from
SAMPLE_ROWS = 1 << 14
LISTS, RINGS, LENGTHS = 1024, 64, 16  # most lists of a length, rings of a list, lengths that get lists
SLACK = 1e-6  # of distances: root of the rounding of a cosine
SLICE = 1 << 22  # products held at a time


class Lists(NamedTuple):
    """Of one length of vectors: the centroids, the edges of each list's rings of distance from its centroid,
    and the unit vectors of the sample."""

    centroids: np.ndarray
    edges: np.ndarray
    sample: np.ndarray


class Cells(NamedTuple):
    """The rings that hold documents: which list, and the nearest and farthest of it."""

    number: np.ndarray
    list: np.ndarray
    near: np.ndarray
    far: np.ndarray


def usable(vector: Column) -> Column:
    """Not null, not empty, every component finite."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def units(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) for each length of a column of vectors; zero vectors stay zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(column.value_lengths()) if len(column) else np.empty(0, int)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        m = np.array(column.take(pa.array(at)).flatten(), np.float64).reshape(len(at), n)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        yield at, np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def learn_lists(sample: np.ndarray, documents: int, part: int, seed: int = 7) -> Lists:
    """Centroids by rounds of nearest means over the sample; few documents get one list."""
    n = int(min(LISTS, np.sqrt(documents), len(sample) // 8)) if documents > 4 * part else 1
    if n <= 1:
        return Lists(np.zeros((1, sample.shape[1])), np.empty((1, 0)), sample)
    centroids = sample[np.random.RandomState(seed).choice(len(sample), n, replace=False)]
    for _ in range(8):
        own = apart(sample, centroids).argmin(1)
        total = np.zeros_like(centroids)
        np.add.at(total, own, sample)
        count = np.bincount(own, minlength=n)
        centroids = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centroids)
    far = apart(sample, centroids)
    own, far = far.argmin(1), far.min(1)
    rings = int(min(RINGS, documents // (n * part) + 1))
    share = np.arange(1, rings) / rings
    edges = np.array([np.quantile(far[own == c], share) if (own == c).any() else np.full(rings - 1, 1.0) for c in range(n)]).reshape(n, rings - 1)
    return Lists(centroids, edges, sample)


def learn(docs: DataFrame, part: int) -> dict[int, Lists]:
    """Lists for each length of vectors that many documents have, by falling number; vectors of the others
    are one list a length. The sample of a length is the first by hash of the id, bounded in rows and numbers."""
    sizes = docs.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).filter(F.col("n") > 4 * part).orderBy(F.col("n").desc(), "dim").limit(LENGTHS).collect()
    out = {}
    for dim, n in sizes:
        rows = min(SAMPLE_ROWS, SAMPLE_CELLS // dim)
        some = docs.filter(F.size("vector") == dim).select("vector", F.xxhash64("doc_id").alias("h")).orderBy("h").limit(max(1, rows)).select("vector").toArrow()
        unit = next(units(some.column("vector")))[1]
        out[dim] = learn_lists(unit[unit.any(1)], n, part)
    return out


def place(docs: DataFrame, lists: dict[int, Lists]) -> DataFrame:
    """(doc_id, dim, cell, away, unit): each document's ring and its distance from the centroid; zero vectors
    have the cell -1."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, unit in units(batch.column(1)):
                have = lists.get(unit.shape[1])
                cell, away = np.zeros(len(at), np.int64), np.ones(len(at))
                if have:
                    gap = apart(unit, have.centroids)
                    own, away = gap.argmin(1), gap.min(1)
                    cell = own * RINGS + (away[:, None] > have.edges[own]).sum(1)
                cell[~unit.any(1)] = -1
                raw = pa.array([u.tobytes() for u in unit], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.full(len(at), unit.shape[1]), pa.int32()), pa.array(cell), pa.array(away), raw], ["doc_id", "dim", "cell", "away", "unit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "vector").mapInArrow(task, f"doc_id {kind}, dim int, cell long, away double, unit binary")


def route(queries: DataFrame, lists: dict[int, Lists], cells: dict[int, Cells], k: int, probes: int | None) -> DataFrame:
    """(query_id, dim, floor, unit, cells): the cells that a query must look at.

    The ``k``-th best cosine among the sample is a lower bound of that among all. A document of a cell is at least
    as far from the query as the query's distance from the centroid differs from those of the cell's
    documents; a cell goes where that is farther than the bound. With ``probes`` only the cells of the nearest
    lists are named, which may miss some."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, unit in units(batch.column(1)):
                dim = unit.shape[1]
                if dim not in cells:
                    continue
                own = cells[dim]
                floor = np.full(len(at), -1.0)
                keep = np.ones((len(at), len(own.number)), bool)
                if dim in lists:
                    have = lists[dim]
                    if len(have.sample) >= k:
                        for a in range(0, len(at), max(1, SLICE // len(have.sample))):
                            part = slice(a, a + max(1, SLICE // len(have.sample)))
                            floor[part] = np.partition(unit[part] @ have.sample.T, -k, axis=1)[:, -k] - 1e-9
                    gap = apart(unit, have.centroids)
                    to = gap[:, own.list]
                    keep = np.maximum(to - own.far, own.near - to) <= np.sqrt(np.maximum(2 - 2 * floor, 0))[:, None] + SLACK
                    if probes:
                        filled = np.unique(own.list)
                        best = filled[np.argsort(gap[:, filled], axis=1, kind="stable")[:, :probes]]
                        keep = (own.list[None, :, None] == best[:, None, :]).any(2)
                row, col = np.nonzero(keep)
                ends = np.searchsorted(row, np.arange(len(at) + 1)).astype(np.int32)
                raw = pa.array([u.tobytes() for u in unit], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(np.full(len(at), dim), pa.int32()), pa.array(floor), raw, pa.ListArray.from_arrays(pa.array(ends), pa.array(own.number[col]))],
                    ["query_id", "dim", "floor", "unit", "cells"])

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "vector").mapInArrow(task, f"query_id {kind}, dim int, floor double, unit binary, cells array<long>")


def best_pairs(unit: np.ndarray, floor: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, document, score): of a block's documents, in the order of their ids, the ``k`` of largest (1 +
    cosine) / 2 for each query, if they reach its floor."""
    score = (1 + unit @ docs.T) / 2
    least = (1 + floor) / 2 - 1e-9
    if score.shape[1] > k:
        least = np.maximum(least, np.partition(score, -k, axis=1)[:, -k] - 1e-11)
    i, j = np.nonzero(score >= least[:, None])
    order = np.lexsort((j, -np.round(score[i, j], 12), i))
    i, j = i[order], j[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    i, j = i[rank < k], j[rank < k]
    return i, j, score[i, j]


def meet(dealt: DataFrame, query_type: pa.DataType, doc_type: pa.DataType, types: str, k: int) -> DataFrame:
    """(query_id, doc_id, score) of rows in the order of their block, its documents before its queries: a task
    holds one block's documents, while queries pass by in batches, however many there are."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        names: list[pa.Array] = []
        rows: list[bytes] = []
        whole: tuple[pa.Array, np.ndarray] | None = None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c), np.int64) for c in range(3)], 1)
            asks = np.asarray(batch.column(3).cast(pa.uint8()), np.int64)
            turn = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1) | (asks[1:] != asks[:-1])])) if len(keys) else np.empty(0, int)
            for a, b in zip(turn.tolist(), np.append(turn[1:], len(keys)).tolist(), strict=True):
                if at != tuple(keys[a]):
                    at, names, rows, whole = tuple(keys[a]), [], [], None
                raw = batch.column(7).slice(a, b - a).to_pylist()
                if not asks[a]:
                    names.append(batch.column(5).slice(a, b - a))
                    rows += raw
                    continue
                if not rows:
                    continue
                whole = whole or (pa.concat_arrays(names), np.frombuffer(b"".join(rows)).reshape(len(rows), -1))
                unit, floor = np.frombuffer(b"".join(raw)).reshape(b - a, -1), np.asarray(batch.column(6))[a:b]
                step = max(1, SLICE // len(whole[1]))
                for s in range(0, b - a, step):
                    i, j, score = best_pairs(unit[s : s + step], floor[s : s + step], whole[1], k)
                    yield pa.RecordBatch.from_arrays([batch.column(4).take(pa.array(a + s + i)).cast(query_type), whole[0].take(pa.array(j)).cast(doc_type), pa.array(score)], ["query_id", "doc_id", "score"])

    return dealt.mapInArrow(task, types)


def nearest(queries: DataFrame, docs: DataFrame, k: int, part: int = 4096, probes: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): for each query the ``k`` documents of the largest (1 + cosine) / 2, ties
    by doc_id. ``queries``: (query_id, vector), ``docs``: (doc_id, vector), each vector of any length.

    Vectors meet those of their own length; null, empty and non-finite ones meet none, zero ones score 0.5
    with all. Documents are placed into lists around learned centroids and, within a list, into rings of
    distance, which are split into blocks of about ``part``; equal documents, which share a ring, too. Each
    query goes to the cells that its bound can't rule out (see ``route``), so that the outcome equals that
    over all pairs, most of which are never formed where vectors gather. A document is shuffled once; a query once for
    each block it looks at. What tasks get beside their rows is bounded: the centroids, the sample, and a row
    for each ring. ``probes``: look only at so many lists for each query; faster, and approximate.
    """
    spark = docs.sparkSession
    docs, queries = docs.filter(usable(F.col("vector"))).select("doc_id", "vector"), queries.filter(usable(F.col("vector"))).select("query_id", "vector")
    kinds = [t.schema[c].dataType for t, c in ((queries, "query_id"), (docs, "doc_id"))]
    lists = learn(docs, part)
    placed = written(place(docs, lists))
    held: dict[int, list] = {}
    rings = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.min("away").alias("near"), F.max("away").alias("far")).orderBy("dim", "cell").collect()  # a row for each ring
    for r in rings:
        held.setdefault(r.dim, []).append(r)
    cells = {dim: Cells(*(np.array(x) for x in zip(*[(r.cell, r.cell // RINGS, r.near, r.far) for r in own if r.cell >= 0], strict=True))) for dim, own in held.items() if any(r.cell >= 0 for r in own)}
    parts = spark.createDataFrame([(r.dim, r.cell, -(-r.n // part)) for r in rings if r.cell >= 0], "dim int, cell long, parts long")

    asks = route(queries, lists, cells, k, probes).select("query_id", "dim", "floor", "unit", F.explode("cells").alias("cell")).join(F.broadcast(parts), ["dim", "cell"])  # a row for each ring
    q = asks.select("dim", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(True).alias("asks"), "query_id", F.lit(None).cast(kinds[1]).alias("doc_id"), "floor", "unit")
    d = placed.join(F.broadcast(parts), ["dim", "cell"]).select("dim", "cell", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("long").alias("part"), F.lit(False).alias("asks"), F.lit(None).cast(kinds[0]).alias("query_id"), "doc_id", F.lit(None).cast("double").alias("floor"), "unit")
    dealt = d.unionByName(q).repartition("dim", "cell", "part").sortWithinPartitions("dim", "cell", "part", "asks", "doc_id")
    found = meet(dealt, *(to_arrow_type(t) for t in kinds), f"query_id {kinds[0].simpleString()}, doc_id {kinds[1].simpleString()}, score double", k)

    # zero vectors score alike with all: the first k ids of a length stand for the rest
    first = lambda t: t.withColumn("r", F.row_number().over(Window.partitionBy("dim").orderBy("doc_id"))).filter(F.col("r") <= k).select("dim", "doc_id")
    zero = F.forall("vector", lambda x: x == 0)
    sized = queries.select("query_id", F.size("vector").alias("dim"), zero.alias("zero"))
    if any(r.cell < 0 for r in rings):
        found = found.unionByName(sized.filter("not zero").join(first(placed.filter("cell < 0")), "dim").select("query_id", "doc_id", F.lit(0.5).alias("score")))
    if not queries.filter(zero).isEmpty():
        found = found.join(sized.filter("zero").select("query_id"), "query_id", "left_anti").unionByName(sized.filter("zero").join(first(placed), "dim").select("query_id", "doc_id", F.lit(0.5).alias("score")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "doc_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)
