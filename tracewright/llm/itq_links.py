"""Embedding near-dedup: iterative quantisation to binary codes, multi-index Hamming tables, exact rerank."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, mix, n_buckets, runs, settle

FIT_ROWS = 20_000  # the sample that learns the rotations
CHUNK = 2048  # vectors of one table's bucket that meet at a time
FIT_LEAST = 256  # a length of fewer vectors has no codes: all of a label meet
MISS, MOST = 1e-4, 64  # the share of links at the floor that tables miss, and tables at most
TRIAL = 4_000  # vectors of the sample on which that share is measured
HITS = "vec_id long, n long, other long"


class Codes(NamedTuple):
    mean: np.ndarray
    rotations: np.ndarray  # (rotation, dimension, bit)
    width: int  # bits of each table's key
    tables: int


def rotations_of(sample: np.ndarray, mean: np.ndarray, number: int, rounds: int = 30, seed: int = 5) -> np.ndarray:
    """Learns orthogonal rotations for balanced binary codes: centred unit vectors, principal axes, then
    alternately the nearest binary codes and the rotation that fits them best (Procrustes)."""
    dim = sample.shape[1]
    centred = sample - mean
    axes = np.linalg.svd(centred.T @ centred)[0] if len(sample) else np.eye(dim)
    rng = np.random.RandomState(seed)
    out = []
    for _ in range(number):
        r = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        v = centred @ axes
        for _ in range(rounds if len(sample) else 0):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        out.append(axes @ r)
    return np.stack(out)


def at_floor(units: np.ndarray, floor: float, seed: int) -> np.ndarray:
    """For each unit vector another at cosine ``floor``, in a random direction."""
    u = np.random.RandomState(seed).standard_normal(units.shape)
    u -= (u * units).sum(axis=1, keepdims=True) * units
    return floor * units + np.sqrt(max(0.0, 1 - floor * floor)) * u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)


def tables_for(agree: np.ndarray, width: int) -> int:
    """How many tables of keys of ``width`` bits leave at most ``MISS`` of the pairs whose bits agree in the
    given shares without a common key; ``MOST + 1`` where that many don't do."""
    miss = 1 - agree**width
    for tables in range(1, MOST + 1):
        if (miss**tables).mean() <= MISS:
            return tables
    return MOST + 1


def fit_itq(sample: np.ndarray, width: int, floor: float, seed: int = 5) -> Codes:
    """Codes whose tables find the links at ``floor``. Pairs at the floor made from the sample show how often
    bits agree: vectors far from the origin lie in a narrow cone, where centred codes differ more than
    the cosine says. Keys get narrower until at most ``MOST`` tables leave ``MISS`` of the pairs; then
    tables are fitted and the share of pairs that they find is measured, and keys narrow on while it is
    below 1 - 10 * MISS. A key of no bits compares all vectors of a label, which misses nothing."""
    dim = sample.shape[1]
    mean = sample.mean(axis=0) if len(sample) else np.zeros(dim)
    some = sample[:TRIAL]
    other = at_floor(some, floor, seed)
    first = rotations_of(sample, mean, max(2, -(-128 // dim)), seed=seed)
    bits = lambda rs, v: np.concatenate([(v - mean) @ r >= 0 for r in rs], axis=1)
    agree = (bits(first, some) == bits(first, other)).mean(axis=1) if len(some) else np.ones(1)
    while width and len(some):
        tables = tables_for(agree, width)
        if tables <= MOST:
            need = -(-width * tables // dim)
            rotations = first[:need] if need <= len(first) else np.concatenate([first, rotations_of(sample, mean, need - len(first), seed=seed + 1)])
            codes = Codes(mean, rotations, width, tables)
            if recall(codes, some, other) >= 1 - 10 * MISS:
                return codes
        width -= 1
    return Codes(mean, np.zeros((1, dim, 0)), 0, 1)


def recall(c: Codes, one: np.ndarray, two: np.ndarray) -> float:
    """Share of pairs (rows of ``one`` and ``two``) that meet in a table."""
    return float((table_keys(c, one) == table_keys(c, two)).any(axis=1).mean())


def table_keys(c: Codes, units: np.ndarray) -> np.ndarray:
    """The key of each vector in each table: ``width`` bits of its codes, dealt over all bits in turn."""
    bits = np.concatenate([(units - c.mean) @ r >= 0 for r in c.rotations], axis=1)
    n = bits.shape[1]
    keys = np.zeros((len(units), c.tables), np.int64)
    for t in range(c.tables if n else 0):
        pick = (t * c.width + np.arange(c.width)) % n
        keys[:, t] = bits[:, pick] @ (1 << np.arange(c.width, dtype=np.int64))
    return keys


def as_matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors in double precision, usable): unusable are vectors that are null, zero, of another
    length or hold null or non-finite components."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    out, ok = np.zeros((n, dim)), np.zeros(n, bool)
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    flat = column.flatten()
    values = np.asarray(flat.cast(pa.float64()).fill_null(float("nan")), np.float64)
    rows = np.flatnonzero(sizes == dim)
    start = (np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0))[rows]
    block = values[start[:, None] + np.arange(dim)] if len(rows) else np.zeros((0, dim))
    fine = np.isfinite(block).all(axis=1)
    top = np.abs(np.where(fine[:, None], block, 0)).max(axis=1) if len(rows) else np.zeros(0)
    fine &= top > 0
    block = block[fine] / top[fine][:, None]
    out[rows[fine]] = block / np.sqrt((block**2).sum(axis=1))[:, None]
    ok[rows[fine]] = True
    return out, ok


def joined(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each place the smallest id that the links (i, j), given both ways, join it with."""
    label = ids.copy()
    while True:
        before = label.copy()
        np.minimum.at(label, i, before[j])
        if (label == before).all():
            return label


def link_vectors(vectors: DataFrame, floor: float = 0.98, fit_rows: int = FIT_ROWS, seed: int = 5) -> DataFrame:
    """``vec_id, embedding, label`` -> adds ``n_links, component_id, kept`` (other columns are dropped).

    Vectors link when their labels are equal and not null and their cosine in double precision is at
    least ``floor``. Null, zero and non-finite vectors and rows with a null vec_id link with nothing; rows that
    repeat a vec_id and its vector count once. A vec_id with several vectors has the links of all of them, each
    counted, and its vectors are of one component whether they link or not; all its rows get the same result.

    Vectors link within their length. Rotations are fitted for each length of ``FIT_LEAST`` vectors or more,
    on at most ``fit_rows`` of them, the first by hash of their id; every vector is indexed. Equal vectors of a label are one node that carries its number, so that a hot vector is one
    row. A node goes into each table under (label, table, key); keys widen with the logarithm of the
    number of rows, so that buckets stay small. Nodes of one bucket meet in blocks of ``CHUNK``; a bucket
    of several blocks becomes a group for each pair of blocks, so that no task holds a whole hot bucket.
    A pair counts in the first table where its keys agree; a task returns each node's number of links
    and one link for each part of a block that links join, never all pairs. Width and number of tables
    are those with which made pairs at the floor, measured on the sample, are found (see ``fit_itq``).
    Repeated rows, ties and empty tables need no care: equal vectors are one node, the smallest vec_id
    names a component, and no rows give none.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "label", "embedding")
    codes: dict[int, Codes] = {}
    for dim, n in rows.filter("size(embedding) > 0").groupBy(F.size("embedding")).count().collect():
        if n < FIT_LEAST:
            codes[dim] = Codes(np.zeros(dim), np.zeros((1, dim, 0)), 0, 1)
            continue
        width = int(min(24, max(8, np.ceil(np.log2(n)) - 2)))
        sample = rows.filter(F.size("embedding") == dim).select("embedding", F.xxhash64("vec_id", F.lit(seed)).alias("h")).orderBy("h").limit(fit_rows).select("embedding").toArrow()
        unit, ok = as_matrix(sample.column(0), dim)
        codes[dim] = fit_itq(unit[ok], width, floor, seed)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column(2).value_lengths().fill_null(0))
            for dim in np.unique(sizes[sizes > 0]).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                unit, ok = as_matrix(part.column(2), dim)
                ok &= np.asarray(part.column(0).is_valid()) & np.asarray(part.column(1).is_valid())
                keep = np.flatnonzero(ok)
                unit = unit[keep]
                keys = table_keys(codes[dim], unit)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel(), pa.int64()))
                raw = pa.array([u.tobytes() for u in unit], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)), part.column(1).take(pa.array(keep)), lists, raw], ["vec_id", "label", "keys", "unit"])

    coded = settle(rows.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), "embedding").mapInArrow(encode, "vec_id long, label string, keys array<long>, unit binary"), "codes")
    # vectors of different lengths are of different labels
    coded = coded.withColumn("label", F.concat_ws(":", F.length("unit"), "label"))
    coded = coded.withColumn("same", F.sha2("unit", 256))
    member = coded.select("vec_id", "label", "same").distinct()
    # nodes are numbered in the order of their smallest vec_id, which so names a component of nodes
    node = settle(member.groupBy("label", "same").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")).orderBy("first", "label", "same").withColumn("node", F.monotonically_increasing_id()), "nodes")
    heads = coded.join(node.withColumnRenamed("first", "vec_id"), ["vec_id", "label", "same"]).dropDuplicates(["node"]).select(F.col("node").alias("vec_id"), "label", "keys", "unit", "copies")

    slot = heads.select("vec_id", "label", F.posexplode("keys").alias("t", "key"))
    crowd = slot.groupBy("label", "t", "key").agg(F.count("*").alias("n")).filter("n > 1").withColumn("parts", F.ceil(F.col("n") / CHUNK).cast("int"))
    placed = slot.join(crowd, ["label", "t", "key"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    # buckets of one block share a task by their key's hash; larger ones have a group for each pair of blocks
    single = placed.filter("parts = 1").withColumn("group", F.concat_ws("|", F.lit("s"), F.pmod(F.xxhash64("label", "t", "key"), F.lit(n_buckets(spark))))).withColumn("half", F.lit(0))
    several = placed.filter("parts > 1").withColumn("o", F.explode(F.expr("sequence(0, parts - 1)"))).withColumn(
        "group", F.concat_ws("|", "label", "t", "key", F.least("part", "o"), F.greatest("part", "o"))).withColumn("half", F.when(F.col("part") > F.col("o"), 1).otherwise(0)).drop("o")
    cols = ["group", "half", "vec_id", "label", "t", "key", "parts", "part"]
    asked = single.select(*cols).unionByName(several.select(*cols))
    full = asked.join(heads.select(F.col("vec_id"), "label", "keys", "unit", "copies"), ["vec_id", "label"])

    def meet(table: pa.Table) -> pa.Table:
        size = np.array([len(u) for u in table.column("unit").to_pylist()], np.int64)
        return pa.concat_tables([meet_length(table.take(pa.array(np.flatnonzero(size == n))), int(n) // 8) for n in np.unique(size)])

    def meet_length(table: pa.Table, dim: int) -> pa.Table:
        t = np.asarray(table.column("t"), np.int64)
        labels = np.unique(np.asarray(table.column("label").to_pylist(), object).astype(str), return_inverse=True)[1]
        bucket = mix(mix(np.asarray(table.column("key"), np.int64).astype(np.uint64)) + t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + labels.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(bucket, kind="stable")
        first = runs(bucket[order])
        ids = np.asarray(table.column("vec_id"), np.int64)
        half, parts, part, copies = (np.asarray(table.column(c), np.int64) for c in ("half", "parts", "part", "copies"))
        keys = np.asarray(table.column("keys").combine_chunks().flatten(), np.int64).reshape(table.num_rows, -1)
        unit = np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float64).reshape(-1, dim)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in zip(first, np.append(first[1:], len(order)), strict=True):
            at = order[a:b]
            cross = parts[at[0]] > 1 and half[at].any()
            left, right = (at[half[at] == 0], at[half[at] == 1]) if cross else (at, at)
            near = unit[left] @ unit[right].T >= floor - 1e-12
            if not cross:
                np.fill_diagonal(near, False)
            i, j = np.nonzero(near)
            i, j = left[i], right[j]
            # cosines at the edge are taken again, each by itself; a pair counts in its first table only
            good = np.ones(len(i), bool)
            for s in range(0, len(i), 65536):
                p, q = i[s : s + 65536], j[s : s + 65536]
                good[s : s + 65536] = (np.einsum("ij,ij->i", unit[p], unit[q]) >= floor) & ((keys[p] == keys[q]).argmax(axis=1) == t[p])
            i, j = i[good], j[good]
            if not len(i):
                continue
            if cross:
                i, j = np.concatenate([i, j]), np.concatenate([j, i])
            by = np.argsort(i, kind="stable")
            i, j = i[by], j[by]
            start = runs(i)
            out.append((ids[i[start]], np.add.reduceat(copies[j], start), joined(ids, i, j)[i[start]]))
        flat = [np.concatenate([o[k] for o in out]) if out else np.empty(0, np.int64) for k in range(3)]
        return pa.table(dict(zip(("vec_id", "n", "other"), (pa.array(x, pa.int64()) for x in flat), strict=True)))

    hits = settle(full.select("group", "half", "vec_id", "label", "t", "key", "parts", "part", "keys", "unit", "copies").groupBy("group").applyInArrow(meet, HITS), "hits")
    count = hits.groupBy("vec_id").agg(F.sum("n").alias("n")).withColumnRenamed("vec_id", "node")
    named = settle(member.join(node, ["label", "same"]).select("vec_id", "node", "first", "copies"), "members")
    shared = named.groupBy("vec_id").agg(F.min("node").alias("least"), F.count("*").alias("n")).filter("n > 1")
    bridges = named.join(shared, "vec_id").filter("node <> least").select("node", "least")
    parts = components(hits.filter("vec_id <> other").select("vec_id", "other").distinct().unionByName(bridges.select(F.col("node").alias("vec_id"), F.col("least").alias("other"))), "vec_id", "other")
    parts = parts.join(node.select(F.col("node").alias("label"), "first"), "label").select(F.col("id").alias("node"), F.col("first").alias("part"))
    info = (
        named.join(count, "node", "left").join(parts, "node", "left")
        .groupBy("vec_id").agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.min(F.coalesce("part", "first")).alias("component_id"))
    )
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    out = ids.join(info, "vec_id", "left")
    out = out.withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long")).withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
