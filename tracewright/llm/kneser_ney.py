"""LM scoring: an interpolated modified Kneser-Ney bigram model counted in Spark, kept as sorted arrays
in the shared folder and memory-mapped by the workers that score."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import buffers, dealt, hash_spans, mapped, mix, n_groups, pack, put_file, range_of, runs, shared_dir, slices, touched, unpack, word_spans

END = np.uint64(0x5E17A2C9D3B4F681)  # the end token's place among word hashes
FLUSH = 1_500_000
PARTS = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
PART_TYPE = "bucket long, kind int, keys binary, counts binary"
HIGH, LOW = np.uint64(32), np.uint64(0xFFFFFFFF)


class Model(NamedTuple):
    """Where the arrays are, and the few numbers that hold for all of them."""

    path: str
    buckets: int
    ranges: int  # of token ids, by which left and right neighbours are kept
    written: frozenset[str]  # the arrays that were written; of others nothing was counted
    bases: np.ndarray  # first token id of each range of word hashes, and the number of types
    tokens: int
    discounts: np.ndarray  # of bigrams seen once, twice, more often
    low_discounts: np.ndarray  # of words with one, two, more left neighbours
    low_total: int
    low_gamma: float


def tokens_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, first token of each document and the number of all): the lower-cased words
    of each document and one end."""
    data, offsets = buffers(text)
    starts, ends, doc = word_spans(data, offsets)
    h = hash_spans(data, starts, ends, lower=True)
    h[h == END] ^= np.uint64(1)
    upto = np.searchsorted(doc, np.arange(len(text)), "right")
    out = np.insert(h, upto, END)
    return out, np.concatenate([[0], upto + 1 + np.arange(len(text))])


def _rows(keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray, kind: int) -> list[dict]:
    """One packed row for each bucket; keys rise within each. ``counts`` may have several columns."""
    order = np.argsort(bucket, kind="stable")
    keys, counts, bucket = keys[order], counts[order], bucket[order]
    first = runs(bucket)
    return [{"bucket": int(bucket[a]), "kind": kind, "keys": pack(keys[a:b]), "counts": b"".join(pack(c) for c in np.atleast_2d(counts[a:b].T))} for a, b in zip(first, np.append(first[1:], len(bucket)), strict=True)]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    first = runs(keys[order])
    return keys[order][first], np.add.reduceat(counts[order], first, axis=0) if len(first) else counts[:0]


def _counted(make):
    """A task that counts keys of its documents: ``make(text) -> keys``; flushed when many are held."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_pylist(_rows(keys, counts.astype(np.uint32), make.bucket(keys), 0), PARTS)

        for batch in batches:
            for part in slices(batch, 0):
                held.append(make(part.column(0)))
                if sum(map(len, held)) >= FLUSH:
                    yield flush()
        if sum(map(len, held)):
            yield flush()

    return task


class Words:
    """Counts words by ranges of their hashes."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __call__(self, text: pa.Array) -> np.ndarray:
        return tokens_of(text)[0]

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        return range_of(keys, self.buckets).astype(np.int16 if self.buckets < 2**15 else np.int32)


class Pairs:
    """Counts (previous, next) token ids; buckets are by a hash of the pair, so that frequent words spread."""

    def __init__(self, path: str, buckets: int, bases: np.ndarray):
        self.path, self.buckets, self.bases = path, buckets, bases

    def __call__(self, text: pa.Array) -> np.ndarray:
        h, bound = tokens_of(text)
        ids = word_ids(self.path, self.buckets, self.bases, h)
        return pair_keys(ids, bound, int(self.bases[-1]))

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        return pair_bucket(keys, self.buckets)


def pair_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix(keys) >> HIGH) * np.uint64(buckets) >> HIGH).astype(np.int16 if buckets < 2**15 else np.int32)


def pair_keys(ids: np.ndarray, bound: np.ndarray, begin: int) -> np.ndarray:
    """previous << 32 | id; before a document's first token stands the id past all types."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[bound[:-1]] = begin
    return before.astype(np.uint64) << HIGH | ids.astype(np.uint64)


def word_ids(path: str, buckets: int, bases: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Token ids of word hashes by their place in the sorted arrays; -1: not in training."""
    keys, back = np.unique(h, return_inverse=True)
    ids = np.full(len(keys), -1, np.int64)
    for k, a, b in touched(keys, buckets):
        if bases[k + 1] > bases[k]:
            known = mapped(f"{path}/words-{k}", "<u8")
            asked = keys[a:b]
            spot = np.minimum(np.searchsorted(known, asked), len(known) - 1)
            ids[a:b] = np.where(known[spot] == asked, bases[k] + spot, -1)
    return ids[back]


def _join_words(path: str):
    def group(rows: pa.Table) -> pa.Table:
        keys, counts = _summed(*_read(rows, 1))
        k = rows.column("bucket")[0].as_py()
        put_file(f"{path}/words-{k}", keys.astype("<u8").tobytes())
        put_file(f"{path}/counts-{k}", counts[:, 0].astype("<u8").tobytes())
        return pa.table({"bucket": pa.array([k], pa.int64()), "types": pa.array([len(keys)], pa.int64()), "tokens": pa.array([int(counts.sum())], pa.int64())})

    return group


def _read(rows: pa.Table, width: int, kind: int = 0, dtype=np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of packed rows of one kind."""
    keys, counts = [np.empty(0, dtype)], [np.empty((0, width), np.int64)]
    for kd, k, c in zip(*(rows.column(x).to_pylist() for x in ("kind", "keys", "counts")), strict=True):
        if kd == kind:
            keys.append(unpack(k, dtype))
            part = len(c) // width
            counts.append(np.stack([unpack(c[i * part : (i + 1) * part], np.uint32) for i in range(width)], 1).astype(np.int64))
    return np.concatenate(keys), np.concatenate(counts)


def _join_pairs(path: str, types: int, ranges: int):
    def group(rows: pa.Table) -> pa.Table:
        keys, counts = _summed(*_read(rows, 1))
        counts = counts[:, 0]
        k = rows.column("bucket")[0].as_py()
        put_file(f"{path}/pairs-{k}", keys.astype("<u8").tobytes())
        put_file(f"{path}/paircounts-{k}", counts.astype("<u4").tobytes())
        step = -(-(types + 1) // ranges)
        left = (keys >> HIGH).astype(np.uint32)
        prev, stats = _summed(left, np.stack([counts, counts == 1, counts == 2, counts > 2], 1).astype(np.int64))
        word, near = _summed((keys & LOW).astype(np.uint32), np.ones((len(keys), 1), np.int64))
        out = _rows(prev, stats.astype(np.uint32), (prev // step).astype(np.int32), 1) + _rows(word, near.astype(np.uint32), (word // step).astype(np.int32), 2)
        out.append({"bucket": -1, "kind": 4, "keys": b"", "counts": np.array([k], np.int64).tobytes()})
        out.append({"bucket": -1, "kind": 3, "keys": b"", "counts": np.bincount(np.minimum(counts, 5), minlength=6)[1:5].astype(np.int64).tobytes()})
        return pa.Table.from_pylist(out, PARTS)

    return group


def _join_stats(path: str, types: int, ranges: int):
    def group(rows: pa.Table) -> pa.Table:
        k = rows.column("bucket")[0].as_py()
        if k < 0:
            got = [(kd, np.frombuffer(c, np.int64)) for kd, c in zip(rows.column("kind").to_pylist(), rows.column("counts").to_pylist(), strict=True)]
            n, made = sum(c for kd, c in got if kd == 3), sorted(int(c[0]) for kd, c in got if kd == 4)
            return pa.table({"kind": pa.array([3, 4], pa.int32()), "k": pa.array([-1, -1], pa.int64()), "n": pa.array([n.tolist(), made], pa.list_(pa.int64()))})
        step = -(-(types + 1) // ranges)
        ids, stats = _summed(*_read(rows, 4, 1, np.uint32))
        full = np.zeros((min(step, types + 1 - k * step), 4), np.int64)
        full[ids - k * step] = stats
        ids, near = _summed(*_read(rows, 1, 2, np.uint32))
        left = np.zeros(len(full), np.int64)
        left[ids - k * step] = near[:, 0]
        put_file(f"{path}/next-{k}", full.astype("<i8").tobytes())
        put_file(f"{path}/left-{k}", left.astype("<i8").tobytes())
        n = [int(left.sum()), *np.bincount(np.minimum(left, 5), minlength=6)[1:5].tolist(), int((left > 2).sum())]
        return pa.table({"kind": pa.array([1], pa.int32()), "k": pa.array([k], pa.int64()), "n": pa.array([n], pa.list_(pa.int64()))})

    return group


def discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts from the numbers of things seen one to four times; where a number
    is 0, the discount of a rarer count stands in, so that small corpora have defined scores."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else None, 3 - 4 * y * n4 / n3 if n3 else None]
    for k in (1, 2):
        d[k] = d[k - 1] if d[k] is None else d[k]
    return np.clip(d, [0.05, 0.05, 0.05], [0.95, 1.9, 2.85])


def train(texts: DataFrame, buckets: int | None = None) -> Model:
    """Counts the model of the column ``text`` of ``texts`` (null: empty). Word counts, pair counts and
    neighbour counts are packed by task and summed by Spark, range by range; each range is written to
    the shared folder as sorted arrays. The driver gets a few numbers for each range. Ranges follow the
    bytes of text, so that none grows with the corpus. Which arrays were written is part of the model:
    one that is missing later is an error, never taken for counts of 0. Repeated texts count each time;
    an empty table gives a model that has seen nothing."""
    spark = texts.sparkSession
    buckets = buckets or max(16, n_groups(spark, texts))
    ranges = max(16, buckets // 4)
    path = shared_dir(spark, "bigrams")
    texts = texts.select("text")
    got = dealt(texts.mapInArrow(_counted(Words(buckets)), PART_TYPE), buckets, "bucket").groupBy("bucket").applyInArrow(_join_words(path), "bucket long, types long, tokens long").collect()
    sizes = np.zeros(buckets, np.int64)
    for r in got:
        sizes[r.bucket] = r.types
    bases = np.concatenate([[0], np.cumsum(sizes)])
    types = int(bases[-1])
    if types >= 2**32 - 1:
        raise ValueError("more than 2**32 types")
    pairs = dealt(texts.mapInArrow(_counted(Pairs(path, buckets, bases)), PART_TYPE), buckets, "bucket").groupBy("bucket").applyInArrow(_join_pairs(path, types, ranges), PART_TYPE)
    stats = dealt(pairs, ranges, "bucket").groupBy("bucket").applyInArrow(_join_stats(path, types, ranges), "kind int, k long, n array<long>").collect()
    written = frozenset([f"pairs-{k}" for r in stats if r.kind == 4 for k in r.n] + [f"{name}-{r.k}" for r in stats if r.kind == 1 for name in ("next", "left")])
    seen = np.sum([r.n for r in stats if r.kind == 3] or [[0] * 4], axis=0)
    low = np.sum([r.n for r in stats if r.kind == 1] or [[0] * 6], axis=0)
    d, e = discounts(seen), discounts(low[1:5])
    gamma = float(e[0] * low[1] + e[1] * low[2] + e[2] * low[5]) / low[0] if low[0] else 1.0
    return Model(path, buckets, ranges, written, bases, sum(r.tokens for r in got), d, e, int(low[0]), gamma)


def _take(m: Model, name: str, dtype: str, ids: np.ndarray, width: int = 1) -> np.ndarray:
    """Rows of an array kept in ranges of token ids; ``ids`` rise."""
    types = int(m.bases[-1])
    step = -(-(types + 1) // m.ranges)
    edge = np.searchsorted(ids, np.arange(m.ranges + 1) * step)
    out = np.zeros((len(ids), width), np.int64)
    for k in np.flatnonzero(np.diff(edge)):
        if f"{name}-{k}" in m.written:
            out[edge[k] : edge[k + 1]] = mapped(f"{m.path}/{name}-{k}", dtype).reshape(-1, width)[ids[edge[k] : edge[k + 1]] - k * step]
    return out


def score_batch(m: Model, text: pa.Array) -> dict[str, np.ndarray]:
    h, bound = tokens_of(text)
    types = int(m.bases[-1])
    ids = word_ids(m.path, m.buckets, m.bases, h)
    known, back = np.unique(ids[ids >= 0], return_inverse=True)
    counts = np.zeros(len(known), np.int64)
    edge = np.searchsorted(known, m.bases)
    for k in np.flatnonzero(np.diff(edge)):
        counts[edge[k] : edge[k + 1]] = mapped(f"{m.path}/counts-{k}", "<u8")[known[edge[k] : edge[k + 1]] - m.bases[k]]
    c = np.zeros(len(ids), np.int64)
    c[ids >= 0] = counts[back]
    base = np.log10((c + 0.5) / (m.tokens + 0.5 * (types + 1)))

    floor = m.low_gamma / (types + 1)
    near = _take(m, "left", "<i8", known)[:, 0]
    low = np.full(len(ids), floor)
    low[ids >= 0] = (np.where(near > 0, near - m.low_discounts[np.clip(near, 1, 3) - 1], 0.0) / max(m.low_total, 1) + floor)[back]

    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[bound[:-1]] = types
    heads, back = np.unique(before[before >= 0], return_inverse=True)
    following = _take(m, "next", "<i8", heads, 4)
    total, gamma = np.zeros(len(ids)), np.ones(len(ids))
    total[before >= 0] = following[back, 0]
    gamma[before >= 0] = np.where(following[:, 0] > 0, (following[:, 1:] @ m.discounts) / np.maximum(following[:, 0], 1), 1.0)[back]

    both = np.flatnonzero((ids >= 0) & (before >= 0))
    keys, back = np.unique(before[both].astype(np.uint64) << HIGH | ids[both].astype(np.uint64), return_inverse=True)
    bucket = pair_bucket(keys, m.buckets)
    order = np.argsort(bucket, kind="stable")
    found = np.zeros(len(keys), np.int64)
    edge = np.searchsorted(bucket[order], np.arange(m.buckets + 1))
    for k in np.flatnonzero(np.diff(edge)):
        at = order[edge[k] : edge[k + 1]]
        if f"pairs-{k}" not in m.written:
            continue
        have = mapped(f"{m.path}/pairs-{k}", "<u8")
        spot = np.minimum(np.searchsorted(have, keys[at]), len(have) - 1)
        found[at] = np.where(have[spot] == keys[at], mapped(f"{m.path}/paircounts-{k}", "<u4")[spot], 0)
    pair = np.zeros(len(ids))
    pair[both] = np.where(found > 0, found - m.discounts[np.clip(found, 1, 3) - 1], 0.0)[back]
    score = np.log10(np.where(total > 0, pair / np.maximum(total, 1), 0.0) + gamma * low)
    first = bound[:-1]
    return {
        "n_tokens": np.diff(bound), "n_known": np.add.reduceat((c > 0).astype(np.int64), first), "train_tokens": np.full(len(first), m.tokens),
        "base_score": np.add.reduceat(base, first), "score": np.add.reduceat(score, first),
    }


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``n_tokens, n_known, train_tokens, base_score, score`` to ``docs`` (column text; null: empty,
    which has the end token alone). ``score`` is the model's log10 probability of the text."""
    extra = {"n_tokens": "long", "n_known": "long", "train_tokens": "long", "base_score": "double", "score": "double"}
    docs = docs.select(*[c for c in docs.columns if c not in extra])
    place = docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, place):
                got = score_batch(model, part.column(place))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(got[c]) for c in extra)], [*part.schema.names, *extra])

    schema = docs.withColumns({c: F.lit(0).cast(t) for c, t in extra.items()}).schema
    return docs.mapInArrow(task, schema)


def held_out(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    """Whether crc32 of the id as text falls in the fold; null ids don't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def perplexity(docs: DataFrame, folds: int = 5, fold: int = 1) -> DataFrame:
    """Learns from the documents outside the held-out fold and scores all: adds ``held_out`` and what
    :func:`score_texts` adds. Empty tables and tables without training rows give scores of a model
    that has seen nothing."""
    marked = docs.drop("held_out").withColumn("held_out", held_out(F.col("doc_id"), folds, fold))
    return score_texts(marked, train(marked.filter(~F.col("held_out"))))
