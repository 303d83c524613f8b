"""Toxicity: linear classifiers by non-negative positive-unlabelled learning over hashed word features."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import buffers, hash_spans, runs, settle, slices, spread, word_spans

PREFIXES = (4, 5, 6, 7, 8)  # bytes of a word's beginning that are features besides the word
DIMENSION_BITS = 24
POSITIVES, UNLABELLED = 8_000, 16_000  # bounds of the two training samples
KEEP = 1_500  # features of a model at most
SIGNIFICANT = 3.0  # standard errors by which a feature's shares in the two samples differ at least
FOLDS = 4  # parts of the samples whose scores, from models that haven't seen them, fit the scale


class Model(NamedTuple):
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float
    prior: float
    slope: float  # of the scale that turns raw values into log-odds
    shift: float

    def score(self, raw: np.ndarray) -> np.ndarray:
        """Chances from raw values."""
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * raw + self.shift, -40, 40)))


_TRIM = np.ones(256, bool)
_TRIM[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = False


def word_features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature hash, count) of the distinct features of each document, and words by document.
    Words are lower-cased and lose ASCII punctuation at both ends; features are the word and its
    beginnings."""
    data, offsets = buffers(text)
    starts, ends, doc = word_spans(data, offsets)
    for _ in range(3):
        starts = starts + ((ends > starts) & ~_TRIM[data[np.minimum(starts, max(len(data) - 1, 0))]] if len(starts) else 0)
        ends = ends - ((ends > starts) & ~_TRIM[data[np.maximum(ends - 1, 0)]] if len(ends) else 0)
    n_words = np.bincount(doc, minlength=len(text))
    keep = ends > starts
    starts, ends, doc = starts[keep], ends[keep], doc[keep]
    all_h, all_d = [hash_spans(data, starts, ends, lower=True)], [doc]
    for k in PREFIXES:
        at = np.flatnonzero(ends - starts > k)
        all_h.append(hash_spans(data, starts[at], starts[at] + k, lower=True) ^ np.uint64(k))
        all_d.append(doc[at])
    h = np.concatenate(all_h) >> np.uint64(64 - DIMENSION_BITS)
    d = np.concatenate(all_d)
    key, count = np.unique(d.astype(np.uint64) << np.uint64(DIMENSION_BITS) | h, return_counts=True)
    return (key >> np.uint64(DIMENSION_BITS)).astype(np.int64), (key & np.uint64((1 << DIMENSION_BITS) - 1)).astype(np.int64), count, n_words


def values(count: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """A feature's value: how often it occurs, damped, beside the length of the text."""
    return np.log1p(count) / np.sqrt(1.0 + np.log1p(n_words))


def matrix(features: np.ndarray, doc: np.ndarray, h: np.ndarray, count: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, column, value) of the features that the model keeps."""
    if not len(features):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    spot = np.minimum(np.searchsorted(features, h), len(features) - 1)
    at = np.flatnonzero(features[spot] == h)
    return doc[at], spot[at], values(count[at], n_words[doc[at]])


class Rows(NamedTuple):
    """Sparse rows: the elements of row k are those from ``edges[k]`` to ``edges[k + 1]``."""

    edges: np.ndarray
    columns: np.ndarray
    vals: np.ndarray

    def pick(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``chosen``, column, value) of the elements of the chosen rows."""
        n = self.edges[chosen + 1] - self.edges[chosen]
        at = np.repeat(self.edges[chosen] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(np.arange(len(chosen)), n), self.columns[at], self.vals[at]


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """The two terms of the positive-unlabelled risk with logistic loss, of raw values of both samples:
    prior * R_P(+1), and R_U(-1) - prior * R_P(-1), which is the risk on negatives and counts as 0 below it."""
    return prior * np.logaddexp(0, -positive).mean(), np.logaddexp(0, unlabelled).mean() - prior * np.logaddexp(0, positive).mean()


def pull(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """By how much a step moves each raw value: the gradient of the whole risk, or, while the second term
    is negative, that of its opposite alone."""
    sigmoid = lambda z: 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
    n_p, n_u = len(positive), len(unlabelled)
    plus, minus, all_minus = -sigmoid(-positive) / n_p, sigmoid(positive) / n_p, sigmoid(unlabelled) / n_u
    if risk(positive, unlabelled, prior)[1] >= 0:
        return np.concatenate([prior * (plus - minus), all_minus])
    return np.concatenate([prior * minus, -all_minus])


def nn_pu(x: Rows, positive: np.ndarray, unlabelled: np.ndarray, width: int, prior: float, rounds: int = 1000, rate: float = 0.05, decay: float = 1e-3, seed: int = 3, batch: tuple[int, int] = (256, 1024)) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier that minimises the non-negative positive-unlabelled risk
    prior * R_P(+1) + max(0, R_U(-1) - prior * R_P(-1)): Adam over random batches of both samples, given
    as numbers of rows of ``x``, with weights pulled towards 0 by ``decay``."""
    rng = np.random.RandomState(seed)
    w, b = np.zeros(width), np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, rounds + 1):
        n_p, n_u = min(len(positive), batch[0]), min(len(unlabelled), batch[1])
        drawn = np.concatenate([positive[rng.randint(0, len(positive), n_p)], unlabelled[rng.randint(0, len(unlabelled), n_u)]])
        row, col, val = x.pick(drawn)
        f = np.bincount(row, w[col] * val, minlength=n_p + n_u) + b
        move = pull(f[:n_p], f[n_p:], prior)
        g = np.append(np.bincount(col, move[row] * val, minlength=width) + decay * w, move.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def scale(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 1500, rate: float = 0.05) -> tuple[float, float]:
    """(slope, shift) that turn raw values into log-odds: those that minimise the same risk over values from
    models that haven't seen the texts. The slope stays positive, so that the order of texts does too."""
    at, m, v = np.array([1.0, 0.0]), np.zeros(2), np.zeros(2)
    for t in range(1, rounds + 1):
        move = pull(at[0] * positive + at[1], at[0] * unlabelled + at[1], prior)
        g = np.array([move[: len(positive)] @ positive + move[len(positive) :] @ unlabelled, move.sum()])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        at = at - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        at[0] = max(at[0], 1e-3)
    return float(at[0]), float(at[1])


def learnable(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether labels of this row may be learned from: crc32 of the id as text isn't in the held-out fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds != fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, keep: int = KEEP, significant: float = SIGNIFICANT, folds: int = FOLDS) -> Model | None:
    """Learns from rows of the learnable folds: confirmed toxic texts, and unlabelled texts (any rows, their
    labels unread). Both samples are bounded: the first ids by hash of doc_id, of rows that share an id the
    least text. The class prior is the share of toxic among the labelled rows (ids with several labels
    count once, as toxic if one says so; null ids and labels don't count). Features are those whose shares
    in the two samples differ by ``significant`` standard errors or more, at most ``keep``, the most
    significant first, ties by hash; Spark counts them over the samples.

    The samples are dealt into ``folds`` by digest of their texts. Each part is scored by a model that has
    seen none of it, neither in its features nor in its weights; these values fit the scale that turns raw
    values into chances. With fewer than two toxic texts for each fold the raw values serve as log-odds.
    None where no toxic row or no text can be learned from, or no feature differs (also: empty tables)."""
    known = labels.filter(F.col("toxic").isNotNull() & learnable(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    if not share.n or not share.toxic:
        return None
    prior = min(0.9, max(1e-3, share.toxic / share.n))
    order = F.xxhash64("doc_id")
    chosen = known.filter("toxic = 1").select("doc_id", order.alias("h")).orderBy("h").limit(positives).select(F.col("doc_id").alias("id"), F.lit(1).alias("side"))
    chosen = chosen.unionByName(docs.filter(learnable(F.col("doc_id")) & F.col("text").isNotNull()).select("doc_id", order.alias("h")).distinct().orderBy("h").limit(unlabelled).select(F.col("doc_id").alias("id"), F.lit(0).alias("side")))
    sample = docs.join(F.broadcast(chosen), docs.doc_id == chosen.id).groupBy("side", "id").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    sample = settle(sample.select("side", F.pmod(F.xxhash64("text"), F.lit(folds)).cast("int").alias("fold"), "text"), "toxicity-sample")
    cell = lambda side, fold: side * folds + fold
    sizes = np.zeros(2 * folds, np.int64)
    for r in sample.groupBy("side", "fold").count().collect():
        sizes[cell(r.side, r.fold)] = r["count"]
    n_u, n_p = sizes.reshape(2, folds).sum(axis=1)
    if not n_p or not n_u:
        return None
    checked = n_p >= 2 * folds and (sizes.reshape(2, folds).sum(axis=1, keepdims=True) > sizes.reshape(2, folds)).all()
    names = [f"c{k}" for k in range(2 * folds)]

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                where = cell(np.asarray(part.column(0), np.int64), np.asarray(part.column(1), np.int64))
                doc, h, _, _ = word_features(part.column(2))
                order = np.argsort(h, kind="stable")
                first = runs(h[order])
                if len(first):
                    counts = [pa.array(np.add.reduceat((where[doc[order]] == k).astype(np.int64), first)) for k in range(2 * folds)]
                    yield pa.RecordBatch.from_arrays([pa.array(h[order][first]), *counts], ["h", *names])

    total = sample.mapInArrow(tally, "h long, " + ", ".join(f"{c} long" for c in names)).groupBy("h").agg(*[F.sum(c).alias(c) for c in names])
    tested = []  # for the model of all parts (-1) and the model without each part: how much a feature's shares differ
    for left_out in [-1, *range(folds if checked else 0)]:
        used = [k for k in range(folds) if k != left_out]
        found, size = [], []
        for side in (1, 0):
            found.append(sum((F.col(names[cell(side, k)]) for k in used), F.lit(0)))
            size.append(int(sum(sizes[cell(side, k)] for k in used)))
        p, u = ((c + 0.5) / (n + 1.0) for c, n in zip(found, size, strict=True))
        error = F.sqrt(F.abs(p * (1 - p)) / size[0] + F.abs(u * (1 - u)) / size[1] + 1e-12)
        tested.append(F.struct(F.lit(left_out).alias("left_out"), (found[0] + found[1]).alias("n"), (F.abs(p - u) / error).alias("gain")))
    best = total.select("h", F.explode(F.array(*tested)).alias("t")).select("h", "t.*").filter((F.col("n") >= 4) & (F.col("gain") >= significant))
    rank = F.row_number().over(Window.partitionBy("left_out").orderBy(F.col("gain").desc(), "h"))
    picked = best.withColumn("rank", rank).filter(F.col("rank") <= keep).select("left_out", "h").collect()
    features = np.array(sorted({r.h for r in picked}), np.int64)
    if not len(features):
        return None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                doc, col, val = matrix(features, *word_features(part.column(2)))
                edge = np.searchsorted(doc, np.arange(part.num_rows + 1))
                lists = [pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(x)) for x in (col.astype(np.int32), val.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], ["side", "fold", "columns", "vals"])

    got = sample.mapInArrow(rows, "side int, fold int, columns array<int>, vals array<float>").toArrow()
    cols, vals = got.column("columns").combine_chunks(), got.column("vals").combine_chunks()
    edges, columns, value = np.append(0, np.cumsum(np.asarray(cols.value_lengths(), np.int64))), np.asarray(cols.flatten()), np.asarray(vals.flatten())
    side, fold = np.asarray(got.column("side")), np.asarray(got.column("fold"))

    def fitted(left_out: int) -> tuple[np.ndarray, float]:
        mine = np.zeros(len(features), bool)
        mine[np.searchsorted(features, [r.h for r in picked if r.left_out == left_out])] = True
        x = Rows(edges, columns, value * mine[columns])
        return nn_pu(x, np.flatnonzero((side == 1) & (fold != left_out)), np.flatnonzero((side == 0) & (fold != left_out)), len(features), prior)

    raw = np.zeros(len(side))
    at = spread(edges[:-1], len(columns)) if len(columns) else np.empty(0, np.int64)
    for k in range(folds if checked else 0):
        w, b = fitted(k)
        raw[fold == k] = (np.bincount(at, w[columns] * value, minlength=len(side)) + b)[fold == k]
    slope, shift = scale(raw[side == 1], raw[side == 0], prior) if checked else (1.0, 0.0)
    w, b = fitted(-1)
    return Model(features, w, b, prior, slope, shift)


def score_toxicity(docs: DataFrame, model: Model | None, into: str = "score") -> DataFrame:
    """Adds ``into`` (0 to 1; higher: likelier toxic) to ``docs``; a column of that name is replaced, all
    others are kept. Null and empty texts have the score of a text without features; equal texts have
    equal scores; an empty table gives no rows; without a model every score is 0."""
    docs = docs.drop(into)
    if model is None:
        return docs.withColumn(into, F.lit(0.0))
    place = docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, place):
                doc, col, val = matrix(model.features, *word_features(part.column(place)))
                z = np.bincount(doc, model.weights[col] * val, minlength=part.num_rows) + model.bias
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(z))], [*part.schema.names, into])

    return docs.mapInArrow(task, docs.withColumn(into, F.lit(0.0)).schema)
