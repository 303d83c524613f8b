"""Ranked lexical search: each task keeps its documents in a frequency-ordered prefix tree, whose bounds cut
the depth-first search of every item short."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, sqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import buffers, hash_spans, runs, settle, slices, word_spans

PAIRS = 1 << 18  # pairs of item and term in a block of items
POSTINGS = 1 << 21  # postings of documents that a task holds in one tree
CELLS = 1 << 23  # cells of a tree's table of bounds
LEAF = 64  # documents that are scored together
SEED_ROWS = 1 << 20  # documents from which on some are searched first, for a bound
#: Bytes outside terms become blanks, A-Z lower case; all of a term's other characters stay.
BYTES = np.full(256, 0x20, np.uint8)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    BYTES[_a:_b] = np.arange(_a, _b)
BYTES[0x41:0x5B] += 0x20


def term_hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, row) of each term: maximal runs of ASCII letters, digits and characters beyond ASCII."""
    data, offsets = buffers(text)
    data = BYTES[data]
    starts, ends, row = word_spans(data, offsets)
    return hash_spans(data, starts, ends), row


class Weights(NamedTuple):
    """What scores need of all documents: ``rank`` of each term by falling document frequency, ``weight`` by
    rank, and the numbers of documents and of terms with repeats."""

    rank: np.ndarray
    weight: np.ndarray
    documents: int
    terms: int


def weigh_terms(df: np.ndarray, documents: int, terms: int) -> Weights:
    order = np.argsort(-df, kind="stable")
    rank = np.empty(len(df), np.int32)
    rank[order] = np.arange(len(df))
    weight = np.array([int(1000 * log((2 * documents + 2) / (2 * n + 1))) for n in df[order].tolist()], np.int64)
    return Weights(rank, weight, documents, terms)


def lengths(n: np.ndarray, w: Weights) -> np.ndarray:
    """A document's m from its number of terms; beyond 64 bits in whole numbers of any size."""
    if len(n) and int(n.max()) * 50 * w.documents >= 1 << 62:
        return np.array([50 + 50 * x * w.documents // w.terms for x in n.tolist()], np.int64)
    return 50 + 50 * n * w.documents // w.terms


def share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a posting adds for each unit of its term's weight: rises with tf, falls with m."""
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class Tree(NamedTuple):
    """Documents in the order of their paths. A node is a run of documents with a common beginning of their
    paths: leaves first, then inner nodes, the root last. ``bounds`` has for each term and node the share of
    the largest tf below the node with the smallest m below it."""

    ids: np.ndarray  # place of each document's id in their order
    offset: np.ndarray  # of each document's postings
    rank: np.ndarray
    part: np.ndarray  # share of each posting
    leaf: np.ndarray  # first document of each leaf, and the number of all
    children: list[list[int]]  # of inner nodes
    bounds: np.ndarray


def cut_paths(common: np.ndarray, leaf: int) -> tuple[np.ndarray, list[list[int]]]:
    """(first document of each leaf, children of each inner node), children before parents, the root last.

    ``common[i]``: how many terms the paths of documents i-1 and i share from the root. A run of documents is
    cut where its paths first part. A branch that holds more than half of its run is cut on in the same
    step, so that the tree's height grows with the logarithm of the documents; branches of few documents beside
    each other make a leaf together."""
    first: list[int] = []
    children: list[list[int]] = []

    def grow(lo: int, hi: int) -> int:
        """The node of a run; leaves get the numbers -1, -2, ... for now."""
        if hi - lo <= leaf:
            first.append(lo)
            return -len(first)
        own: list[int] = []
        held = lo  # first document of a leaf that isn't closed

        def close(upto: int) -> None:
            nonlocal held
            for a in range(held, upto, leaf):
                first.append(a)
                own.append(-len(first))
            held = upto

        a, b = lo, hi
        after: list[tuple[int, int]] = []  # runs to the right of the branch that is cut on, the nearest last
        while True:
            inner = common[a + 1 : b]
            edges = np.concatenate([[a], a + 1 + np.flatnonzero(inner == inner.min()), [b]])
            wide = np.flatnonzero(np.diff(edges) > leaf).tolist()
            heavy = [k for k in wide if edges[k + 1] - edges[k] > (hi - lo) // 2]
            stop = heavy[0] if heavy else len(edges) - 1
            for k in wide:
                if k < stop:
                    close(int(edges[k]))
                    own.append(grow(int(edges[k]), int(edges[k + 1])))
                    held = int(edges[k + 1])
            if not heavy:
                break
            after += [(int(edges[k]), int(edges[k + 1])) for k in reversed(wide) if k > stop]
            a, b = int(edges[stop]), int(edges[stop + 1])
        for x, y in reversed(after):
            close(x)
            own.append(grow(x, y))
            held = y
        close(hi)
        children.append(own)
        return len(children) - 1

    if grow(0, len(common)) < 0:
        children.append([-1])
    order = np.argsort(first, kind="stable")  # leaves by their place, inner nodes behind them
    place = np.empty(len(first), np.int64)
    place[order] = np.arange(len(first))
    return np.array(first, np.int64)[order], [[len(first) + c if c >= 0 else int(place[-1 - c]) for c in own] for own in children]


def plant(ids: pa.Array, n: np.ndarray, size: np.ndarray, rank: np.ndarray, tf: np.ndarray, w: Weights) -> tuple[Tree, pa.Array]:
    """The tree of documents with ``size`` postings each, at least one, and their ids in its order."""
    doc = np.repeat(np.arange(len(size)), size)
    inside = np.lexsort((rank, doc))
    rank, tf = rank[inside], tf[inside].astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    raw = rank.astype(">u4").tobytes()
    paths = [raw[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    order = np.array(sorted(range(len(size)), key=paths.__getitem__), np.int64)
    size, n = size[order], n[order]
    offset = np.concatenate([[0], np.cumsum(size)])
    doc = np.repeat(np.arange(len(size)), size)
    step = np.arange(offset[-1]) - offset[doc]
    take = ends[order][doc] + step
    rank, tf = rank[take], tf[take]
    # where each path parts from the one before it
    before = np.flatnonzero((doc > 0) & (step < np.concatenate([[0], size[:-1]])[doc]))
    parts = before[rank[before] != rank[offset[doc[before] - 1] + step[before]]]
    common = np.minimum(size, np.concatenate([[0], size[:-1]]))
    np.minimum.at(common, doc[parts], step[parts])

    m = lengths(n, w)
    leaf = max(LEAF, ceil(2 * len(size) * len(w.weight) / CELLS))
    first, children = cut_paths(common, leaf)
    total = len(first) + len(children)
    most = np.zeros((total, len(w.weight)), np.int32)
    least = np.empty(total, np.int64)
    least[: len(first)] = np.minimum.reduceat(m, first)
    at = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(size))))[doc]
    np.maximum.at(most.reshape(-1), at * len(w.weight) + rank, tf.astype(np.int32))
    for k, own in enumerate(children, len(first)):
        most[k], least[k] = most[own].max(axis=0), least[own].min()
    bounds = np.empty((len(w.weight), total), np.int32)
    for a in range(0, len(w.weight), 1024):
        bounds[a : a + 1024] = share(most[:, a : a + 1024].T.astype(np.int64), least)
    names = ids.take(pa.array(order))
    by = np.asarray(pa.compute.sort_indices(names, null_placement="at_end"))
    named = np.empty(len(by), np.int64)
    named[by] = np.arange(len(by))
    return Tree(named, offset, rank, share(tf, m[doc]), np.append(first, len(size)), children, bounds), names


def climb(tree: Tree, terms: np.ndarray, w: Weights, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, leaves scored): the ``k`` best of one item, by score, then id, of those that reach
    ``floor``. Depth first, children of higher bounds first; a subtree goes when its bound is below the
    ``k``-th score so far (one that equals it may hold a smaller id). ``weights``: zeros, lent for the item."""
    bound = w.weight[terms] @ tree.bounds[terms].astype(np.int64)
    weights[terms] = w.weight[terms]
    leaves, floor = len(tree.leaf) - 1, max(1, floor)
    docs, scores, looked = np.empty(0, np.int64), np.empty(0, np.int64), 0
    todo = [leaves + len(tree.children) - 1]
    while todo:
        node = todo.pop()
        if bound[node] < floor:
            continue
        if node >= leaves:
            own = np.array(tree.children[node - leaves])
            own = own[bound[own] >= floor]
            todo.extend(own[np.argsort(bound[own], kind="stable")].tolist())
            continue
        looked += 1
        a, b = tree.leaf[node], tree.leaf[node + 1]
        p, q = tree.offset[a], tree.offset[b]
        s = np.add.reduceat(weights[tree.rank[p:q]] * tree.part[p:q], tree.offset[a:b] - p)
        good = np.flatnonzero(s >= floor)
        docs, scores = np.concatenate([docs, a + good]), np.concatenate([scores, s[good]])
        if len(docs) > k:
            best = np.lexsort((tree.ids[docs], -scores))[:k]
            docs, scores = docs[best], scores[best]
            floor = max(floor, int(scores[-1]))
    weights[terms] = 0
    return docs, scores, looked


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the hashes of an item's terms, once each, over all rows of its id."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1):
                h, row = term_hashes(piece.column(1))
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(row)), pa.array(h.view(np.int64))], ["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", F.col("text").cast("string")).mapInArrow(task, f"item_id {kind}, term long").distinct()


def restricted(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tf): of each text with terms their number, and which of the sorted hashes
    ``words`` it holds how often."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1):
                h, row = term_hashes(piece.column(1))
                n = np.bincount(row, minlength=piece.num_rows)
                spot = np.minimum(np.searchsorted(words, h), len(words) - 1)
                hit = words[spot] == h
                keys, tf = np.unique(row[hit] * len(words) + spot[hit], return_counts=True)
                ends = np.searchsorted(keys, np.arange(piece.num_rows + 1) * len(words)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32))) for v in (keys % len(words), tf)]
                out = pa.RecordBatch.from_arrays([piece.column(0), pa.array(n), *lists], ["doc_id", "n", "terms", "tf"])
                yield out.filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(task, "doc_id long, n long, terms array<int>, tf array<int>")


def document_frequency(vectors: DataFrame, n_terms: int) -> np.ndarray:
    """Documents of each term; a task adds up its own, and one number for each term of the block comes back."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(n_terms, np.int64)
        for batch in batches:
            n += np.bincount(np.asarray(batch.column(0).flatten()), minlength=n_terms)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["term", "n"])

    got = vectors.select("terms").mapInArrow(task, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_terms, np.int64)
    out[np.asarray(got.column("term"))] = np.asarray(got.column("n"))
    return out


def search_trees(vectors: DataFrame, ids: pa.Array, terms: list[np.ndarray], w: Weights, k: int, floors: np.ndarray, kind: str) -> DataFrame:
    """(item_id, doc_id, score): the ``k`` best of each item in each tree."""

    def search(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        lists, tf = t.column("terms").chunk(0), t.column("tf").chunk(0)
        size = np.asarray(lists.value_lengths(), np.int64)
        tree, names = plant(t.column("doc_id").chunk(0), np.asarray(t.column("n")), size, w.rank[np.asarray(lists.flatten())], np.asarray(tf.flatten()), w)
        lent = np.zeros(len(w.weight), np.int64)
        got = [climb(tree, own, w, lent, k, floor) for own, floor in zip(terms, floors.tolist(), strict=True)]
        item = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])
        docs, scores = (np.concatenate([g[i] for g in got]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(item)), names.take(pa.array(docs)), pa.array(scores)], ["item_id", "doc_id", "score"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        weight = 0
        for batch in batches:
            held.append(batch)
            weight += len(batch.column(2).flatten())
            if weight >= POSTINGS:
                yield search(held)
                held, weight = [], 0
        if weight:
            yield search(held)

    return vectors.filter("size(terms) > 0").select("doc_id", "n", "terms", "tf").mapInArrow(task, f"item_id {kind}, doc_id long, score long")


def best_of(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def rank_documents(items: DataFrame, docs: DataFrame, k: int = 50, pairs: int = PAIRS, seed_rows: int = SEED_ROWS) -> DataFrame:
    """``items`` (item_id, text), ``docs`` (doc_id, text) -> ``item_id, rank, doc_id, score``: the ``k`` documents of
    highest score above 0 of each item, equal scores by ascending doc_id, null last.

    Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, only A-Z lower-cased; a null or
    empty text has none. The score is the sum, over the item's terms once each, of the term's weight
    floor(1000 ln((2N+2) / (2df+1))) times (10^9 tf) div (1000 tf + 20 m), with m = 50 + (50 n N) div L over the
    documents that have terms. Rows of one item_id are one item with the terms of all of them, null ids
    too; rows that repeat a document are ranked each. Items or documents without terms give no rows; other
    columns are dropped. Terms are taken as equal by 64-bit hashes.

    Items come in blocks of about ``pairs`` pairs of item and term, whatever their number; a block is what goes
    through the driver and into tasks. For a block, texts are read once into vectors of its terms only, which
    are written to the shared folder; document frequencies are added up in tasks. A task then gathers up to
    ``POSTINGS`` postings, plants the tree and searches it for every item; no document is shuffled, and of each
    tree only ``k`` rows an item go on. Where there are ``seed_rows`` documents or more, the square root of the
    number of trees is searched first: the ``k``-th score found there is a lower bound for each item, with which
    the search of all starts, so that what is shuffled grows with the square root of the documents.
    Copies share their path; a group of any size is cut into leaves, of which those with equal scores are
    looked at and ``k`` of them returned.
    """
    spark = docs.sparkSession
    kind, arrow = items.schema["item_id"].dataType.simpleString(), to_arrow_type(items.schema["item_id"].dataType)
    asked = settle(item_terms(items), "items")
    n_blocks = max(1, ceil(asked.count() / pairs))
    out = None
    for b in range(n_blocks):
        block = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b).orderBy("item_id", "term").toArrow()
        if not block.num_rows:
            continue
        names = block.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode")
        words, spot = np.unique(np.asarray(block.column("term"), np.int64).view(np.uint64), return_inverse=True)
        vectors = settle(restricted(docs, words), "vectors")
        n = vectors.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        if not n.documents:
            continue
        w = weigh_terms(document_frequency(vectors, len(words)), n.documents, n.terms)
        first = runs(np.asarray(names.indices))
        terms = np.split(w.rank[spot], first[1:])
        ids = names.dictionary.cast(arrow)
        floors = np.zeros(len(terms), np.int64)
        if n.documents >= seed_rows:
            some = vectors.filter(F.pmod(F.xxhash64("doc_id", "n"), F.lit(ceil(sqrt(n.documents * 128 / POSTINGS)))) == 0)
            low = best_of(search_trees(some, ids, terms, w, k, floors, kind), k).filter(F.col("rank") == k).select("item_id", "score").toArrow()
            at = {v: i for i, v in enumerate(ids.to_pylist())}
            for v, s in zip(low.column("item_id").to_pylist(), low.column("score").to_pylist(), strict=True):
                floors[at[v]] = s
        found = search_trees(vectors, ids, terms, w, k, floors, kind)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], f"item_id {kind}, doc_id long, score long")
    return best_of(out, k).select("item_id", "rank", "doc_id", "score")
