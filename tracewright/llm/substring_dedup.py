"""Substring dedup: repeated windows of words, by Rabin-Karp hashes counted in Spark."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import buffers, dealt, fresh, hash_spans, n_groups, pack, runs, slices, spread, touched, trim, unpack, windows, word_spans

FLUSH = 600_000  # windows that a task holds before it passes them on; it takes some 120 bytes each while it sorts and packs them
BLOBS = pa.schema([("target", pa.int64()), ("kind", pa.int32()), ("docs", pa.binary()), ("keys", pa.binary())])
BLOB_TYPE = "target long, kind int, docs binary, keys binary"


def doc_windows(text: pa.Array, size: int):
    """(bytes, word starts, ends, document of each word, window hash, window's first word)."""
    data, offsets = buffers(text)
    starts, ends, doc = word_spans(data, offsets)
    hashes, at = windows(hash_spans(data, starts, ends), doc, size)
    return data, offsets, starts, ends, doc, hashes, at


def by_doc(docs: np.ndarray, keys: np.ndarray, blocks: int) -> Iterator[dict]:
    """Answers as packed rows, one for each block of documents."""
    block = np.mod(docs, blocks)
    order = np.lexsort((docs, block))
    docs, keys, block = docs[order], keys[order], block[order]
    first = runs(block)
    for a, b in zip(first, np.append(first[1:], len(block)), strict=True):
        yield {"target": int(block[a]), "kind": 1, "docs": pack(docs[a:b]), "keys": pack(keys[a:b])}


def to_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, BLOBS)


def ask(size: int, buckets: int, blocks: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            h, d = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            held.clear()
            order = np.argsort(h)
            h, d = h[order], d[order]
            first = runs(h)
            least = np.minimum.reduceat(d, first)
            late = d > np.repeat(least, np.diff(np.append(first, len(h))))
            # within these documents the answer is known; only the smallest asks on for each window
            rows = list(by_doc(d[late], h[late], blocks)) if late.any() else []
            keys = h[first]
            for k, a, b in touched(keys, buckets):
                rows.append({"target": k, "kind": 0, "docs": pack(least[a:b]), "keys": pack(keys[a:b])})
            return to_batch(rows)

        for batch in batches:
            for part in slices(batch, 1):
                docs = np.asarray(part.column(0), np.int64)
                *_, doc, hashes, at = doc_windows(part.column(1), size)
                held.append((hashes, docs[doc[at]]))
                if sum(len(h) for h, _ in held) >= FLUSH:
                    yield flush()
        if sum(len(h) for h, _ in held):
            yield flush()
        trim()

    return task


def answer(blocks: int):
    def group(rows: pa.Table) -> pa.Table:
        asked = [(unpack(k, np.uint64), unpack(d, np.int64)) for kind, d, k in zip(*(rows.column(c).to_pylist() for c in ("kind", "docs", "keys")), strict=True) if kind == 0]
        out = [{"target": t, "kind": 1, "docs": d, "keys": k} for t, kind, d, k in zip(*(rows.column(c).to_pylist() for c in ("target", "kind", "docs", "keys")), strict=True) if kind == 1]
        if asked:
            h, d = (np.concatenate([x[i] for x in asked]) for i in (0, 1))
            order = np.argsort(h)
            h, d = h[order], d[order]
            first = runs(h)
            least = np.minimum.reduceat(d, first)
            late = d > least[spread(first, len(h))]
            if late.any():
                out += by_doc(d[late], h[late], blocks)
        return pa.Table.from_pylist(out, BLOBS)

    return group


def spans_of(covered: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of covered words as (first, past the last)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def cut(size: int, target: str):
    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        docs, keys = np.empty(0, np.int64), np.empty(0, np.uint64)
        if right.num_rows:
            docs = np.concatenate([unpack(x, np.int64) for x in right.column("docs").to_pylist()])
            keys = np.concatenate([unpack(x, np.uint64) for x in right.column("keys").to_pylist()])
            order = np.argsort(docs, kind="stable")
            docs, keys = docs[order], keys[order]
        n_docs = left.num_rows
        data, offsets, _, _, doc, hashes, at = doc_windows(left.column("text"), size)
        raw = data.tobytes()
        ids = left.column("doc_id").combine_chunks()
        known, ids = np.asarray(ids.is_valid()), np.asarray(ids.fill_null(0), np.int64)
        word_edge = np.searchsorted(doc, np.arange(n_docs + 1))
        win_edge = np.searchsorted(doc[at], np.arange(n_docs + 1))
        lo, hi = np.searchsorted(docs, ids, "left"), np.searchsorted(docs, ids, "right")
        n_words, n_removed, kept, spans = [], [], [], []
        for i in range(n_docs):
            a, n = word_edge[i], int(word_edge[i + 1] - word_edge[i])
            gone: list[tuple[int, int]] = []
            words = raw[offsets[i] : offsets[i + 1]].split()
            if known[i] and hi[i] > lo[i] and n >= size:
                w0, w1 = win_edge[i], win_edge[i + 1]
                begin = at[w0:w1][np.isin(hashes[w0:w1], keys[lo[i] : hi[i]])] - a
                edge = np.zeros(n + 1, np.int32)
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + size, -1)
                covered = np.cumsum(edge[:-1]) > 0
                gone = spans_of(covered)
                words = list(itertools.compress(words, (~covered).tolist()))
            n_words.append(n)
            n_removed.append(sum(b - a for a, b in gone))
            kept.append(b" ".join(words).decode("utf-8"))
            spans.append([{"first": a, "past": b} for a, b in gone])
        out = left.drop_columns([target])
        span = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))
        for name, values, kind in (("n_words", n_words, pa.int64()), ("n_removed", n_removed, pa.int64()), ("kept_text", kept, pa.string()), ("removed", spans, span)):
            out = out.append_column(name, pa.array(values, kind))
        return out

    return group


def cut_repeats(docs: DataFrame, size: int = 13) -> DataFrame:
    """Adds ``n_words, n_removed, kept_text, removed`` to ``docs`` (doc_id long, text string, others kept).

    A window is ``size`` consecutive words of one document; every word that a window covers goes if the
    window's word sequence also starts in a document with a smaller doc_id. ``removed`` has the maximal
    intervals of removed words (first, past the last), ``kept_text`` the kept words joined by one space.
    Windows are judged on the input. Null or empty texts and texts of fewer words keep all they have; a
    row with a null doc_id neither removes nor loses words; repeated rows with one doc_id don't remove
    each other's windows.

    Each task hashes the windows of its rows, settles repeats among them by itself and asks about each
    distinct window once, with the smallest doc_id that has it, so that a window which a third of all
    documents hold costs one entry for each ``FLUSH`` windows. The entries are packed into
    arrays by range of hash, Spark shuffles the arrays, and answers go back by document. Windows count
    as equal by 64-bit hashes: among 10**8 distinct windows a false match has a chance below 0.001.
    Ranges of hashes and blocks of documents follow the bytes of text, so that none grows with the input.
    Columns of ``docs`` named like the added ones are replaced; empty tables give no rows.
    """
    extra = ("n_words", "n_removed", "kept_text", "removed")
    docs = docs.select(*[c for c in docs.columns if c not in extra])
    known = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    buckets = n_groups(docs.sparkSession, docs)
    blocks = 3 * buckets  # texts weigh more than what is asked about them
    asked = known.mapInArrow(ask(size, buckets, blocks), BLOB_TYPE)
    answers = dealt(asked, buckets).groupBy("target").applyInArrow(answer(blocks), BLOB_TYPE)
    # rows without doc_id go anywhere; they ask and are answered nothing
    (target,) = fresh(docs, "target")
    block = F.pmod(F.coalesce(F.col("doc_id"), F.xxhash64("text")), F.lit(blocks)).cast("long")
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_words long, n_removed long, kept_text string, removed array<struct<first:int,past:int>>"
    left = dealt(docs.withColumn(target, block), buckets, target).groupBy(target)
    return left.cogroup(dealt(answers, buckets).groupBy("target")).applyInArrow(cut(size, target), out)
