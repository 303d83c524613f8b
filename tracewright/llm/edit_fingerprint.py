"""Document fingerprints: a randomised edit embedding (shared random walks over the characters, so that
edit distance becomes Hamming distance), of which fixed places are sampled."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .itq_links import joined
from .shared import GROUP_BYTES, components, dealt, mix, runs, settle, slices

SLOTS = 256  # sampled places, of 4 bits each
PERIOD = 4096  # rows of the table of random bits; steps use it in turn
CHUNK = 6_000_000  # characters walked at a time
FIRST = -(2**63)
BAND_BITS = 16  # of a bucket's key that tell its band
MEET = 512  # fingerprints of one bucket that meet at a time
GROUP_ROWS = 1 << 16  # slots of nodes, those that meet no other among them, behind a group of small buckets
PAIRS = 40_000  # pairs compared at a time


@functools.lru_cache(maxsize=4)
def _random(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bits by step and character, how far each slot looks, where in it, salted values)."""
    with np.errstate(over="ignore"):
        bits = (mix(np.arange(PERIOD * 256, dtype=np.uint64) + np.uint64(seed << 32)) >> np.uint64(40)).astype(np.int64) & 1
        bits = bits.reshape(PERIOD, 256)
        bits[:, 0] = 0  # past the end a walk stays
        unit = mix(np.arange(2 * SLOTS, dtype=np.uint64) + np.uint64((seed << 32) + (1 << 31))).astype(np.float64) / 2.0**64
        value = (mix(np.arange(SLOTS * 256, dtype=np.uint64) + np.uint64((seed << 32) + (3 << 30))) >> np.uint64(33)).astype(np.uint8).reshape(SLOTS, 256) & 15
    return bits, 0.5 + unit[:SLOTS] / 2, unit[SLOTS:], value


def sampled_places(length: np.ndarray, seed: int) -> np.ndarray:
    """The step that each slot samples of an embedding of so many steps. Embeddings of about the same
    length are sampled at the same steps, all parts of them alike."""
    _, reach, where, _ = _random(seed)
    size = np.maximum(length, 1)[:, None]
    k = np.floor(np.log2(size / reach[None, :]))
    return np.minimum(np.floor(where * reach * 2.0**k).astype(np.int64), size - 1)


def walk(texts: list[str], seed: int = 1) -> np.ndarray:
    """Fingerprint values (one row of SLOTS numbers below 16 for each text). A walk copies the character
    under it at each step and moves on if the shared random bit of (step, character) says so; it has two
    steps for each character. All walks go in step, the longest first."""
    bits, _, _, value = _random(seed)
    n = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), SLOTS), np.uint8)
    order = np.argsort(-n, kind="stable")
    a = 0
    while a < len(order):
        b = a + max(1, int(np.searchsorted(np.cumsum(n[order[a:]]), CHUNK, "right")))
        part = order[a:b]
        a = b
        size = n[part]
        points = np.frombuffer("\0".join([*(texts[i] for i in part), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        code = (points * np.uint32(2654435761) >> np.uint32(24)).astype(np.uint8)
        code[code == 0] = 1
        end = np.cumsum(size + 1) - 1
        code[end] = 0
        at = end - size
        steps = 2 * size
        base = np.cumsum(steps) - steps
        seen = np.zeros(int(steps.sum()) + 1, np.uint8)
        active = np.searchsorted(-steps, -np.arange(int(steps[0]) if len(steps) else 0), "left").tolist()
        rows = [bits[k] for k in range(PERIOD)]
        pos, place = at.copy(), base.copy()
        last = -1
        for step, live in enumerate(active):
            if live != last:
                pos, place, last = pos[:live], place[:live], live
            here = code[pos]
            seen[place] = here
            place += 1
            pos += rows[step % PERIOD][here]
        places = np.where(steps[:, None] > 0, base[:, None] + sampled_places(steps, seed), len(seen) - 1)
        out[part] = value[np.arange(SLOTS)[None, :], seen[places]]
    return out


def to_hex(values: np.ndarray) -> list[str]:
    packed = (values[:, ::2] << 4 | values[:, 1::2]).tobytes().hex()
    return [packed[k * SLOTS : (k + 1) * SLOTS] for k in range(len(values))]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots beyond what chance gives to unrelated values, 0 to 1."""
    same = (a == b).mean(axis=1)
    return np.clip((same - 1 / 16) / (1 - 1 / 16), 0.0, 1.0)


def fingerprint_texts(docs: DataFrame, seed: int = 1) -> DataFrame:
    """Adds ``fingerprint`` (hex) to ``docs``; null text counts as empty. Equal texts have equal
    fingerprints, whatever else is in the table."""
    docs = docs.drop("fingerprint")
    place = docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, place):
                got = to_hex(walk([t or "" for t in part.column(place).to_pylist()], seed))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.string())], [*part.schema.names, "fingerprint"])

    return docs.mapInArrow(task, docs.withColumn("fingerprint", F.lit("")).schema)


def band_plan(n: int, floor: float, miss: float = 1e-4, seed: int = 1) -> np.ndarray:
    """The slots of each band, (band, slot): bands widen with the logarithm of the number ``n`` of texts, so
    that in a band a text meets an unlike one with a chance below an eighth (whose slots agree by an eighth), and their
    number follows from the width, so that a pair whose slots agree as ``floor`` asks is missed with a chance of at
    most ``miss``, however many texts there are. A floor so low that this takes over 65,536 bands is refused."""
    rows = max(5, int(np.ceil(np.log(max(n, 2)) / np.log(8)))) + 1
    agree = (floor + (1 - floor) / 16) ** rows
    bands = 1 if agree >= 1 else int(np.ceil(np.log(miss) / np.log1p(-agree)))
    if bands > 1 << BAND_BITS:
        raise ValueError(f"a floor of {floor} over {n} texts needs {bands} bands")
    rng = np.random.RandomState(seed)
    order = np.concatenate([rng.permutation(SLOTS) for _ in range(-(-bands * rows // SLOTS))])
    return order[: bands * rows].reshape(bands, rows)


def _values(raw: np.ndarray) -> np.ndarray:
    """Slot values of packed fingerprints, a row each."""
    return np.stack([raw >> 4, raw & 15], axis=2).reshape(len(raw), -1)


def band_keys(plan: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The key of each fingerprint in each band: a hash of the slots' values, then the band's number."""
    out = np.repeat(mix(np.arange(1, len(plan) + 1, dtype=np.uint64))[None, :], len(values), axis=0)
    for k in range(plan.shape[1]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + values[:, plan[:, k]].astype(np.uint64))
    return out >> np.uint64(BAND_BITS) << np.uint64(BAND_BITS) | np.arange(len(plan), dtype=np.uint64)


def pairs_of(first: np.ndarray, past: np.ndarray, half: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places within each run [first, past) that meet, in batches of about PAIRS: each two of a run once, or,
    of a run with a second half (after the first), each of one with each of the other."""
    split = np.array([a + int(np.searchsorted(half[a:b], 1)) for a, b in zip(first, past, strict=True)])
    # the row of a place: it meets those after it in its run, from the second half on where there is one
    place = np.concatenate([np.arange(a, m if m < b else b) for a, m, b in zip(first, split, past, strict=True)])
    run = np.searchsorted(first, place, "right") - 1
    begin = np.where(split[run] < past[run], split[run], place + 1)
    size = past[run] - begin
    upto = np.cumsum(size)
    at = 0
    while at < len(place):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        n = size[at:stop]
        ends = np.cumsum(n)
        yield np.repeat(place[at:stop], n), np.arange(ends[-1]) - np.repeat(ends - n - begin[at:stop], n)
        at = stop


def meet(plan: np.ndarray, floor: float):
    """Links of one group of buckets: rows (node, bucket, half, print); a bucket's rows meet among
    themselves, or, where it came in two halves, each of one with each of the other. A pair counts in the first band
    where its slots agree; of links that join the same texts only as many as join them go on."""

    def group(table: pa.Table) -> pa.Table:
        ids, bucket, half = (np.asarray(table.column(c), np.int64) for c in ("node", "bucket", "half"))
        raw = np.frombuffer(b"".join(table.column("print").to_pylist()), np.uint8).reshape(-1, SLOTS // 2)
        order = np.lexsort((ids, half, bucket))
        ids, bucket, half, raw = (x[order] for x in (ids, bucket, half, raw))
        band = bucket & ((1 << BAND_BITS) - 1)
        first = runs(bucket)
        found = [np.empty((2, 0), np.int64)]
        for i, j in pairs_of(first, np.append(first[1:], len(bucket)), half):
            both = raw[i] ^ raw[j]
            same = ((both & 15) == 0).sum(axis=1) + ((both >> 4) == 0).sum(axis=1)
            near = np.maximum(0.0, (same / SLOTS - 1 / 16) / (1 - 1 / 16)) >= floor
            i, j = i[near], j[near]
            if len(i):
                equal = _values(raw[i]) == _values(raw[j])
                good = equal[:, plan].all(axis=2).argmax(axis=1) == band[i]
                found.append(np.stack([ids[i[good]], ids[j[good]]]))
        i, j = np.concatenate(found, axis=1)
        names, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        at = np.concatenate([at, np.concatenate([at[len(i) :], at[: len(i)]])])
        label = joined(names, at[: 2 * len(i)], at[2 * len(i) :])
        moved = label != names
        return pa.table({"a": pa.array(names[moved], pa.int64()), "b": pa.array(label[moved], pa.int64())})

    return group


def similar_prints(prints: DataFrame, floor: float = 0.8, seed: int = 1) -> DataFrame:
    """(doc_id, class_id): the smallest doc_id that links reach, for each doc_id of ``prints`` (doc_id,
    fingerprint). Fingerprints link at a likeness of ``floor`` or more: the Hamming distance of the embeddings'
    samples, which stands for the edit distance of the texts. Rows with a null doc_id have no class; rows that
    share a doc_id are one document with all their fingerprints; an empty table gives no rows.

    Equal fingerprints are one node, so that a hot text is one row. Nodes meet in bands of sampled slots;
    a band's bucket of more than ``MEET`` nodes becomes a group for each pair of its blocks. All nodes
    of a bucket are compared, so that links are lost only where no band agrees (see ``band_plan``)."""
    spark = prints.sparkSession
    rows = prints.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex("fingerprint").alias("print"))
    heads = settle(rows.groupBy("print").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "prints")
    n = heads.count()
    plan = band_plan(n, floor, seed=seed)
    groups = max(64, n * len(plan) // GROUP_ROWS) | 1

    def slot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                keys = band_keys(plan, _values(np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, SLOTS // 2)))
                node = np.repeat(np.asarray(part.column(0), np.int64), len(plan))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(keys.view(np.int64).ravel())], ["node", "bucket"])

    slots = heads.select("node", "print").mapInArrow(slot_rows, "node long, bucket long")
    crowd = slots.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket", F.ceil(F.col("n") / MEET).cast("int").alias("parts"))
    placed = slots.join(crowd, "bucket").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    pooled = F.when(F.col("parts") == 1, F.pmod("bucket", F.lit(groups))).otherwise(F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other")))
    met = placed.select(pooled.alias("group"), "node", "bucket", (F.col("part") > F.col("other")).cast("int").alias("half")).join(heads.select("node", "print"), "node")
    links = met.groupBy("group").applyInArrow(meet(plan, floor), "a long, b long")
    copies = rows.join(heads.filter("n > 1").select("print", "node"), "print").filter("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    parts = components(links.unionByName(copies).distinct()).select(F.col("id").alias("doc_id"), "label")
    return rows.select("doc_id").distinct().join(parts, "doc_id", "left").select("doc_id", F.coalesce("label", "doc_id").alias("class_id"))


def similar_texts(docs: DataFrame, floor: float = 0.8, seed: int = 1) -> DataFrame:
    """(doc_id, class_id) of documents (doc_id, text) by :func:`similar_prints` of their fingerprints."""
    return similar_prints(settle(fingerprint_texts(docs.select("doc_id", "text"), seed).select("doc_id", "fingerprint"), "fingerprints"), floor, seed)


def range_bounds(rows: DataFrame, range_bytes: int = GROUP_BYTES) -> np.ndarray:
    """The first key of each range of ``rows`` (key, text), of about ``range_bytes`` of text each, fewer where cores would
    be left without one. A row is a post with a chance that follows its bytes, drawn by the hash of its key, and about every
    fourth post begins a range: so ranges neither grow with the input nor with long texts. What comes back are
    8 bytes for each post."""
    bytes_ = F.coalesce(F.octet_length("text"), F.lit(0)) + 256  # what a row weighs without a text
    drawn = F.pmod(F.xxhash64("key"), F.lit(2**31)) / 2**31 < bytes_ * 4 / range_bytes
    posts = np.unique(np.asarray(rows.filter(drawn).select("key").toArrow().column(0), np.int64))
    least = rows.agg(F.min("key")).first()[0]
    every = min(4, max(1, len(posts) // rows.sparkSession.sparkContext.defaultParallelism))
    return np.unique(np.append(posts[::every], FIRST if least is None else least))


def half_edits(docs: DataFrame, seed: int = 1) -> DataFrame:
    """For each row of ``docs`` (doc_id, text; null text: empty): its fingerprint, that of its edited text,
    and how alike they are to the fingerprint of the document and of the next document.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next
    document by rising doc_id (ties by text; after the last comes the first; null ids come first). Rows
    are dealt into ranges of doc_id (see ``range_bounds``); the first document of a range is also sent to
    the range before, so that every document meets its successor without a global sort in one task. Texts are
    shuffled once, each compressed by itself. Rows of one doc_id are one range.
    """
    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(FIRST)).alias("key"), "doc_id", "text")
    bounds = range_bounds(rows)
    last = len(bounds) - 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.asarray(batch.column(0), np.int64)
            block = np.searchsorted(bounds, key, "right") - 1
            first = np.flatnonzero(bounds[block] == key)  # these are also guests of the range before
            before = np.where(block[first] == 0, last, block[first] - 1)
            for rows, to, guest in ((batch, block, 0), (batch.take(pa.array(first)), before, 1)):
                if rows.num_rows:
                    texts = [(t or "").encode("utf-8") for t in rows.column(2).to_pylist()]
                    packed = pa.array([pa.compress(t, codec="zstd", asbytes=True) for t in texts], pa.binary())
                    size = pa.array([len(t) for t in texts], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(np.full(rows.num_rows, guest), pa.int32()), *rows.columns[:2], size, packed], ["block", "guest", "key", "doc_id", "size", "packed"])

    def group(table: pa.Table) -> pa.Table:
        sized = zip(table.column("packed").to_pylist(), table.column("size").to_pylist(), strict=True)
        whole = pa.array([pa.decompress(t, n, codec="zstd", asbytes=True).decode("utf-8") for t, n in sized], pa.string())
        table = table.drop_columns(["packed", "size"]).append_column("text", whole).sort_by([("guest", "ascending"), ("key", "ascending"), ("text", "ascending")])
        own = table.num_rows - sum(table.column("guest").to_pylist())
        texts = table.column("text").to_pylist()[: own + 1]
        if own == 0:
            texts = []
        edited = [t[: len(t) - len(t) // 2] + nxt[: len(t) // 2] for t, nxt in zip(texts[:-1], texts[1:], strict=True)]
        got = walk(texts + edited, seed)
        plain, changed = got[: len(texts)], got[len(texts) :]
        return pa.table({
            "doc_id": table.column("doc_id").slice(0, own).cast(pa.int64()), "n_chars": pa.array([len(t) for t in texts[:own]], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in edited], pa.string()),
            "fingerprint": pa.array(to_hex(plain[:own]), pa.string()), "edited_fingerprint": pa.array(to_hex(changed), pa.string()),
            "near_edited": pa.array(likeness(plain[:own], changed), pa.float64()), "near_next": pa.array(likeness(plain[:own], plain[1:]), pa.float64()),
        })

    met = dealt(rows.mapInArrow(deal, "block long, guest int, key long, doc_id long, size long, packed binary"), len(bounds), "block")
    return met.groupBy("block").applyInArrow(group, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
