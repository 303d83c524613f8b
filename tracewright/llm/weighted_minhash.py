"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by
weighted Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import buffers, components, dealt, fresh, hash_spans, mix, n_groups, pack, runs, settle, slices, spread, touched, trim, unpack, windows, word_spans

BANDS, ROWS = 16, 4
FLUSH = 1_000_000  # shingles that a task holds before it passes them on
CROWD = 16  # documents that have a shingle, beyond which it counts as a crowd's
CHUNK = 256  # documents of one bucket that meet at a time
POSTS = pa.schema([("target", pa.int64()), ("docs", pa.binary()), ("keys", pa.binary()), ("tf", pa.binary()), ("df", pa.binary())])
POST_TYPE = "target long, docs binary, keys binary, tf binary, df binary"
FEATURES = "doc_id long, private double, keys binary, weights binary, bands array<long>, lone double, counts binary"
GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document) of every shingle of ``size`` lower-cased words, and two digests of each document's
    words. A document of fewer words has one shingle of all; one without words has none."""
    data, offsets = buffers(text)
    starts, ends, doc = word_spans(data, offsets)
    words = hash_spans(data, starts, ends, lower=True)
    n = np.bincount(doc, minlength=len(text))
    first = np.cumsum(n) - n
    placed = mix(words + mix((np.arange(len(words)) - first[doc]).astype(np.uint64)))
    digests = np.zeros((2, len(text)), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        digests[0, full] = mix(np.add.reduceat(placed, first[full]) + n[full].astype(np.uint64))
        digests[1, full] = mix(np.add.reduceat(mix(placed ^ GOLD), first[full]) + n[full].astype(np.uint64))
    h, at = windows(words, doc, size)
    short = np.flatnonzero((n > 0) & (n < size))
    h, d = np.concatenate([h, digests[0, short]]), np.concatenate([doc[at], short])
    return h, d, digests[0], digests[1]


def digest_rows(size: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                _, d, one, two = shingles(part.column(1), size)
                n = np.bincount(d, minlength=part.num_rows)
                own = apart(np.asarray(part.column(0), np.int64), one, two)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x.view(np.int64)) for x in (one, two)), pa.array(n, pa.int64()), pa.array(own)], ["doc_id", "d1", "d2", "n", "own"])

    return task


def apart(ids: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Numbers for rows whose doc_id stands for several texts: negative hashes of id and text."""
    return (mix(ids.view(np.uint64) ^ mix(one + mix(two))) | np.uint64(1 << 63)).view(np.int64)


def postings(size: int, buckets: int):
    """Packed (shingle, document, term frequency, number of copies) by range of hash. Copies that a task
    holds at once are one document, the smallest, with their number."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        known: dict[tuple[int, int], int] = {}
        heads: list[int] = []
        copies: list[int] = []

        def flush() -> pa.RecordBatch:
            h, d = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]))
            tf = np.diff(np.append(new, len(h))).astype(np.uint32)
            h, d = h[new], d[new]
            docs, many = np.array(heads, np.int64)[d], np.array(copies, np.uint32)[d]
            held.clear(), known.clear(), heads.clear(), copies.clear()
            return pa.RecordBatch.from_pylist([{"target": k, "docs": pack(docs[a:b]), "keys": pack(h[a:b]), "tf": pack(tf[a:b]), "df": pack(many[a:b])} for k, a, b in touched(h, buckets)], POSTS)

        for batch in batches:
            for part in slices(batch, 1):
                h, d, one, two = shingles(part.column(1), size)
                ids, several = np.asarray(part.column(0), np.int64), np.asarray(part.column(2).cast(pa.int8())) > 0
                ids = np.where(several, apart(ids, one, two), ids).tolist()
                place = np.full(part.num_rows, -1, np.int64)
                for i, same in enumerate(zip(one.tolist(), two.tolist(), strict=True)):
                    if same == (0, 0):
                        continue
                    at = known.setdefault(same, len(heads))
                    if at == len(heads):
                        heads.append(ids[i])
                        copies.append(0)
                        place[i] = at
                    heads[at] = min(heads[at], ids[i])
                    copies[at] += 1
                keep = place[d] >= 0
                held.append((h[keep], place[d[keep]]))
                if sum(len(x) for x, _ in held) >= FLUSH:
                    yield flush()
        if held:
            yield flush()
        trim()

    return task


def count(blocks: int):
    """Document frequencies of one range of hashes. Answers, packed by document, only for shingles of two
    or more documents: the others can't be shared."""

    def group(rows: pa.Table) -> pa.Table:
        column = lambda name, kind: np.concatenate([unpack(x, kind) for x in rows.column(name).to_pylist()])
        h = column("keys", np.uint64)
        order = np.argsort(h)
        h = h[order]
        first = runs(h)
        n = np.diff(np.append(first, len(h)))
        df = np.add.reduceat(column("df", np.uint32)[order].astype(np.int64), first)
        shared = np.repeat(n > 1, n)
        if not shared.any():
            return pa.Table.from_pylist([], POSTS)
        docs, tf = column("docs", np.int64)[order][shared], column("tf", np.uint32)[order][shared]
        h, df = h[shared], np.repeat(df, n)[shared].astype(np.uint32)
        block = np.mod(docs, blocks)
        order = np.lexsort((docs, block))
        h, df, docs, tf, block = h[order], df[order], docs[order], tf[order], block[order]
        first = runs(block)
        out = [{"target": int(block[a]), "docs": pack(docs[a:b]), "keys": pack(h[a:b]), "tf": pack(tf[a:b]), "df": pack(df[a:b])} for a, b in zip(first, np.append(first[1:], len(block)), strict=True)]
        table = pa.Table.from_pylist(out, POSTS)
        trim()
        return table

    return group


def uniform(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers in (0, 1) from each 64-bit hash."""
    return ((x >> np.uint64(32)).astype(np.float64) + 0.5) / 2.0**32, ((x & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5) / 2.0**32


def icws(keys: np.ndarray, weights: np.ndarray, first: np.ndarray, samples: int) -> np.ndarray:
    """Improved consistent weighted samples (one row for each set; sets begin at ``first``). Two sets agree
    in a sample with a chance equal to their weighted Jaccard similarity."""
    out = np.empty((len(first), samples), np.uint64)
    log_w = np.log(weights)
    which = spread(first, len(keys))
    for s in range(samples):
        salt = mix(np.array([3 * s + 1, 3 * s + 2, 3 * s + 3], np.uint64) * GOLD)
        u1, u2 = uniform(mix(keys ^ salt[0]))
        u3, u4 = uniform(mix(keys ^ salt[1]))
        beta, _ = uniform(mix(keys ^ salt[2]))
        r, c = -np.log(u1 * u2), -np.log(u3 * u4)
        t = np.floor(log_w / r + beta)
        a = np.log(c) - r * (t - beta + 1.0)
        low = np.minimum.reduceat(a, first)
        at = np.flatnonzero(a == low[which])
        at = at[runs(which[at])]
        out[:, s] = mix(keys[at] + mix(t[at].astype(np.int64).view(np.uint64)))
    return out


def banded(keys: np.ndarray, weights: np.ndarray, first: np.ndarray, number: int) -> np.ndarray:
    """Band keys of each set, for bands counted on from ``number``."""
    sample = icws(keys, weights, first, BANDS * ROWS).reshape(len(first), BANDS, ROWS)
    band = np.zeros((len(first), BANDS), np.uint64)
    for k in range(ROWS):
        band = mix(band * GOLD + sample[:, :, k] + np.arange(number + 1, number + BANDS + 1, dtype=np.uint64))
    return band


def idf(df: np.ndarray, total: int) -> np.ndarray:
    return np.log((1.0 + total) / (1.0 + df)) + 1.0


def features(total: int):
    """For each text class of a block: weights of its shared shingles, the weight of all others together,
    and its band keys; of a crowd's also the counts of both, and as many bands of these. Shingles that no other class has can't be the common sample of two classes, and
    the smallest value over them is distributed as that of one element with their summed weight."""

    def group(meta: pa.Table, rows: pa.Table) -> pa.Table:
        heads = np.asarray(meta.column("doc_id"), np.int64)
        order = np.argsort(heads)
        heads = heads[order]
        n, many = (np.asarray(meta.column(c), np.int64)[order] for c in ("n", "copies"))
        empty = pa.table({"doc_id": pa.array([], pa.int64()), "private": pa.array([], pa.float64()), "keys": pa.array([], pa.binary()), "weights": pa.array([], pa.binary()), "bands": pa.array([], pa.list_(pa.int64())), "lone": pa.array([], pa.float64()), "counts": pa.array([], pa.binary())})
        if not rows.num_rows or not len(heads):
            return empty
        column = lambda name, kind: np.concatenate([unpack(x, kind) for x in rows.column(name).to_pylist()])
        docs = column("docs", np.int64)
        at = np.minimum(np.searchsorted(heads, docs), len(heads) - 1)
        keep = heads[at] == docs
        at, keys = at[keep], column("keys", np.uint64)[keep]
        tf, df = column("tf", np.uint32)[keep].astype(np.float64), column("df", np.uint32)[keep].astype(np.float64)
        if not len(at):
            return empty
        order = np.lexsort((keys, at))
        at, keys, tf, df, weights = at[order], keys[order], tf[order], df[order], (tf * idf(df, total))[order]
        first = runs(at)
        mine = at[first]
        lone = np.maximum(n[mine] - np.add.reduceat(tf, first), 0.0)
        private = lone * idf(many[mine].astype(np.float64), total)
        own = np.flatnonzero(private > 0)
        # the private element stands at the end of its document
        end = np.append(first[1:], len(at))[own]
        all_keys = np.insert(keys, end, mix(heads[mine[own]].view(np.uint64) ^ np.uint64(0xA24BAED4963EE407)))
        all_weights = np.insert(weights, end, private[own])
        begin = first + np.searchsorted(own, np.arange(len(first)))
        band = banded(all_keys, all_weights, begin, 0)
        crowd = 2 * np.add.reduceat(np.where(df > CROWD, tf, 0.0), first) >= n[mine]
        bands, counts = list(band), [b""] * len(first)
        if crowd.any():
            size = np.diff(np.append(begin, len(all_keys)))
            inside = np.repeat(crowd, size)
            more = banded(all_keys[inside], np.insert(tf, end, lone[own])[inside], np.cumsum(size[crowd]) - size[crowd], BANDS)
            for k, b in zip(np.flatnonzero(crowd), more, strict=True):
                bands[k] = np.concatenate([bands[k], b])
                counts[k] = tf[first[k] : first[k + 1] if k + 1 < len(first) else len(at)].astype(np.uint32).tobytes()
        held = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
        stop = np.append(first[1:], len(at))
        trim()
        return pa.table({
            "doc_id": pa.array(heads[mine], pa.int64()), "private": pa.array(private, pa.float64()),
            "keys": pa.array([keys[a:b].tobytes() for a, b in zip(first, stop, strict=True)], pa.binary()), "weights": pa.array([weights[a:b].tobytes() for a, b in zip(first, stop, strict=True)], pa.binary()),
            "bands": pa.ListArray.from_arrays(pa.array(held), pa.array(np.concatenate(bands).view(np.int64))), "lone": pa.array(lone, pa.float64()), "counts": pa.array(counts, pa.binary()),
        })

    return group


class Feature(NamedTuple):
    """A text: its sorted shared shingles, their weights, the weight of the rest; of a crowd's both as counts."""

    keys: np.ndarray
    weights: np.ndarray
    private: float
    counts: np.ndarray
    lone: float


SIDE = ("keys", "weights", "private", "counts", "lone")


def features_of(rows: pa.Table | pa.RecordBatch, names: tuple[str, ...] = SIDE) -> list[Feature]:
    col = [rows.column(n).to_pylist() if n in rows.schema.names else None for n in names]
    weights = [np.frombuffer(w, np.float64) for w in col[1]]
    counts = [np.frombuffer(c, np.uint32) for c in col[3] or [b""] * len(weights)]
    return [Feature(np.frombuffer(k, np.uint64), w, p, c, o) for k, w, p, c, o in zip(col[0], weights, col[2], counts, col[4] or col[2], strict=True)]


def alike(a: Feature, b: Feature, floor: float) -> bool:
    """Whether the weighted Jaccard similarity of two texts, or that by counts of two of a crowd, reaches ``floor``."""
    spot = np.minimum(np.searchsorted(a.keys, b.keys), len(a.keys) - 1)
    both = a.keys[spot] == b.keys
    spot = spot[both]
    ways = [(a.weights, b.weights, a.private + b.private)]
    if len(a.counts) and len(b.counts):
        ways.append((a.counts, b.counts, a.lone + b.lone))
    for x, y, rest in ways:
        least = float(np.minimum(x[spot], y[both]).sum())
        whole = float(x.sum()) + float(y.sum()) + rest - least
        if whole > 0 and least / whole >= floor:
            return True
    return False


def confirm(pairs: DataFrame, feats: DataFrame, floor: float) -> DataFrame:
    """The (doc_id, leader) of ``pairs`` that are ``alike``."""
    led = tuple(f"l_{c}" for c in SIDE)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [alike(a, b, floor) for a, b in zip(features_of(batch), features_of(batch, led), strict=True)]
            trim()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["doc_id", "leader"]).filter(pa.array(good, pa.bool_()))

    side = feats.select("doc_id", *SIDE)
    lead = side.select(*[F.col(c).alias("leader" if c == "doc_id" else f"l_{c}") for c in side.columns])
    both = pairs.join(side, "doc_id").join(lead, "leader")
    return both.select("doc_id", "leader", *SIDE, *led).mapInArrow(task, "doc_id long, leader long")


def rest_links(floor: float):
    """Links among documents of one group of buckets: each of ``half`` 0 against all of ``half`` 1 of another
    component, each pair in its first common band, pairs already joined left out; returns links that join.
    A ``part`` other than 0 marks a document of ``half`` 1 that asks itself: such a pair meets once."""

    def group(table: pa.Table) -> pa.Table:
        ids, part, mine = (np.asarray(table.column(c), np.int64) for c in ("doc_id", "part", "component"))
        bucket, half, band = (np.asarray(table.column(c), np.int64) for c in ("bucket", "half", "band"))
        lists = table.column("bands").combine_chunks()
        long = np.asarray(lists.value_lengths(), np.int64)
        have = np.arange(long.max(initial=0)) < long[:, None]
        bands = np.zeros(have.shape, np.int64)
        bands[have] = np.asarray(lists.flatten(), np.int64)
        feats = features_of(table)
        crowd = np.array([len(f.counts) > 0 for f in feats])
        by = lambda own, rest: (own, own + np.array(rest))
        weight = by(np.array([f.weights.sum() for f in feats]), [f.private for f in feats])
        number = by(np.array([float(f.counts.sum()) for f in feats]), [f.lone for f in feats])
        order = np.argsort(bucket, kind="stable")
        first = runs(bucket[order])
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        found: list[tuple[int, int]] = []
        for a, b in zip(first, np.append(first[1:], len(order)), strict=True):
            at = order[a:b]
            asks, others = at[half[at] == 0], at[half[at] == 1]
            for i in asks:
                same = (bands[others] == bands[i]) & have[others] & have[i]
                near = others[(same.argmax(axis=1) == band[i]) & (mine[others] != mine[i]) & (ids[others] != ids[i]) & ((part[others] == 0) | (ids[others] > ids[i]))]
                # what the two weigh together bounds how much of it they can share
                able = []
                for shared, whole in (weight, number):
                    most = np.minimum(shared[near], shared[i])
                    able.append(most >= (floor - 1e-9) * (whole[near] + whole[i] - most))
                near = near[able[0] | (able[1] & crowd[near] & crowd[i])]
                for j in near:
                    x, y = find(int(mine[i])), find(int(mine[j]))
                    if x != y and alike(feats[i], feats[j], floor):
                        root[max(x, y)] = min(x, y)
                        found.append((int(ids[i]), int(ids[j])))
        return pa.table({"doc_id": pa.array([x for x, _ in found], pa.int64()), "leader": pa.array([y for _, y in found], pa.int64())})

    return group


def near_duplicates(docs: DataFrame, size: int = 5, floor: float = 0.8) -> DataFrame:
    """Adds ``component_id, kept`` to ``docs`` (doc_id, text, others kept).

    Two texts link when the weighted Jaccard similarity of their shingles of ``size`` lower-cased words is
    at least ``floor``; a shingle weighs its count in the text times log((1 + documents) / (1 + documents
    that have it)) + 1, counted over all documents. Texts of a crowd, half of whose shingles are in more than
    ``CROWD`` documents each, also link when their similarity by counts alone reaches the floor: what a large group of copies
    shares is frequent, and so light beside what few have, the more so the larger the table. ``component_id`` is the smallest doc_id that links
    reach, ``kept`` whether it is the row's own. Texts of fewer words are one shingle; null and empty
    texts link with nothing, and rows with a null doc_id are kept without a component. Rows that share a
    doc_id are one document with all their texts: each text links by itself, and they stay or go together.
    Columns of ``docs`` named like the added ones are replaced; empty tables give no rows.

    Equal texts are one class from the start: a task joins the copies it holds before it passes anything
    on, and digests join the others. Document frequencies are counted by ranges of shingle hashes; answers
    come only for shingles that several documents have. Classes sample 64 elements and meet in 16 bands of
    4, where a pair at the floor is missed with a chance below 0.001; those of a crowd in 16 more, by counts. Each band's bucket compares its documents with its smallest, twice over;
    then each document outside its bucket's largest component is compared with all others of another
    component in blocks, each pair in its first common band, so that large buckets of one family cost one
    comparison a document, all others are settled exactly and no group is held whole.
    """
    spark = docs.sparkSession
    docs = docs.select(*[c for c in docs.columns if c not in ("component_id", "kept")])
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    buckets = n_groups(spark, docs)
    blocks = 3 * buckets
    rows = settle(known.mapInArrow(digest_rows(size), "doc_id long, d1 long, d2 long, n long, own long").filter("n > 0"), "digests")
    total = rows.count()
    # ids that stand for several texts: their rows get numbers of their own, and a link between them
    several = rows.groupBy("doc_id").agg(F.min(F.struct("d1", "d2")).alias("a"), F.max(F.struct("d1", "d2")).alias("z")).filter("a <> z").select(F.col("doc_id").alias("several_id"))
    several = settle(several, "several")
    shared_ids = several.limit(1).count() > 0
    if shared_ids:
        known = known.join(several, known.doc_id == several.several_id, "left").select("doc_id", "text", F.col("several_id").isNotNull().alias("several"))
        rows = rows.join(several, rows.doc_id == several.several_id, "left").withColumn("row_id", F.when(F.col("several_id").isNotNull(), F.col("own")).otherwise(F.col("doc_id")))
    else:
        known, rows = known.withColumn("several", F.lit(False)), rows.withColumn("row_id", F.col("doc_id"))
    classes = rows.groupBy("d1", "d2").agg(F.min("row_id").alias("doc_id"), F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.max("n").alias("n"))
    target = F.pmod("doc_id", F.lit(blocks)).cast("long")
    answers = dealt(known.select("doc_id", "text", "several").mapInArrow(postings(size, buckets), POST_TYPE), buckets).groupBy("target").applyInArrow(count(blocks), POST_TYPE)
    meta = dealt(classes.select(target.alias("target"), "doc_id", "n", "copies"), buckets).groupBy("target")
    feats = settle(meta.cogroup(dealt(answers, buckets).groupBy("target")).applyInArrow(features(total), FEATURES), "features")

    slots = feats.select("doc_id", F.posexplode("bands").alias("band", "bucket"))
    crowd = slots.groupBy("bucket").agg(F.count("*").alias("crowd"), F.min("doc_id").alias("leader")).filter("crowd > 1")
    slots = settle(slots.join(crowd, "bucket"), "slots")
    links = settle(confirm(slots.filter("doc_id <> leader").select("doc_id", "leader").distinct(), feats, floor), "links")
    # a second leader: the smallest of those that the first didn't confirm
    linked = links.withColumn("linked", F.lit(True))
    open_ = slots.join(linked, ["doc_id", "leader"], "left").filter("linked is null and doc_id <> leader").select("bucket", "band", "doc_id", F.col("leader").alias("first"))
    second = open_.groupBy("bucket").agg(F.min("doc_id").alias("leader"))
    pairs = slots.select("bucket", "doc_id", F.col("leader").alias("first")).join(second, "bucket").filter("doc_id <> leader and doc_id <> first")
    more = settle(confirm(pairs.select("doc_id", "leader").distinct(), feats, floor), "links")
    joined = components(links.unionByName(more), "doc_id", "leader")

    # what is left: each outside its bucket's largest component against all others of another, in blocks
    member = slots.select("bucket", "band", "doc_id", "crowd").join(joined.withColumnRenamed("id", "doc_id").withColumnRenamed("label", "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    member = settle(member, "members")
    parts_of = member.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    split = parts_of.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.count("*").alias("components"), F.sum("n").alias("crowd"), F.max("n").alias("most")).filter("components > 1")
    split = split.select("bucket", "largest", F.ceil((F.col("crowd") - F.col("most")) / CHUNK).cast("int").alias("ask_parts"), F.ceil(F.col("crowd") / CHUNK).cast("int").alias("parts"))
    others = member.drop("crowd").join(split, "bucket").withColumn("outside", (F.col("component") != F.col("largest")).cast("long"))
    cols = ["bucket", "band", "doc_id", "component", "outside", "parts", "ask_parts"]
    sent = others.filter("outside = 1").withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("ask_parts")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).select(*cols, "mine", "other", F.lit(0).alias("half"))
    seen = others.withColumn("other", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).withColumn("mine", F.explode(F.expr("sequence(0, ask_parts - 1)"))).select(*cols, "mine", "other", F.lit(1).alias("half"))
    small = F.pmod("bucket", F.lit(buckets)).cast("string")
    group = F.when((F.col("parts") == 1) & (F.col("ask_parts") == 1), small).otherwise(F.concat_ws("|", "bucket", "mine", "other"))
    met = sent.unionByName(seen).withColumn("group", group).join(feats, "doc_id")
    met = met.select("group", "bucket", "band", "doc_id", "half", F.col("outside").alias("part"), "component", *SIDE, "bands")
    rest = settle(met.groupBy("group").applyInArrow(rest_links(floor), "doc_id long, leader long"), "rest")

    all_links = links.unionByName(more).unionByName(rest)
    if shared_ids:
        heads = rows.filter("several_id is not null").select("doc_id", "d1", "d2").join(classes.select("d1", "d2", F.col("doc_id").alias("head")), ["d1", "d2"]).select("doc_id", "head").distinct()
        one = heads.groupBy("doc_id").agg(F.min("head").alias("leader"))
        all_links = all_links.unionByName(heads.join(one, "doc_id").filter("head <> leader").select(F.col("head").alias("doc_id"), "leader"))
    parts = components(all_links.distinct(), "doc_id", "leader").select(F.col("id").alias("head"), "label")
    of_class = classes.select("d1", "d2", "least", F.col("doc_id").alias("head")).join(parts, "head", "left").select("d1", "d2", "least", F.coalesce("label", "head").alias("component_id"))
    if shared_ids:  # labels may be numbers of rows: the smallest doc_id of each stands for it
        least = of_class.groupBy("component_id").agg(F.min("least").alias("named"))
        of_class = of_class.join(least, "component_id").select("d1", "d2", F.col("named").alias("component_id"))
    (found_id,) = fresh(docs, "found_id")
    of_doc = rows.select("doc_id", "d1", "d2").join(of_class.select("d1", "d2", "component_id"), ["d1", "d2"]).groupBy("doc_id").agg(F.min("component_id").alias("component_id")).select(F.col("doc_id").alias(found_id), "component_id")
    out = docs.join(of_doc, docs["doc_id"] == of_doc[found_id], "left").drop(found_id)
    out = out.withColumn("component_id", F.coalesce("component_id", F.col("doc_id").cast("long")))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
