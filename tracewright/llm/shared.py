"""What several operators of this subpackage share: the shared folder, word hashes over Arrow text
buffers, packed hash columns that Spark shuffles, and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
PIECE = 1 << 20  # bytes hashed at a time
WORD = r"[^\x20\x09-\x0D]+"


# ---------------------------------------------------------------- shared folder
def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the cluster's ``spark.checkpoint.dir``. Where that is unset, a temporary folder
    serves on one machine (a local master, as in tests); on a cluster, whose executors don't share such a
    folder, this refuses to go on."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(root)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_path(path: str) -> str | None:
    """The mounted path of a ``file:`` URI or plain path, else None."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if path.startswith("/") else None


def put_file(path: str, data: bytes) -> None:
    """Writes one file of the shared folder in one step, so that a repeated task replaces it whole."""
    local = local_path(path)
    if local:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        part = f"{local}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, local)
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(inner), recursive=True)
    with store.open_output_stream(inner) as f:
        f.write(data)


@functools.lru_cache(maxsize=4096)
def mapped(path: str, dtype: str) -> np.ndarray:
    """A file of the shared folder as a memory-mapped array. Stores that cannot be mapped are copied
    once per worker to its temporary folder and unlinked at once (the mapping stays valid)."""
    local = local_path(path)
    if local:
        return np.memmap(local, dtype=dtype, mode="r") if os.path.getsize(local) else np.empty(0, dtype)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_stream(inner) as f, tempfile.NamedTemporaryFile() as t:
        while block := f.read(1 << 24):
            t.write(block)
        t.flush()
        return np.memmap(t.name, dtype=dtype, mode="r") if t.tell() else np.empty(0, dtype)


def get_file(path: str) -> bytes:
    """The content of a file of the shared folder."""
    local = local_path(path)
    if local:
        with open(local, "rb") as f:
            return f.read()
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_stream(inner) as f:
        return f.read()


def discard(df: DataFrame) -> None:
    """Removes the files of a settled table that nothing will read again."""
    jvm = df.sparkSession.sparkContext._jvm
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


GROUP_BYTES = 8 << 20  # text that stands behind one range of hashes of a packed shuffle; blocks of texts are a third of that


def n_buckets(spark: SparkSession, per: int = 4) -> int:
    """Groups for rows that are few beside the input: ``per`` for each shuffle partition. Odd, to suit
    ``pmod`` of ids."""
    return max(64, per * int(spark.conf.get("spark.sql.shuffle.partitions"))) | 1


def n_groups(spark: SparkSession, texts: DataFrame, group_bytes: int = GROUP_BYTES) -> int:
    """Groups of a packed shuffle: one for each ``group_bytes`` of the column ``text``, at least one for
    each core, so that what a group or a task holds doesn't grow with the input. One scan of the text
    column. Odd, to suit ``pmod`` of ids."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(spark.sparkContext.defaultParallelism, -(-total // group_bytes)) | 1


def dealt(df: DataFrame, groups: int, key: str = "target") -> DataFrame:
    """``df`` in as many partitions as it has groups; grouping by ``key`` then needs no other shuffle."""
    return df.repartition(groups, key)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, upper and lower case alike."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


# ---------------------------------------------------------------- hashing
def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15 | 1
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[U64(1)], np.full(PIECE, U64(base))]).astype(U64))
        down = np.cumprod(np.concatenate([[U64(1)], np.full(PIECE, U64(pow(base, -1, 1 << 64)))]).astype(U64))
    return up, down, mix(np.arange(1, 257, dtype=U64))


_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document index) of every word: a run of bytes other than ASCII white space."""
    if not len(data):
        return (np.empty(0, np.int64),) * 3
    w = _IS_WORD[data]
    before, after = np.empty_like(w), np.empty_like(w)
    before[0], before[1:] = False, w[:-1]
    after[-1], after[:-1] = False, w[1:]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[begins] = False
    after[begins[1:] - 1] = False
    starts, ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each span of bytes: differences of a running polynomial, over pieces of bytes.
    Spans must be in order and must not overlap."""
    up, down, salt = _tables()
    out = np.empty(len(starts), U64)
    lut = salt[_LOWER] if lower else salt
    k = 0
    while k < len(starts):
        base = int(starts[k])
        stop = max(k + 1, int(np.searchsorted(ends, base + PIECE, "right")))
        s, e = starts[k:stop] - base, ends[k:stop] - base
        if e[-1] > PIECE:  # one span longer than a piece
            total = U64(0)
            for at in range(0, int(e[-1]), PIECE):
                block = lut[data[base + at : base + min(at + PIECE, int(e[-1]))]]
                total = mix(np.array([total + (block * up[: len(block)]).sum(dtype=U64)], U64))[0]
            out[k] = total
        else:
            run = np.zeros(int(e[-1]) + 1, U64)
            np.cumsum(lut[data[base : base + int(e[-1])]] * up[: int(e[-1])], out=run[1:])
            out[k:stop] = (run[e] - run[s]) * down[s]
        k = stop
    return mix(out ^ (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def windows(words: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of every ``size`` consecutive words of one document: (hash, index of the
    window's first word)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, U64), np.empty(0, np.int64)
    h = np.zeros(n, U64)
    for k in range(size):
        h *= U64(0xD1342543DE82EF95)
        h += words[k : k + n]
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return mix(h[at]), at


# ---------------------------------------------------------------- packed columns
def pack(a: np.ndarray) -> bytes:
    """An array as bytes, all highest bytes first: sorted or small numbers then compress well."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()


def unpack(raw: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def range_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Which of ``buckets`` (below 2^32) equal ranges of 64-bit hashes each key lies in: the upper half of the product."""
    n, half = U64(buckets), U64(32)
    return (((keys >> half) * n + ((keys & U64(0xFFFFFFFF)) * n >> half)) >> half).astype(np.int64)


def touched(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(range, first, past) of each range that sorted ``keys`` touch; the work follows the keys, not ``buckets``."""
    own = range_of(keys, buckets)
    first = runs(own)
    return zip(own[first].tolist(), first.tolist(), np.append(first, len(own))[1:].tolist(), strict=True)


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """First index of each run of equal keys."""
    if not len(sorted_keys):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))


def spread(starts: np.ndarray, total: int) -> np.ndarray:
    """For each element the number of its run."""
    return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, total)))


STEP = 2 << 20  # bytes of text that a task handles at a time


def trim() -> None:
    """Gives freed memory back, so that Python workers that wait don't hold what a task needed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, column: int, step: int = STEP) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``step`` bytes in one text column (one row at least)."""
    _, offsets = buffers(batch.column(column))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + step, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b
    trim()


# ---------------------------------------------------------------- components
def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, label): for each node of ``edges`` the smallest node that links reach. Minimum labels with
    pointer jumping, each round written to the shared folder; rounds grow with the logarithm of the
    longest path. No edges give no rows."""
    both = settle(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct(), "edges")
    labels = settle(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both.v == labels.id).groupBy("u").agg(F.min("label").alias("m"))
        step = labels.join(near, labels.id == near.u).select("id", F.least("label", "m").alias("label"), F.col("label").alias("was"))
        hop = labels.select(F.col("id").alias("hid"), F.col("label").alias("hop"))
        step = step.join(hop, step.label == hop.hid).select("id", F.least("label", "hop").alias("label"), "was")
        step = settle(step, "labels")
        discard(labels)
        if not step.filter("label <> was").limit(1).count():
            discard(both)
            return step.select("id", "label")
        labels = step.select("id", "label")
