"""The document index as a log of snapshots: each commit adds files and then one manifest, which names all
that readers may see, the channels' checkpoint included."""

from __future__ import annotations

import json
import time
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sync import reconcile
from ..schemas import CHECKPOINT, DOCUMENTS, columns

MANIFESTS, DATA = "manifests", "data"
DELTA = f"{DOCUMENTS}, seq long, gone boolean"
NAMES = [name for name, _ in columns(DOCUMENTS)]
EMPTY: dict[str, Any] = {"version": 0, "base": None, "bits": 0, "digests": None, "deltas": [], "checkpoint": None, "batches": {}}
PART_ROWS = 100_000  # documents of a part of the base, about
DIGESTS = "part int, n long, digest long"


class CommitConflict(Exception):
    """Another writer has committed since the snapshot was read; read it again and repeat."""


class NoIndex(Exception):
    """The folder holds files of another kind."""


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _children(spark: SparkSession, path: str) -> list:
    """Status of each file below a folder; none where it is missing."""
    at, fs = _files(spark, path)
    return list(fs.listStatus(at)) if fs.exists(at) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    names = [f.getPath().getName() for f in _children(spark, f"{path}/{MANIFESTS}")]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json"))


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> dict[str, Any]:
    """The manifest of a version, the last by default; that of an empty index where nothing was committed. A folder
    of something else is refused."""
    known = versions(spark, path)
    if not known:
        other = {f.getPath().getName() for f in _children(spark, path)} - {MANIFESTS, DATA}
        if other:
            raise NoIndex(f"{path} holds {sorted(other)[0]} and no manifest")
        return dict(EMPTY)
    at, fs = _files(spark, f"{path}/{MANIFESTS}/{known[-1] if version is None else version:012d}.json")
    stream = fs.open(at)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, manifest: dict[str, Any]) -> None:
    """Writes a manifest beside its place and renames it there: readers see all of it or nothing, and of two
    writers of one version the second fails."""
    jvm = spark.sparkContext._jvm
    part, fs = _files(spark, f"{path}/{MANIFESTS}/.{uuid.uuid4().hex}")
    stream = fs.create(part)
    stream.write(json.dumps(manifest).encode())
    stream.close()
    to, _ = _files(spark, f"{path}/{MANIFESTS}/{manifest['version']:012d}.json")
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri() if part.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(part), fs.makeQualified(to), none)
    except Py4JJavaError as e:
        fs.delete(part, False)
        if "FileAlreadyExists" in e.java_exception.toString():
            raise CommitConflict(f"version {manifest['version']} of {path} exists") from None
        raise


def _put(df: DataFrame, path: str) -> str:
    """A new folder of the index with ``df``, in as many files as its size asks for."""
    name = uuid.uuid4().hex
    df.hint("rebalance").write.parquet(f"{path}/{DATA}/{name}")
    return name


def part_of(bits: int) -> Column:
    """The part of the base that an id belongs to, of 2 ** bits."""
    return F.xxhash64("doc_id").bitwiseAND((1 << bits) - 1).cast("int")


def digests(docs: DataFrame, bits: int) -> DataFrame:
    """(part, n, digest) of documents (doc_id, content_hash): rows with the same ids and hashes have the same."""
    return docs.groupBy(part_of(bits).alias("part")).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id", F.lit("|"), "content_hash")).alias("digest"))


def read_index(spark: SparkSession, path: str, version: int | None = None, parts: list[int] | None = None) -> DataFrame:
    """The documents of a snapshot: of each id its newest row among the deltas, unless that removes it, else the
    base's. Only ids of deltas are looked up; the base isn't shuffled where these are few. ``parts``: of the base's
    folders only these are read."""
    m = snapshot(spark, path, version)
    at = lambda name: f"{path}/{DATA}/{name}"
    base = spark.read.schema(f"{DOCUMENTS}, part int").parquet(at(m["base"])) if m["base"] else spark.createDataFrame([], f"{DOCUMENTS}, part int")
    base = (base if parts is None else base.filter(F.col("part").isin(parts))).select(*NAMES)
    if not m["deltas"]:
        return base
    deltas = spark.read.schema(DELTA).parquet(*map(at, m["deltas"]))
    deltas = deltas if parts is None else deltas.filter(part_of(m["bits"]).isin(parts))
    newest = deltas.groupBy("doc_id").agg(F.max_by(F.struct(*[c for c in deltas.columns if c != "doc_id"]), "seq").alias("d")).select("doc_id", "d.*")
    return base.join(newest.select("doc_id"), "doc_id", "left_anti").unionByName(newest.filter("not gone").select(*NAMES))


def read_checkpoint(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(channel_name, last_us) as of the same snapshot."""
    m = snapshot(spark, path, version)
    return spark.read.schema(CHECKPOINT).parquet(f"{path}/{DATA}/{m['checkpoint']}") if m["checkpoint"] else spark.createDataFrame([], CHECKPOINT)


def commit(spark: SparkSession, path: str, docs: DataFrame | None = None, gone: DataFrame | None = None, checkpoint: DataFrame | None = None, batch: tuple[str, int] | None = None, most_deltas: int = 32) -> int:
    """The version after documents are put, ids (doc_id) removed and channels' times moved on, all in one step.

    Files are written first, in folders that no manifest names yet; a writer that dies there leaves the last
    snapshot as it was, and what it wrote goes with ``vacuum``. A removal is a row in a delta: nothing is written
    again. An id both put and removed is put; of an id put twice one row stays. A channel's time never goes back.
    ``batch``: (writer, number); a batch that was committed before changes nothing. Beyond ``most_deltas`` deltas the
    index is compacted."""
    m = snapshot(spark, path)
    if batch and m["batches"].get(batch[0], -1) >= batch[1]:
        return m["version"]
    new = m | {"version": m["version"] + 1, "deltas": list(m["deltas"]), "batches": m["batches"] | ({batch[0]: batch[1]} if batch else {})}
    rows = []
    if gone is not None:
        blank = [F.lit(None).cast(kind).alias(name) for name, kind in columns(DOCUMENTS) if name != "doc_id"]
        rows.append(gone.select("doc_id", *blank, F.lit(2 * new["version"]).cast("long").alias("seq"), F.lit(True).alias("gone")))
    if docs is not None:
        rows.append(docs.select(*NAMES, F.lit(2 * new["version"] + 1).cast("long").alias("seq"), F.lit(False).alias("gone")))
    if rows:
        new["deltas"].append(_put(rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1]), path))
    if checkpoint is not None:
        moved = read_checkpoint(spark, path).unionByName(checkpoint.select("channel_name", "last_us")).groupBy("channel_name").agg(F.max("last_us").alias("last_us"))
        new["checkpoint"] = _put(moved, path)
    _publish(spark, path, new)
    return compact(spark, path) if len(new["deltas"]) > most_deltas else new["version"]


def compact(spark: SparkSession, path: str, part_rows: int = PART_ROWS) -> int:
    """The same documents as one base without deltas, as a new version. Readers of older ones keep theirs. The base
    lies in folders by hash of the id, about ``part_rows`` in each and 4,096 at most, with a digest of each."""
    m = snapshot(spark, path)
    if not m["deltas"]:
        return m["version"]
    whole = read_index(spark, path, m["version"])
    bits = min(12, max(0, whole.count() // part_rows).bit_length())
    name = uuid.uuid4().hex
    whole.withColumn("part", part_of(bits)).hint("rebalance", "part").write.partitionBy("part").parquet(f"{path}/{DATA}/{name}")
    base = spark.read.schema(f"{DOCUMENTS}, part int").parquet(f"{path}/{DATA}/{name}")
    _publish(spark, path, m | {"version": m["version"] + 1, "base": name, "bits": bits, "digests": _put(digests(base, bits), path), "deltas": []})
    return m["version"] + 1


def changed_parts(spark: SparkSession, path: str, source: DataFrame) -> tuple[list[int], int]:
    """(parts in which ``source`` (doc_id, content_hash) differs from the index, or may; documents of all other parts).
    Digests that were written with the base are compared, a row for each part; parts that deltas touch count
    as changed. No document of the index is read."""
    m = snapshot(spark, path)
    known = spark.read.schema(DIGESTS).parquet(f"{path}/{DATA}/{m['digests']}") if m["digests"] else spark.createDataFrame([], DIGESTS)
    have = known.select("part", F.col("n").alias("had"), F.col("digest").alias("old"))
    both = digests(source, m["bits"]).join(have, "part", "full_outer").select("part", "n", (F.col("n").eqNullSafe(F.col("had")) & F.col("digest").eqNullSafe(F.col("old"))).alias("same")).collect()  # 4,096 rows at most
    touched = {r.part for r in spark.read.schema(DELTA).parquet(*[f"{path}/{DATA}/{d}" for d in m["deltas"]]).select(part_of(m["bits"]).alias("part")).distinct().collect()} if m["deltas"] else set()
    differ = {r.part for r in both if not r.same} | touched
    return sorted(differ), sum(r.n for r in both if r.part not in differ)


def reconcile_committed(spark: SparkSession, path: str, source: DataFrame) -> tuple[DataFrame, int]:
    """(report of ``sync.reconcile`` over the parts that may differ, number of documents elsewhere, which are the same).
    Parts with equal digests are neither read nor shuffled."""
    parts, same = changed_parts(spark, path, source)
    bits = snapshot(spark, path)["bits"]
    return reconcile(source.filter(part_of(bits).isin(parts)), read_index(spark, path, parts=parts)), same


def vacuum(spark: SparkSession, path: str, keep: int = 2, older_than_seconds: float = 7 * 86_400) -> None:
    """Removes manifests but for the last ``keep``, and folders that none of these names and that no writer can
    still be filling: those untouched for ``older_than_seconds``."""
    known = versions(spark, path)
    kept = [snapshot(spark, path, v) for v in known[-keep:]]
    named = {name for m in kept for name in (m["base"], m["digests"], m["checkpoint"], *m["deltas"])}
    _, fs = _files(spark, path)
    for v in known[:-keep]:
        fs.delete(_files(spark, f"{path}/{MANIFESTS}/{v:012d}.json")[0], False)
    for f in _children(spark, f"{path}/{DATA}"):
        if f.getPath().getName() not in named and f.getModificationTime() / 1000 < time.time() - older_than_seconds:
            fs.delete(f.getPath(), True)
