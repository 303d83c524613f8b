"""The index as a log of snapshots: crashes, repeats, removals, compaction."""

import pytest
from pyspark.sql import functions as F

from tracewright.operators import sync
from tracewright.schemas import DOCUMENTS, columns
from tracewright.sources import snapshots


def docs(spark, ids, text):
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id string")
    own = {"raw_text": F.lit(text), "content_hash": F.lit(text), "symbols": F.array(F.lit(text))}
    return rows.select("doc_id", *[own.get(n, F.lit(None)).cast(t).alias(n) for n, t in columns(DOCUMENTS) if n != "doc_id"])


def texts(spark, path, version=None):
    return {r.doc_id: r.raw_text for r in snapshots.read_index(spark, path, version).collect()}


def times(spark, path):
    return {r.channel_name: r.last_us for r in snapshots.read_checkpoint(spark, path).collect()}


def channel(spark, **last):
    return spark.createDataFrame(list(last.items()), "channel_name string, last_us long")


def test_commits_removals_and_compaction(spark, tmp_path):
    path = str(tmp_path / "index")
    assert texts(spark, path) == {} and times(spark, path) == {}
    snapshots.commit(spark, path, docs(spark, "abc", "one"), checkpoint=channel(spark, x=5, y=9))
    snapshots.commit(spark, path, docs(spark, "bd", "two"), checkpoint=channel(spark, x=3, z=1))
    assert texts(spark, path) == {"a": "one", "b": "two", "c": "one", "d": "two"} and times(spark, path) == {"x": 5, "y": 9, "z": 1}
    before = {str(f) for f in (tmp_path / "index" / "data").rglob("*.parquet")}
    snapshots.commit(spark, path, docs(spark, "c", "back"), gone=docs(spark, "acq", "").select("doc_id"))
    assert before < {str(f) for f in (tmp_path / "index" / "data").rglob("*.parquet")}  # nothing was written again
    want = {"b": "two", "c": "back", "d": "two"}
    assert texts(spark, path) == want
    assert snapshots.compact(spark, path) == 4 and snapshots.compact(spark, path) == 4
    assert texts(spark, path) == want and texts(spark, path, 2) == {"a": "one", "b": "two", "c": "one", "d": "two"}
    assert snapshots.snapshot(spark, path)["deltas"] == [] and times(spark, path) == {"x": 5, "y": 9, "z": 1}
    snapshots.vacuum(spark, path, keep=1, older_than_seconds=-60)
    assert texts(spark, path) == want and snapshots.versions(spark, path) == [4] and len(list((tmp_path / "index" / "data").iterdir())) == 3


def test_many_deltas_are_compacted(spark, tmp_path):
    path = str(tmp_path / "index")
    for k in range(5):
        snapshots.commit(spark, path, docs(spark, ["same", f"k{k}"], str(k)), most_deltas=3)
    assert len(snapshots.snapshot(spark, path)["deltas"]) <= 3
    assert texts(spark, path) == {"same": "4"} | {f"k{k}": str(k) for k in range(5)}


@pytest.mark.parametrize("dies", ["_put", "_publish"])
def test_a_writer_that_dies_leaves_the_last_snapshot(spark, tmp_path, monkeypatch, dies):
    """Killed between the documents and the checkpoint, or before the manifest: both stay as they were, and the
    repeated batch brings both."""
    path = str(tmp_path / "index")
    snapshots.commit(spark, path, docs(spark, "ab", "old"), checkpoint=channel(spark, x=1), batch=("w", 0))
    plain, calls = getattr(snapshots, dies), []

    def fails(*args):
        calls.append(args)
        if dies == "_publish" or len(calls) == 2:
            raise RuntimeError("killed")
        return plain(*args)

    monkeypatch.setattr(snapshots, dies, fails)
    again = {"docs": docs(spark, "bc", "new"), "checkpoint": channel(spark, x=7), "batch": ("w", 1)}
    with pytest.raises(RuntimeError):
        snapshots.commit(spark, path, **again)
    assert texts(spark, path) == {"a": "old", "b": "old"} and times(spark, path) == {"x": 1}
    monkeypatch.undo()
    assert snapshots.commit(spark, path, **again) == 2 and snapshots.commit(spark, path, **again) == 2
    assert texts(spark, path) == {"a": "old", "b": "new", "c": "new"} and times(spark, path) == {"x": 7}
    snapshots.vacuum(spark, path, keep=2, older_than_seconds=-60)  # what the dead writer left goes
    named = {n for v in (1, 2) for m in [snapshots.snapshot(spark, path, v)] for n in (*m["deltas"], m["checkpoint"])}
    assert {f.name for f in (tmp_path / "index" / "data").iterdir()} == named and texts(spark, path, 1) == {"a": "old", "b": "old"}


def test_reconcile_reads_changed_parts_alone(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = docs(spark, [f"d{k}" for k in range(2000)], "text").withColumn("content_hash", F.sha2("doc_id", 256))
    snapshots.commit(spark, path, rows)
    snapshots.compact(spark, path, part_rows=20)
    assert snapshots.snapshot(spark, path)["bits"] == 7
    source = rows.filter("doc_id <> 'd7'").withColumn("content_hash", F.when(F.col("doc_id") == "d9", F.lit("x")).otherwise(F.col("content_hash"))).unionByName(docs(spark, ["new"], "n"))
    report, same = snapshots.reconcile_committed(spark, path, source)
    whole = sync.reconcile(source, snapshots.read_index(spark, path))
    key = lambda df: {(r.doc_id, r.status) for r in df.filter("status <> 'same'").collect()}
    assert key(report) == key(whole) == {("d7", "stale"), ("d9", "changed"), ("new", "missing")}
    assert same + report.filter("status = 'same'").count() == whole.filter("status = 'same'").count() == 1998
    parts, _ = snapshots.changed_parts(spark, path, source)
    read = snapshots.read_index(spark, path, parts=parts)
    assert 1 <= len(parts) <= 3 and {f.split("part=")[1].split("/")[0] for f in read.select(F.input_file_name().alias("f")).distinct().toPandas().f} == set(map(str, parts))
    assert snapshots.reconcile_committed(spark, path, rows)[1] == 2000
    snapshots.commit(spark, path, docs(spark, ["d1"], "newer"))  # a delta makes its part one to read
    report, same = snapshots.reconcile_committed(spark, path, rows)
    assert key(report) == {("d1", "changed")} and same < 2000


def test_of_two_writers_of_a_version_one_fails(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    seen = snapshots.snapshot(spark, path)
    snapshots.commit(spark, path, docs(spark, "a", "first"))
    monkeypatch.setattr(snapshots, "snapshot", lambda *a: dict(seen))
    with pytest.raises(snapshots.CommitConflict):
        snapshots.commit(spark, path, docs(spark, "a", "second"))
    monkeypatch.undo()
    assert texts(spark, path) == {"a": "first"}
