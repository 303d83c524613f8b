"""What steps leave on disk, and reasons that are told by what was met alone."""

import os
import time

from pyspark.sql import functions as F

from tracewright import checkpoints
from tracewright.operators import retrieve


def shuffle_files(spark):
    dirs = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for _, _, names in os.walk(d.getPath()) for f in names if f.startswith("shuffle_")}


def test_a_written_step_leaves_no_shuffle(spark):
    before, said = shuffle_files(spark), spark.conf.get(checkpoints.CLEANUP, None)
    out = checkpoints.checkpointed(spark.range(1000).repartition(7, "id"))
    end = time.time() + 20
    while time.time() < end and shuffle_files(spark) - before:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(checkpoints.CLEANUP, None) == said and out.count() == 1000


def test_what_was_met_tells_the_reason(spark):
    docs = spark.createDataFrame(
        [("a", 9, [12, 7], ["abcdef1"], ["lib/x.py"], ["x.py"], ["some_name"], ["ann"]), ("b", 8, [], ["abcdef1", "abcdef0"], ["lib/x.py"], ["x.py"], [], []), ("c", 7, [], [], ["lib/x.py"], ["x.py"], [], []),
         ("d", 6, [], [], ["other/x.py"], ["x.py"], [], []), ("e", 5, [], [], [], [], ["some_name"], ["zoe", "ann"]), ("f", 4, [100, 12], [], [], [], [], [])],
        "doc_id string, ts_end long, pr_refs array<int>, commit_shas array<string>, file_paths array<string>, file_basenames array<string>, symbols array<string>, participants array<string>")
    asked = spark.createDataFrame(
        [(1, "lib/x.py", ["some_name"], [100, 12, 7], [], ["zoe"]), (2, "lib/x.py", [], [], ["abcdef1", "abcdef0"], []), (3, "", ["some_name"], [], [], ["zoe", "ann"]), (4, "y/x.py", [], None, None, None)],
        "selection_id long, file_path string, symbols array<string>, pr_numbers array<int>, all_shas array<string>, authors array<string>")
    hits = retrieve.exact_tier(retrieve.selection_terms(asked), retrieve.postings(docs))
    rows = hits.join(docs.drop("ts_end", "symbols"), "doc_id").join(asked.drop("symbols"), "selection_id")
    person = F.when(F.col("strength") == 1, F.array_min(F.array_intersect("participants", "authors")))
    got = rows.select(retrieve.why().alias("whole"), retrieve.named_why(person).alias("told"), "strength").collect()
    assert all(r.whole == r.told for r in got) and {r.strength for r in got} == {1, 2, 3, 4, 5}
    assert "mentions pull request 7" in {r.told for r in got}


def test_steps_small_on_disk_are_not_broadcast(spark):
    """Rows that pack well are many; the driver would hold all of them."""
    step = checkpoints.written(spark.range(400_000).select((F.col("id") % 7).alias("k"), F.repeat(F.lit("x"), 90).alias("t"), F.sha1((F.col("id") % 9000).cast("string").cast("binary")).alias("u")))
    of = lambda t: t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    files = sum(os.path.getsize(f.removeprefix("file://").removeprefix("file:")) for f in step.inputFiles())
    assert files < 5_000_000 and of(step) >= 10 * files
