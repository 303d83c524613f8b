"""The document index as a table of files: snapshots, checkpoints, stamps."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..schemas import CHECKPOINT
from . import snapshots


class IndexMismatch(Exception):
    """The index was built by another embedder or from another corpus."""


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table, or none of its rows where nothing was written yet. Any other fault is raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the last snapshot; none where nothing was committed."""
    return snapshots.read_index(spark, path)


def write_documents(docs: DataFrame, path: str) -> int:
    """Puts documents by their id, the last version of each; see ``snapshots.commit``."""
    return snapshots.commit(docs.sparkSession, path, docs)


def delete_documents(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("doc_id"), "doc_id", "left_anti")


def delete_channel(index: DataFrame, checkpoint: DataFrame, channel_name: str) -> tuple[DataFrame, DataFrame]:
    gone = F.col("channel_name") == channel_name
    return index.filter(~gone), checkpoint.filter(~gone)


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """Missing or unreadable: empty. A checkpoint has one row for each channel, so it is read whole at once
    to see whether it can be."""
    got = read_table(spark, path, CHECKPOINT)
    try:
        return spark.createDataFrame(got.toArrow())
    except (PySparkException, Py4JJavaError):
        return spark.createDataFrame([], CHECKPOINT)


def write_checkpoint(checkpoint: DataFrame, path: str) -> None:
    """Written after the documents; a channel's time never goes back."""
    old = read_checkpoint(checkpoint.sparkSession, path)
    merged = old.unionByName(checkpoint.select("channel_name", "last_us")).groupBy("channel_name").agg(F.max("last_us").alias("last_us"))
    checkpointed(merged).coalesce(1).write.mode("overwrite").parquet(path)


def stamp(spark: SparkSession, embedder: str, dimension: int, source: str) -> DataFrame:
    return spark.range(1).select(F.lit(embedder).alias("embedder"), F.lit(dimension).alias("dimension"), F.lit(source).alias("source"))


def guard(meta: DataFrame, embedder: str, source: str, recreate: bool = False) -> None:
    """Refuses to mix embedders or corpora in one index; ``meta`` has one row at most."""
    row = meta.limit(1).collect()
    if row and not recreate and (row[0].embedder, row[0].source) != (embedder, source):
        raise IndexMismatch(f"index holds {row[0].embedder} of {row[0].source}, asked for {embedder} of {source}")


def index_status(index: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Documents by channel with, on each row, their total and the time that all channels are covered to."""
    per = index.groupBy("channel_name").agg(F.count("*").alias("documents"))
    covered = checkpoint.agg(F.min("last_us").alias("covered_us"), (F.count("*") == 0).alias("never_run"))
    return per.withColumn("total", F.sum("documents").over(Window.partitionBy())).crossJoin(F.broadcast(covered))  # one row
