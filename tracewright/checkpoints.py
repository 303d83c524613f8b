"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder serves on one machine (a local
    master, as in tests), and a cluster is refused. The session's checkpoints go there as well."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-checkpoints-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Columns packed by zstd hold many times their files' bytes as rows. The planner takes files for rows, and would broadcast,
#: through the driver's memory, tables that are small on disk alone.
PACKED, TIMES = "spark.sql.sources.fileCompressionFactor", "16"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table of compressed columns in the shared folder, of which later steps read only what they need. What
    was shuffled for it leaves the local disks when it is written; else it stays until the driver collects garbage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/written-{uuid.uuid4().hex}"
    if float(spark.conf.get(PACKED)) == 1.0:
        spark.conf.set(PACKED, TIMES)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut off from what it came from: rows in the shared folder, as columns (a checkpoint of Spark's own holds
    each row uncompressed, several times the bytes)."""
    return written(df)
