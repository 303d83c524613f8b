"""Whether expected evidence is found, and where the threshold lies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def eval_ranks(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(case_id, marker, rank, passed): the rank of the first result of the expected channel whose summary or
    text holds the marker in any case. ``results``: case_id, rank, channel_name, summary, raw_text;
    ``expected``: case_id, channel_name, marker."""
    text = F.lower(F.concat_ws(" ", "summary", "raw_text"))
    found = expected.join(results, ["case_id", "channel_name"]).filter(text.contains(F.lower("marker"))).groupBy("case_id", "channel_name", "marker").agg(F.min("rank").alias("rank"))
    out = expected.join(found, ["case_id", "channel_name", "marker"], "left")
    return out.withColumn("passed", F.col("rank").isNotNull())


def null_cases(cases: DataFrame, results: DataFrame) -> DataFrame:
    """(case_id, passed): cases that must have no results."""
    return cases.select("case_id").join(results.groupBy("case_id").agg(F.count("*").alias("n")), "case_id", "left").select("case_id", F.coalesce(F.col("n") == 0, F.lit(True)).alias("passed"))


def conflict_cases(cases: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(case_id, passed): cases that must show a conflict or a superseding pair."""
    return cases.select("case_id").join(conflicts.select("case_id").distinct().withColumn("ok", F.lit(True)), "case_id", "left").select("case_id", F.coalesce("ok", F.lit(False)).alias("passed"))


def calibrate(scores: DataFrame) -> DataFrame:
    """One row of (best_null, worst_hit, threshold): midway between the best score of null queries and the
    worst of others; no threshold where they overlap. ``scores``: is_null, best_dense."""
    one = scores.agg(F.max(F.when(F.col("is_null"), F.col("best_dense"))).alias("best_null"), F.min(F.when(~F.col("is_null"), F.col("best_dense"))).alias("worst_hit"))
    return one.withColumn("threshold", F.when(F.col("best_null") < F.col("worst_hit"), (F.col("best_null") + F.col("worst_hit")) / 2))
