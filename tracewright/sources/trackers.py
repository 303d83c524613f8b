"""Pull requests, tickets and incidents: fixture files and nested payloads as flat tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import INCIDENTS, PRS, TICKETS

PR_PAYLOAD = "number int, title string, user struct<login:string>, merged_at string, merge_commit_sha string, files array<struct<filename:string>>, commits array<struct<sha:string>>"
TICKET_PAYLOAD = "key string, fields struct<summary:string,status:struct<name:string>,assignee:struct<displayName:string>>"
INCIDENT_PAYLOAD = "id string, shortId string, title string, firstSeen string, status string, permalink string, firstRelease struct<version:string>"


def read_trackers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pull requests, tickets, incidents) of the three files below ``path``; an absent file is empty, as
    are malformed rows."""

    def read(name: str, schema: str) -> DataFrame:
        try:
            return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(f"{path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)

    return read("github_prs.json", PRS), read("tickets.json", TICKETS), read("sentry_issues.json", INCIDENTS)


def normalize_prs(payloads: DataFrame, column: str = "json") -> DataFrame:
    p = payloads.select(F.from_json(column, PR_PAYLOAD).alias("p")).filter("p.number is not null")
    return p.select(
        "p.number", "p.title", F.col("p.user.login").alias("author"), "p.merged_at", F.transform("p.files", lambda f: f["filename"]).alias("files"),
        F.transform("p.commits", lambda c: F.substring(c["sha"], 1, 7)).alias("commit_shas"), "p.merge_commit_sha")


def normalize_tickets(payloads: DataFrame, column: str = "json") -> DataFrame:
    """``payloads`` also has pr_number, the request that the ticket was found for."""
    p = payloads.select(F.from_json(column, TICKET_PAYLOAD).alias("p"), "pr_number").filter("p.key is not null")
    return p.select("p.key", F.col("p.fields.summary").alias("title"), F.col("p.fields.status.name").alias("status"), F.col("p.fields.assignee.displayName").alias("assignee"), "pr_number")


def normalize_incidents(payloads: DataFrame, org: str, column: str = "json") -> DataFrame:
    p = payloads.select(F.from_json(column, INCIDENT_PAYLOAD).alias("p")).filter("p.id is not null or p.shortId is not null")
    url = F.coalesce("p.permalink", F.concat(F.lit(f"https://sentry.io/organizations/{org}/issues/"), F.col("p.id"), F.lit("/")))
    return p.select(F.coalesce(F.nullif("p.shortId", F.lit("")), "p.id").alias("id"), "p.title", F.col("p.firstSeen").alias("first_seen"), "p.status", url.alias("url"), F.col("p.firstRelease.version").alias("first_release"))
