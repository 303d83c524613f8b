"""URL filters: block and allow rules over hosts and paths, by hashed lookup expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh

SPACE = 8  # hex digits of a digest that the equi-join compares first


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def split_rule(rule: Column) -> tuple[Column, Column]:
    """Host (up to the first slash, lower-cased) and path (from the slash) of a rule like ``example.net/en/``."""
    host = F.translate(F.regexp_extract(rule, r"(?s)\A([^/]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rule, r"(?s)\A[^/]*(.*)", 1)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds ``host, path, rule, verdict`` to ``pages``.

    ``rules`` has ``rule`` (string) and ``action`` (``block`` or ``allow``), of any size. A rule fits its
    host and all subdomains where the path starts with the rule's path; the longest fitting rule wins,
    on a tie that with the longer host, then ``block``. Null rules and rules without a host are
    ignored; no rule: ``default``. Each distinct (host, path) is expanded once into its host suffixes of the
    numbers of labels, and its path prefixes of the lengths, that occur in rules, so that the expansion stays
    small whatever the rules are and however long a host is; expressions and rules meet on the first hex digits of their digests, then
    full digests decide. Rules are broadcast only where Spark knows them to be small; otherwise the
    same equi-join shuffles. Columns of ``pages`` named like the added ones are replaced; no row is
    lost or doubled, repeated and null rows included.
    """
    rule_host, rule_path = split_rule(F.col("rule"))
    known = (
        rules.select("rule", "action").filter("rule is not null and action is not null").withColumn("rh", rule_host).withColumn("rp", rule_path)
        .filter("rh <> ''").select("rule", "action", "rh", "rp", F.sha2(F.concat(F.lit("h:"), "rh", F.lit("\n"), "rp"), 256).alias("rd"))
        .withColumn("rk", F.substring("rd", 1, SPACE))
    )
    n_labels = lambda host: F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    each = lambda c: F.coalesce(F.sort_array(F.collect_set(c)), F.array().cast("array<int>"))
    shapes = known.agg(each(F.length("rp")).alias("widths"), each(n_labels(F.col("rh"))).alias("depths"))

    judged = pages.drop("host", "path", "rule", "verdict").withColumn("host", url_host(F.col(url))).withColumn("path", url_path(F.col(url)))
    asked = judged.select("host", "path").filter("host <> ''").distinct().withColumn("labels", n_labels(F.col("host")))
    grown = (
        asked.crossJoin(F.broadcast(shapes))  # one row of lengths
        .withColumn("depth", F.explode("depths")).filter("labels >= depth").withColumn("hs", F.expr("substring_index(host, '.', -depth)")).filter("hs <> ''")
        .withColumn("width", F.explode("widths")).filter(F.length("path") >= F.col("width"))
        .withColumn("xd", F.sha2(F.concat(F.lit("h:"), "hs", F.lit("\n"), F.expr("substring(path, 1, width)")), 256))
        .withColumn("xk", F.substring("xd", 1, SPACE))
    )
    hits = grown.join(known, (F.col("xk") == F.col("rk")) & (F.col("xd") == F.col("rd")))
    rank = F.struct(F.length("rule").alias("n"), F.length("rh").alias("hn"), F.col("action").alias("action"), F.col("rule").alias("rule"))
    bh, bp = fresh(judged, "best_host", "best_path")
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("best")).select(
        F.col("host").alias(bh), F.col("path").alias(bp), F.col("best.rule").alias("rule"), F.col("best.action").alias("verdict"))
    out = judged.join(best, (judged["host"] == best[bh]) & (judged["path"] == best[bp]), "left").drop(bh, bp)
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
