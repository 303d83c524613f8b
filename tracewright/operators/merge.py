"""Shared and private answers as one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def identity():
    return F.coalesce(F.nullif(F.col("permalink"), F.lit("")), F.concat(F.col("channel_name"), F.lit(":"), F.col("doc_id")))


def fuse_results(shared: DataFrame, private: DataFrame) -> DataFrame:
    """Results of both planes with new citation numbers: private ones that the shared plane also has go;
    exact ones interleave by rank, then the others, the shared first on a tie. ``old`` is the number in
    their own plane."""
    one = shared.withColumn("plane", F.lit(0)).withColumn("ident", identity())
    two = private.withColumn("plane", F.lit(1)).withColumn("ident", identity()).join(one.select("selection_id", "ident"), ["selection_id", "ident"], "left_anti")
    both = one.unionByName(two, allowMissingColumns=True).withColumnRenamed("citation", "old").withColumn("tier", F.when(F.col("match_type") == "exact", 0).otherwise(1))
    rank = F.row_number().over(Window.partitionBy("selection_id", "plane", "tier").orderBy("old"))
    order = Window.partitionBy("selection_id").orderBy("tier", "rank", "plane")
    return both.withColumn("rank", rank).withColumn("citation", F.row_number().over(order)).drop("ident", "rank", "tier")


def citation_map(fused: DataFrame, plane: int = 0) -> DataFrame:
    return fused.filter(F.col("plane") == plane).select("selection_id", "old", F.col("citation").alias("new"))


def remap_conflicts(conflicts: DataFrame, moved: DataFrame) -> DataFrame:
    """Pairs by new numbers; unknown ones stay."""
    out = conflicts
    for c in "ab":
        m = moved.select("selection_id", F.col("old").alias(c), F.col("new").alias(f"{c}_new"))
        out = out.join(m, ["selection_id", c], "left").withColumn(c, F.coalesce(f"{c}_new", c)).drop(f"{c}_new")
    return out


def remap_text(texts: DataFrame, moved: DataFrame, column: str = "synthesis") -> DataFrame:
    """``[n]`` by new numbers, all at once: each place is marked as it is replaced, so that a new number isn't
    replaced again; marks go at the end."""
    m = moved.groupBy("selection_id").agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("m"))
    got = texts.join(m, "selection_id", "left")
    numbers = F.array_distinct(F.transform(F.regexp_extract_all(column, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: n.try_cast("int")))
    known = F.filter(numbers, lambda n: n.isNotNull() & F.col("m").isNotNull() & F.coalesce(F.map_contains_key("m", n), F.lit(False)))
    marked = F.aggregate(known, F.col(column), lambda acc, n: F.replace(acc, F.concat(F.lit("["), n.cast("string"), F.lit("]")), F.concat(F.lit("[\u0001"), F.col("m")[n].cast("string"), F.lit("]"))))
    return got.withColumn(column, F.replace(marked, F.lit("\u0001"), F.lit(""))).drop("m")


def fuse_graphs(shared_nodes: DataFrame, shared_edges: DataFrame, private_nodes: DataFrame, private_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): a node of both planes keeps the shared copy; edges are unique by ends and type."""
    nodes = shared_nodes.withColumn("plane", F.lit(0)).unionByName(private_nodes.withColumn("plane", F.lit(1)))
    edges = shared_edges.withColumn("plane", F.lit(0)).unionByName(private_edges.withColumn("plane", F.lit(1)))
    return fuse_planes(nodes, edges)


def fuse_planes(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``fuse_graphs`` of rows that tell their ``plane`` (shared 0, private 1); nodes without a place are single in a plane.
    Rows that are dealt by selection aren't shuffled again."""
    rn = F.row_number().over(Window.partitionBy("selection_id", "id").orderBy("plane", *[c for c in ("place",) if c in nodes.columns]))
    en = F.row_number().over(Window.partitionBy("selection_id", "source", "target", "type").orderBy("plane", "confidence"))
    return nodes.withColumn("rn", rn).filter("rn = 1").drop("rn", "plane"), edges.withColumn("rn", en).filter("rn = 1").drop("rn", "plane")


def scope_counts(results: DataFrame) -> DataFrame:
    private = (F.coalesce("scope", F.lit("shared")) == "user_private").cast("long")
    return results.groupBy("selection_id").agg(F.sum(1 - private).alias("workspace"), F.sum(private).alias("private"))
