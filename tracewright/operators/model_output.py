"""Prompt texts, and the application of what models answered (tables of JSON text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import DEFAULTS, Settings


def summary_prompt(channel: Column, raw_text: Column) -> Column:
    return F.concat(F.lit("Conversation in #"), channel, F.lit(":\n\n"), raw_text)


def candidates_text(hits: DataFrame, body: str = "summary", cut: int = 500) -> DataFrame:
    """(selection_id, candidates): the hits of each selection as numbered text, in citation order; ``hits``
    has citation, channel_name, date and the body. A selection has at most ``rerank_input`` hits."""
    line = F.concat(F.lit("["), F.col("citation").cast("string"), F.lit("] #"), F.coalesce("channel_name", F.lit("?")), F.lit(" "), F.coalesce("date", F.lit("")), F.lit("\n    "), F.substring(F.coalesce(body, F.lit("")), 1, cut))
    rows = hits.groupBy("selection_id").agg(F.array_sort(F.collect_list(F.struct("citation", line.alias("line")))).alias("rows"))
    return rows.select("selection_id", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("candidates"))


def rerank_prompt(hits: DataFrame, descriptions: DataFrame) -> DataFrame:
    text = F.concat(F.col("description"), F.lit("\n\nCandidates:\n"), F.col("candidates"))
    return candidates_text(hits).join(descriptions, "selection_id").select("selection_id", text.alias("prompt"))


def synthesis_prompt(hits: DataFrame, descriptions: DataFrame) -> DataFrame:
    text = F.concat(F.col("description"), F.lit("\n\nEvidence:\n"), F.col("candidates"))
    return candidates_text(hits, "raw_text", 900).join(descriptions, "selection_id").select("selection_id", text.alias("prompt"))


def apply_verdicts(hits: DataFrame, verdicts: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Hits in their final order, with ``place``: exact ones always and first, by strength; others as the
    model ordered them, without those it calls irrelevant; unmentioned ones last. The last verdict on an
    index counts, indices outside the list are ignored, and an answer that can't be read leaves the order."""
    shape = "struct<items:array<struct<index:string,relevant:string,why:string>>>"
    read = verdicts.select("selection_id", F.from_json("json", shape).alias("v")).withColumn("readable", F.col("v.items").isNotNull())
    items = read.select("selection_id", F.posexplode("v.items").alias("order", "i")).select("selection_id", "order", F.col("i.index").try_cast("int").alias("citation"), F.coalesce(F.lower("i.relevant"), F.lit("true")).alias("relevant"), F.coalesce("i.why", F.lit("")).alias("said"))
    last = items.filter("citation is not null").groupBy("selection_id", "citation").agg(F.max_by(F.struct("order", "relevant", "said"), "order").alias("v"))
    out = hits.join(last, ["selection_id", "citation"], "left")
    exact = F.col("match_type") == "exact"
    no = F.coalesce(F.col("v.relevant").isin("false", "0", "", "null"), F.lit(False))
    out = out.filter(exact | ~no)
    order = Window.partitionBy("selection_id").orderBy(
        F.when(exact, 0).otherwise(1), F.when(exact, -F.col("exact_strength")).otherwise(0), F.when(exact, F.lit(0)).otherwise(F.coalesce("v.order", F.lit(1_000_000))), "citation")
    from .retrieve import exact_why

    out = out.withColumn("place", F.row_number().over(order)).withColumn("why", F.when(exact, exact_why(F.col("exact_strength"))).otherwise(F.trim(F.coalesce("v.said", F.lit("")))))
    return out.filter(F.col("place") <= settings.rerank_output).drop("v")


def parse_conflicts(answers: DataFrame, counts: DataFrame) -> DataFrame:
    """(selection_id, a, b, kind, place): pairs of citations, of the list they stand in; equal ends, numbers
    outside 1 to n (``counts``: selection_id, n) and repeats are dropped."""
    pair = "array<struct<a:string,b:string>>"
    read = answers.select("selection_id", F.from_json("json", f"struct<conflicts:{pair},supersedes:{pair}>").alias("v"))
    def named(kind: str):
        return lambda p: F.struct(F.lit(kind).alias("kind"), p["a"].alias("a"), p["b"].alias("b"))

    kinds = F.concat(*[F.transform(F.coalesce(f"v.{k}", F.array().cast(pair)), named(n)) for k, n in (("conflicts", "conflict"), ("supersedes", "supersede"))])
    rows = read.select("selection_id", F.posexplode(kinds).alias("place", "p")).select("selection_id", "place", F.col("p.a").try_cast("int").alias("a"), F.col("p.b").try_cast("int").alias("b"), "p.kind")
    good = rows.join(counts, "selection_id").filter("a is not null and b is not null and a <> b and a between 1 and n and b between 1 and n")
    rn = F.row_number().over(Window.partitionBy("selection_id", "a", "b", "kind").orderBy("place"))
    return good.withColumn("rn", rn).filter("rn = 1").select("selection_id", "a", "b", "kind", "place")
