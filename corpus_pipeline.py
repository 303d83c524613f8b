"""Corpus pipeline: documents in, token ids out. Each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import toxicity
from tracewright.llm.mixing import mix_sources
from tracewright.llm.queries import piece_model
from tracewright.llm.sentencepiece_bpe import encode_pieces
from tracewright.llm.shared import WORD, fresh, settle
from tracewright.llm.substring_dedup import cut_repeats
from tracewright.llm.weighted_minhash import near_duplicates

TOXIC = 0.7  # documents at or above this score go


def _decided(docs: DataFrame, *added: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the columns that an operator would replace set aside, and how to name them back."""
    aside = {c: n for c, n in zip(added, fresh(docs, *(f"own_{c}" for c in added)), strict=True) if c in docs.columns}
    return docs.withColumnsRenamed(aside), {n: c for c, n in aside.items()}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from these documents and ``labels``, scores below TOXIC.
    Null and empty texts have the score of a text without features; repeated rows go or stay together;
    without rows to learn from all stay; all columns are kept."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = fresh(docs, "score")
    return toxicity.score_toxicity(docs, model, score).filter(F.col(score) < TOXIC).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates, rows that repeat it
    included. Rows with a null doc_id, null and empty texts stay; all columns are kept."""
    open_, back = _decided(docs, "component_id", "kept")
    return near_duplicates(open_).filter("kept").drop("component_id", "kept").withColumnsRenamed(back)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that documents with smaller ids also have. Texts that lose
    words are their kept words joined by one space; the others, null and empty ones too, stay as they are, and so
    do rows with a null doc_id; repeated rows lose the same; all columns are kept."""
    open_, back = _decided(docs, "n_words", "n_removed", "kept_text", "removed")
    cut = cut_repeats(open_)
    lost = F.col("n_removed") > 0
    changed = {"text": F.when(lost, F.col("kept_text")).otherwise(F.col("text")), "n_chars": F.when(lost, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))}
    return cut.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in open_.columns]).withColumnsRenamed(back)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each pass of the mix over a document; a pass over part of it has its first words.
    Documents without words and those that the mix takes nothing of go, whatever their other columns;
    null sources are a source; all columns are kept."""
    open_, back = _decided(docs, "size", "source_size", "target", "taken")
    (times,) = fresh(open_, "times")
    mixed = mix_sources(open_).filter("taken > 0")
    passes = mixed.withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")))))
    left = F.col("taken") - (F.col(times) - 1) * F.col("size")
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), left.cast("int")), " ")
    changed = {"text": F.when(left < F.col("size"), first).otherwise(F.col("text")), "n_chars": F.when(left < F.col("size"), F.length(first).cast("long")).otherwise(F.col("n_chars"))}
    return passes.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in open_.columns]).withColumnsRenamed(back)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each pass, their number, and the digest of what the ids decode to: null and empty texts have no
    ids, repeated rows stay, and columns besides doc_id, source and lang go."""
    pieces = encode_pieces(docs.select("doc_id", "source", "lang", "text"), piece_model())
    return pieces.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("substring", drop_repeated_passages),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to ``documents``; what a stage returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
