"""Units as documents with references, identity and hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import merge_symbols, parse_summary, with_references
from ..functions.identity import content_hash, point_id
from ..schemas import DOCUMENTS, columns
from ..settings import DEFAULTS, Settings


def build_documents(units: DataFrame, summaries: DataFrame | None = None, bookmark: Column | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Documents of ``units``. ``summaries`` (channel_id, thread_id, raw_output) holds what a model wrote; units
    without it fall back to the beginning of their text. ``bookmark``: also asked for by hand."""
    df = with_references(units)
    if summaries is not None:
        df = df.join(summaries.select("channel_id", "thread_id", "raw_output"), ["channel_id", "thread_id"], "left")
    else:
        df = df.withColumn("raw_output", F.lit(None).cast("string"))
    summary, extra = parse_summary(F.col("raw_output"), F.col("raw_text"), settings)
    df = df.withColumn("summary", summary).withColumn("symbols", merge_symbols(F.col("symbols"), extra))
    df = df.withColumn("is_bookmarked", F.col("is_bookmarked") | (bookmark if bookmark is not None else F.lit(False)))
    whole = lambda c: (F.col(c) / 1_000_000).cast("long")
    df = df.withColumns({"doc_id": point_id(F.col("channel_id"), F.col("thread_id")), "ts_start": whole("start_us"), "ts_end": whole("end_us"), "content_hash": content_hash(F.col("raw_text"))})
    return df.select(*[F.col(name).cast(kind).alias(name) for name, kind in columns(DOCUMENTS)])
