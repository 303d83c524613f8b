"""The jobs as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..checkpoints import checkpointed
from ..operators.sync import dedupe_messages
from ..operators.documents import build_documents
from ..operators.segment import aggregate_units, keep_units, segment
from ..settings import DEFAULTS, Settings
from ..sources import snapshots
from ..sources.index import read_table
from ..sources.messages import NAMES, append_messages, append_slots, message_day, read_messages, read_touched
from .bursts import PARTS, OpenBursts


def stream_sync(messages: DataFrame, store: str, index: str, checkpoint: str, settings: Settings = DEFAULTS, once: bool = True) -> StreamingQuery:
    """Incremental sync of a stream of messages: each batch joins the message store at ``store``, and the
    units it touches, late replies' included, are built again whole and written by id to ``index``; so a
    repeated batch changes nothing. Documents and channels' times are committed in one step, once for each batch.
    Of the store only the days are read that the units lie in, which the kept boundaries of bursts tell."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = checkpointed(dedupe_messages(batch.select(*NAMES)))
        days = [r.day for r in new.select(message_day().alias("day")).distinct().collect()]
        old = read_messages(spark, store, days)
        append_slots(new, store, settings)
        append_messages(new.join(old.select("channel_id", "ts_us"), ["channel_id", "ts_us"], "left_anti"), store)
        pool = read_touched(spark, store, new, settings)
        moved = new.groupBy("channel_name").agg(F.max("ts_us").alias("last_us"))
        snapshots.commit(spark, index, build_documents(segment(dedupe_messages(pool), settings), settings=settings), checkpoint=moved, batch=(checkpoint, batch_id))

    writer = messages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_bursts(messages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The messages of bursts of loose messages as each closes, with the columns of ``unit_messages``: over any
    batches the same as in batch, messages exactly one gap apart and windows of ``max_messages`` included.

    Each channel keeps the messages of its open bursts as state, with one timer for the first that may close: when
    the watermark, which the lookback holds back, is more than a gap past its last message. Then nothing that
    is still let in can join it. Messages later than the lookback are dropped. State follows the
    messages of the lookback, by channel. Needs the state store that holds lists, which is set for the session."""
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    loose = messages.select(*NAMES).filter("thread_us is null").withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", f"{settings.lookback_days} days")
    return loose.groupBy("channel_name").transformWithState(OpenBursts(settings), PARTS, "Append", "EventTime")


def stream_units(messages: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, settings: Settings = DEFAULTS) -> None:
    """Hands ``sink`` the kept units of closed bursts, batch by batch, until all that is there was read. All windows
    of a burst close in one batch, so that a batch's units are whole."""
    run_once(stream_bursts(messages, settings), lambda parts, n: sink(keep_units(aggregate_units(parts, settings), settings), n), checkpoint)


def stream_dedupe(messages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row for each (channel, time) within the lookback."""
    return messages.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", f"{settings.lookback_days} days").dropDuplicatesWithinWatermark(["channel_id", "ts_us"]).drop("ts")


KEYS = "channel_id string, ts_us long, batch long, day int"


def pass_unseen(batch: DataFrame, batch_id: int, keys: str, sink: Callable[[DataFrame, int], None]) -> None:
    """One batch of ``stream_unique``. Keys carry their batch, so that one that is repeated passes its own again."""
    day = F.floor(F.col("ts_us") / 86_400_000_000).cast("int")
    rows = checkpointed(dedupe_messages(batch.select(*NAMES)).withColumn("day", day))
    days = [r.day for r in rows.select("day").distinct().collect()]
    known = read_table(batch.sparkSession, keys, KEYS).filter(F.col("day").isin(days) & (F.col("batch") != batch_id)).select("day", "channel_id", "ts_us")
    new = checkpointed(rows.join(known, ["day", "channel_id", "ts_us"], "left_anti"))
    sink(new.select(*NAMES), batch_id)
    new.select("channel_id", "ts_us", F.lit(batch_id).cast("long").alias("batch"), "day").repartition("day").write.mode("append").partitionBy("day").parquet(keys)


def stream_unique(messages: DataFrame, keys: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hands ``sink`` each (channel, time) once, however late a copy comes: what was passed is kept as keys by day, of
    which a batch reads those of its own days and these two columns. Nothing is held as state. After a crash
    a batch may be handed over twice, with the same rows."""
    run_once(messages, lambda df, n: pass_unseen(df, n, keys, sink), checkpoint)


def run_once(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """All that is there now, then the end."""
    df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
