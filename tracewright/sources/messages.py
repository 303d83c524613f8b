"""The message store: a table of files by day, read only where new messages can change units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..operators.segment import slot, slots_of, slots_of_bursts
from ..schemas import MESSAGES, columns
from ..settings import DEFAULTS, Settings
from .index import read_table

NAMES = [name for name, _ in columns(MESSAGES)]
DAY_US = 86_400_000_000


def message_day() -> Column:
    """The day that a message is stored under: its thread's first, so that a thread stands in one place, else its own."""
    return F.floor(F.coalesce("thread_us", "ts_us") / DAY_US).cast("int")


SLOTS = "channel_name string, slot long, first_us long, last_us long, bucket int"
BUCKETS = 64


def _bucket() -> Column:
    return F.pmod(F.xxhash64("channel_name"), F.lit(BUCKETS)).cast("int")


def append_messages(messages: DataFrame, store: str, files: int = 16) -> None:
    """Adds messages to the store, at most ``files`` files for each day."""
    rows = messages.select(*NAMES, message_day().alias("day"))
    rows.repartition("day", F.pmod(F.xxhash64("channel_id", "ts_us"), F.lit(files))).write.mode("append").partitionBy("day").parquet(store)


def append_slots(messages: DataFrame, store: str, settings: Settings = DEFAULTS) -> None:
    """Adds the slots of loose messages to the boundaries kept beside the store, by bucket of channel. To be written
    before the messages: a repeated row changes nothing, and a slot ahead of its messages only widens what
    is read."""
    slots_of(messages, settings).withColumn("bucket", _bucket()).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{store}-slots")


def read_slots(spark: SparkSession, store: str, channels: DataFrame) -> DataFrame:
    """(channel_name, slot, first_us, last_us) of the channels named: only their buckets are read."""
    buckets = [r.bucket for r in channels.select(_bucket().alias("bucket")).distinct().collect()]  # 64 at most
    rows = read_table(spark, f"{store}-slots", SLOTS).filter(F.col("bucket").isin(buckets)).join(channels.select("channel_name").distinct(), "channel_name", "left_semi")
    return rows.groupBy("channel_name", "slot").agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))


def read_messages(spark: SparkSession, store: str, days: list[int] | None = None) -> DataFrame:
    """The stored messages with their ``day``; with ``days`` only those, which prunes folders."""
    rows = read_table(spark, store, f"{MESSAGES}, day int")
    return rows if days is None else rows.filter(F.col("day").isin(days))


def read_touched(spark: SparkSession, store: str, new: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The stored messages that share a unit with ``new`` ones: those of their threads, and those in the slots of the
    bursts that hold them, however long these have gone on. The kept boundaries tell which slots; ``new`` must be
    among them. Days come to the driver, a number for each, and prune folders; messages don't."""
    got = new.select("channel_name", "thread_us", "ts_us", message_day().alias("day"))
    loose = got.filter("thread_us is null").select("channel_name", slot(settings).alias("slot"))
    whole = checkpointed(slots_of_bursts(read_slots(spark, store, loose), loose, settings))
    gap = settings.gap_seconds * 1_000_000
    begin, end = F.floor(F.col("slot") * gap / DAY_US), F.floor(((F.col("slot") + 1) * gap - 1) / DAY_US)
    near = whole.select(F.explode(F.array_distinct(F.array(begin.cast("int"), end.cast("int")))).alias("day"))
    days = [r.day for r in got.filter("thread_us is not null").select("day").distinct().collect()]
    other = [r.day for r in near.distinct().collect()]
    stored = read_messages(spark, store)
    threads = stored.filter(F.col("day").isin(days) & F.col("thread_us").isNotNull()).join(got.filter("thread_us is not null").select("channel_name", "thread_us").distinct(), ["channel_name", "thread_us"], "left_semi")
    bursts = stored.filter(F.col("day").isin(other) & F.col("thread_us").isNull()).withColumn("slot", slot(settings)).join(whole, ["channel_name", "slot"], "left_semi")
    return threads.select(*NAMES).unionByName(bursts.select(*NAMES))
