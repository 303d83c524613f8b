"""Conversation units: threads, bursts of loose messages, bounded windows of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import written
from ..functions.extract import carries_signal
from ..settings import DEFAULTS, Settings

ORDER = ("ts_us", "user_id", "text")


def seconds_text(ts_us: Column) -> Column:
    """Microseconds as seconds with six digits after the point."""
    return F.concat((ts_us / 1_000_000).cast("long").cast("string"), F.lit("."), F.lpad((ts_us % 1_000_000).cast("string"), 6, "0"))


def permalink(workspace: str, channel_id: Column, thread_id: Column) -> Column:
    return F.concat(F.lit(f"https://{workspace}.slack.com/archives/"), channel_id, F.lit("/p"), F.replace(thread_id, F.lit("."), F.lit("")))


def thread_units(messages: DataFrame) -> DataFrame:
    """Messages of threads with ``kind``, ``root_us``: one unit for each (channel, thread)."""
    return messages.filter("thread_us is not null").withColumn("kind", F.lit("thread")).withColumn("root_us", F.col("thread_us"))


def slot(settings: Settings = DEFAULTS) -> Column:
    """The stretch of ``gap_seconds`` that a message falls into. Messages of one slot are less than a gap apart, so
    they are always of one burst."""
    return F.floor(F.col("ts_us") / (settings.gap_seconds * 1_000_000)).cast("long")


def slots_of(messages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(channel_name, slot, first_us, last_us) of loose messages. What slots are known of can be added to: the
    least and the greatest of two tables of slots are those of their messages together."""
    loose = messages.filter("thread_us is null")
    return loose.select("channel_name", slot(settings).alias("slot"), F.col("ts_us").alias("first_us"), F.col("ts_us").alias("last_us")).groupBy("channel_name", "slot").agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))


def burst_slots(slots: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Slots with ``before_us``, the last message before them, and ``root_us``, the first message of their burst: a
    gap of more than ``gap_seconds`` begins a new one. A channel has 32 slots a day at most, however many
    messages; only these are put in order."""
    whole = Window.partitionBy("channel_name").orderBy("slot")
    rows = slots.withColumn("before_us", F.lag("last_us").over(whole))
    begins = F.when(F.col("before_us").isNull() | (F.col("first_us") - F.col("before_us") > settings.gap_seconds * 1_000_000), F.col("first_us"))
    return rows.withColumn("root_us", F.last(begins, ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, 0)))


def burst_spans(slots: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(channel_name, root_us, end_us) of bursts."""
    return burst_slots(slots, settings).groupBy("channel_name", "root_us").agg(F.max("last_us").alias("end_us"))


def slots_of_bursts(slots: DataFrame, touched: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(channel_name, slot): all slots of the bursts that hold one of the ``touched`` slots; only channels that are
    touched are put in order."""
    near = slots.join(touched.select("channel_name").distinct(), "channel_name", "left_semi")
    bursts = burst_slots(near, settings)
    roots = bursts.join(touched.select("channel_name", "slot").distinct(), ["channel_name", "slot"], "left_semi").select("channel_name", "root_us").distinct()
    return bursts.join(roots, ["channel_name", "root_us"], "left_semi").select("channel_name", "slot")


def burst_units(messages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Loose messages with ``root_us``, the first message of their burst. Messages are only added up by slot and
    then meet their slot's row: none are sorted, in a busy channel neither."""
    loose = messages.filter("thread_us is null").withColumn("slot", slot(settings))
    roots = burst_slots(slots_of(messages, settings), settings).select("channel_name", "slot", "root_us")
    return loose.join(roots, ["channel_name", "slot"]).withColumn("kind", F.lit("burst")).drop("slot")


def solo_units(messages: DataFrame) -> DataFrame:
    """Where times can't be trusted: every loose message by itself."""
    return messages.filter("thread_us is null").withColumn("root_us", F.col("ts_us")).withColumn("kind", F.lit("solo"))


def unit_messages(messages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Messages with ``kind, root_us, piece, unit_size, thread_id``: units cut into windows of
    ``max_messages`` in time order. Solo messages that share a time stay apart."""
    loose = burst_units(messages, settings) if settings.trust_time else solo_units(messages)
    together = thread_units(messages).unionByName(loose)
    by = ["channel_name", "kind", "root_us"] + ([] if settings.trust_time else ["solo_user", "solo_text"])
    if not settings.trust_time:
        solo = F.col("kind") == "solo"
        together = together.withColumn("solo_user", F.when(solo, F.col("user_id"))).withColumn("solo_text", F.when(solo, F.col("text")))
    unit = Window.partitionBy(*by)
    numbered = together.withColumn("rn", F.row_number().over(unit.orderBy(*ORDER))).withColumn("piece", F.floor((F.col("rn") - 1) / settings.max_messages).cast("int"))
    piece = Window.partitionBy(*by, "piece")
    out = numbered.withColumn("first_us", F.min("ts_us").over(piece)).withColumn("unit_size", F.count("*").over(piece))
    return out.withColumn("thread_id", seconds_text(F.col("first_us"))).drop("rn")


def aggregate_units(parts: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row for each unit; each list holds at most ``max_messages`` messages."""
    by = ["channel_name", "kind", "root_us", "piece", "thread_id"] + (["solo_user", "solo_text"] if "solo_user" in parts.columns else [])
    row = F.struct("ts_us", "user_id", "text", "user_name", "reactions", "channel_id", "channel_tier")
    grouped = parts.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("m"))
    reactions = F.array_distinct(F.flatten(F.transform("m", lambda m: F.coalesce(m["reactions"], F.array().cast("array<string>")))))
    out = grouped.select(
        "kind", "thread_id", F.col("m")[0]["channel_id"].alias("channel_id"), "channel_name", F.col("m")[0]["channel_tier"].alias("channel_tier"),
        F.col("m")[0]["ts_us"].alias("start_us"), F.element_at("m", -1)["ts_us"].alias("end_us"), F.array_distinct(F.transform("m", lambda m: m["user_name"])).alias("participants"),
        reactions.alias("reactions"), F.array_join(F.transform("m", lambda m: F.concat(m["user_name"], F.lit(": "), m["text"])), "\n").alias("raw_text"),
        F.array_join(F.transform("m", lambda m: m["text"]), "\n").alias("plain_text"), F.size("m").cast("long").alias("message_count"), "root_us", "piece",
    )
    marks = F.array(*[F.lit(r) for r in settings.trigger_reactions])
    return out.withColumn("is_bookmarked", F.arrays_overlap("reactions", marks)).withColumn("permalink", permalink(settings.workspace, F.col("channel_id"), F.col("thread_id")))


def keep_units(units: DataFrame, settings: Settings = DEFAULTS, min_messages: int | None = None) -> DataFrame:
    """Units of enough messages, or marked by a trigger reaction, or (times untrusted) alone but with signal."""
    floor = settings.min_messages if min_messages is None else min_messages
    keep = (F.col("message_count") >= floor) | F.col("is_bookmarked")
    if not settings.trust_time:
        keep = keep | ((F.col("kind") == "solo") & carries_signal(F.col("plain_text"), settings))
    return units.filter(keep)


def segment(messages: DataFrame, settings: Settings = DEFAULTS, min_messages: int | None = None) -> DataFrame:
    return keep_units(aggregate_units(unit_messages(messages, settings), settings), settings, min_messages)


DIGIT = 12  # bits of a gap that one pass of the selection settles


def quantile_gaps(gaps: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(channel_name, largest, and one column for each share): nearest-rank quantiles of ``gap`` by channel, exact.

    A pass counts the gaps that still may be the one by their next ``DIGIT`` bits, highest first, and the counts
    tell which digit holds the rank: what is put in order are at most 4,096 counts for each channel and share.
    Passes grow with the bits of the largest gap, not with the number of gaps."""
    gaps = written(gaps.select("channel_name", "gap"))
    totals = written(gaps.groupBy("channel_name").agg(F.count("*").alias("n"), F.max("gap").alias("largest")))
    bits = int(totals.agg(F.max("largest")).first()[0] or 0).bit_length()
    rank = lambda f: F.least(F.greatest(F.bround(F.lit(f) * F.col("n")), F.lit(1)), F.col("n")).cast("long")
    sought = totals.select("channel_name", F.explode(F.array(*[F.struct(F.lit(name).alias("share"), rank(f).alias("rank")) for name, f in shares.items()])).alias("s")).select("channel_name", "s.*", F.lit(0).cast("long").alias("prefix"))
    for shift in range((max(bits, 1) - 1) // DIGIT * DIGIT, -1, -DIGIT):
        digit = F.shiftright("gap", shift).bitwiseAND((1 << DIGIT) - 1)
        counts = gaps.join(sought, "channel_name").filter(F.shiftright("gap", shift + DIGIT) == F.col("prefix")).groupBy("channel_name", "share", "rank", "prefix", digit.alias("digit")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("channel_name", "share").orderBy("digit"))
        found = counts.withColumn("upto", upto).filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        sought = written(found.select("channel_name", "share", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), (F.shiftleft("prefix", DIGIT) + F.col("digit")).alias("prefix")))
    wide = sought.groupBy("channel_name").agg(*[F.max(F.when(F.col("share") == name, F.col("prefix"))).alias(name) for name in shares])
    return totals.select("channel_name", "largest").join(wide, "channel_name")


def gap_report(messages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Per channel, over loose messages: number, nearest-rank median and 90th percentile of gaps, largest
    gap, and whether gaps carry no boundary. Gaps are looked at within slots and to the slot before."""
    counts = messages.groupBy("channel_name").agg(F.sum(F.col("thread_us").isNull().cast("long")).alias("loose_messages"))
    loose = messages.filter("thread_us is null").withColumn("slot", slot(settings))
    before = burst_slots(slots_of(messages, settings), settings).select("channel_name", "slot", "before_us")
    within = Window.partitionBy("channel_name", "slot").orderBy("ts_us")
    gaps = loose.join(before, ["channel_name", "slot"]).withColumn("gap", F.col("ts_us") - F.coalesce(F.lag("ts_us").over(within), "before_us")).filter("gap is not null")
    out = counts.join(quantile_gaps(gaps, {"p50": 0.5, "p90": 0.9}), "channel_name", "left")
    second = lambda c: F.coalesce(F.col(c), F.lit(0)) / 1_000_000
    out = out.select("channel_name", "loose_messages", second("p50").alias("p50_gap"), second("p90").alias("p90_gap"), second("largest").alias("max_gap"))
    return out.withColumn("degenerate", (F.col("loose_messages") > settings.min_messages) & (F.col("p90_gap") < settings.degenerate_p90_seconds))


def recent_candidates(messages: DataFrame, parents: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Latest units of each channel, small ones too. ``parents``: (channel_name, ts_us, reply_count,
    latest_us); a parent's replies count and its latest reply dates the unit."""
    units = segment(messages, settings, min_messages=1)
    parent = parents.select("channel_name", F.col("ts_us").alias("start_us"), "reply_count", "latest_us")
    out = units.join(parent, ["channel_name", "start_us"], "left")
    replies = F.coalesce("reply_count", F.lit(0))
    out = out.withColumn("size", F.col("message_count") + replies).withColumn("last_us", F.greatest("end_us", F.coalesce("latest_us", "end_us"))).withColumn("is_thread", replies > 0)
    rank = F.row_number().over(Window.partitionBy("channel_name").orderBy(F.col("last_us").desc(), "thread_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= settings.recent_limit)


def unit_of(parts: DataFrame, asked: DataFrame) -> DataFrame:
    """All pieces of the units that hold the asked messages (channel_id, ts_us); ``holds`` marks the piece."""
    key = ["channel_name", "kind", "root_us"]
    pieces = parts.select(*key, "piece", "thread_id").distinct()
    at = parts.join(asked.select("channel_id", "ts_us").distinct(), ["channel_id", "ts_us"]).select("channel_id", "ts_us", *key, F.col("piece").alias("own")).distinct()
    return pieces.join(at, key).select("channel_id", "ts_us", "thread_id", "piece", (F.col("piece") == F.col("own")).alias("holds"))
