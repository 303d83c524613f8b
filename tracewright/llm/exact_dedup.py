"""Exact dedup by progressive refinement: length, then a hash of the beginning, then the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, settle

HEAD = 64  # code points of the beginning that the second step hashes
WORDS = 1 << 18  # 64-bit words of the filter of groups that may go on: 2 MB, whatever the corpus


def bare(text: Column) -> Column:
    """A text without white space (blank, tab, line feed, vertical tab, form feed, carriage return); null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in " \t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def exact_duplicates(docs: DataFrame, texts: bool = True, head: int = HEAD, words: int = WORDS) -> DataFrame:
    """``doc_id, text`` and any others -> adds ``keep_id, group_size, kept``; without ``text`` where ``texts`` is false.

    Texts are equal when they are identical without white space; null counts as empty, so that null, empty and
    blank texts are one group. Of equal texts the row with the most code points as written stays, then the
    smallest doc_id, null last; of rows that agree in both exactly one stays. ``group_size`` counts rows. Every
    row is returned, with its other columns; those named like the added ones are replaced. No rows give none.

    Rows are counted by (length, hash of the first ``head`` code points) in one aggregation. Groups of two or
    more set a bit in a filter of ``words`` words, which is broadcast: its size is fixed, and where it fills up
    only more rows are looked at. Only rows whose bit is set have their whole text hashed (SHA-256); the others
    are alone for certain and are returned as they are. What is then grouped and joined are digests and
    numbers; a hot group is added up before it is shuffled, and its rows meet one row, in a join that adaptive
    execution can split.
    """
    docs = docs.drop("keep_id", "group_size", "kept")
    rid, size, begin, slot, bit, mask, full, long_ = fresh(docs, "rid", "size", "begin", "slot", "bit", "mask", "full", "long")
    plain = bare(F.col("text"))
    place = F.xxhash64(size, begin)
    shaped = docs.withColumn(size, F.length(plain)).withColumn(begin, F.xxhash64(F.substring(plain, 1, head)))
    several = shaped.select(size, begin).groupBy(size, begin).agg(F.count("*").alias("n")).filter("n > 1")
    marked = several.select(F.pmod(place, F.lit(words)).alias(slot), F.shiftright(place, 58).bitwiseAND(F.lit(63)).cast("int").alias(bit))
    sieve = settle(marked.groupBy(slot).agg(F.bit_or(F.expr(f"shiftleft(1L, `{bit}`)")).alias(mask)), "sieve")

    read = docs.withColumn(size, F.length(plain)).withColumn(begin, F.xxhash64(F.substring(plain, 1, head)))
    read = read.withColumn(slot, F.pmod(place, F.lit(words))).join(F.broadcast(sieve), slot, "left")  # at most ``words`` rows
    goes_on = F.expr(f"shiftright(`{mask}`, cast(shiftright(xxhash64(`{size}`, `{begin}`), 58) & 63 as int)) & 1 = 1")
    read = read.withColumn(full, F.when(goes_on, F.sha2(plain, 256))).withColumn(long_, F.coalesce(F.length("text"), F.lit(0)))
    read = read.withColumn(rid, F.monotonically_increasing_id()).drop(slot, mask)
    rows = settle(read if texts else read.drop("text"), "shapes")  # with it the number of a row stands fast

    best = F.struct((-F.col(long_)).alias("l"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col(rid).alias("rid"))
    groups = settle(rows.filter(F.col(full).isNotNull()).groupBy(size, begin, full).agg(F.min(best).alias("best"), F.count("*").alias("group_size")), "groups")
    together = rows.filter(F.col(full).isNotNull()).join(groups, [size, begin, full])
    some = together.withColumn("keep_id", F.col("best.doc_id")).withColumn("kept", F.col("best.rid") == F.col(rid)).drop("best")
    alone = rows.filter(F.col(full).isNull()).withColumn("group_size", F.lit(1).cast("long")).withColumn("keep_id", F.col("doc_id")).withColumn("kept", F.lit(True))
    kept = [c for c in docs.columns if texts or c != "text"] + ["keep_id", "group_size", "kept"]
    return some.select(*[F.col(f"`{c}`") for c in kept]).unionByName(alone.select(*[F.col(f"`{c}`") for c in kept]))
