"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, fresh, settle


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cap: float = 3.0) -> DataFrame:
    """``source, source_size`` -> adds ``weight, target``.

    Sources by code point, null last, weigh 1, 2, 3, repeating. Targets share the total size by weight;
    none exceeds ``cap`` times its source's size, and what is over goes to the others by weight until
    none is above: with sources by rising ``cap * size / weight``, the first so many are at their cap and
    the rest share what remains. One row per source goes through one window: sources are few beside
    documents. Sources of size 0 get target 0.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", (F.pmod(F.row_number().over(order) - 1, F.lit(3)) + 1).cast("double")).withColumn("top", F.lit(float(cap)) * F.col("source_size"))
    fill = Window.orderBy(F.col("top") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        ranked.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("top").over(before), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("rate", F.col("left") / F.col("rest"))
        .withColumn("open", F.col("top") >= F.col("rate") * F.col("weight"))
    )
    # the first source that is not at its cap sets the rate for all after it
    rate = F.first(F.when(F.col("open"), F.col("rate")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = level.withColumn("rate", F.coalesce(rate, F.lit(float("inf"))))
    return out.select("source", "source_size", "weight", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least("top", F.col("rate") * F.col("weight"))).alias("target"))


def apportion(claims: DataFrame, by: list[str], ties: list[str], weight: str, seats: str) -> DataFrame:
    """Adds ``won``: how many of the ``seats`` of its group ``by`` (a column that is equal within the group)
    Sainte-Lague gives to each claim, by highest quotient weight / (2k + 1), ties by ``ties`` and k.
    ``by`` and ``ties`` together name a claim; claims of weight 0 win nothing and go.

    With W the weights of all m claims together, every quotient of at least W / (2 * seats - m) wins and
    none below W / (2 * seats + m) does. So each claim has seats that are certain, and only about 2m bids
    of a group are ranked, however many seats there are.
    """
    group = Window.partitionBy(*by)
    n, m, whole = F.col(seats), F.count("*").over(group), F.sum(weight).over(group)
    wins = lambda limit: F.floor((F.col(weight) * limit / whole + 1) / 2)  # noqa: E731  quotients at or above whole / limit
    # one bid more at each end, for rounding
    held = claims.filter(F.col(weight) > 0).withColumn("_sure", F.greatest(F.lit(0), wins(2 * n - m) - 1).cast("long")).withColumn("_most", (wins(2 * n + m) + 1).cast("long"))
    held = held.withColumn("_open", n - F.sum("_sure").over(group))
    bids = held.withColumn("_k", F.explode(F.sequence("_sure", "_most"))).withColumn("_quotient", F.col(weight) / (2 * F.col("_k") + 1))
    rank = F.row_number().over(group.orderBy(F.col("_quotient").desc(), *[F.col(c).asc_nulls_last() for c in ties], "_k"))
    won = bids.withColumn("_rank", rank).groupBy(*by, *ties).agg(*[F.first(c).alias(c) for c in claims.columns if c not in (*by, *ties)], (F.first("_sure") + F.sum((F.col("_rank") <= F.col("_open")).cast("long"))).alias("won"))
    return won.select(*claims.columns, "won")


def mix_sources(docs: DataFrame, block: int = 32, shard_blocks: int = 4096, seed: int = 7, cap: int = 3, most_shards: int = 4096) -> DataFrame:
    """Adds ``size, source_size, target, taken`` to ``docs`` (columns doc_id, text, source, others kept).

    Sainte-Lague gives the blocks of ``block`` words that all targets make to the sources, with the targets
    as weights, so that each source's blocks come within one of its target. A source's documents are dealt
    by a seeded digest into shards of about ``shard_blocks`` blocks (at most ``most_shards``), and its
    blocks go to its shards in the same way by their words. A shard's quota becomes words: whole passes over its
    documents, and then a run of blocks from the start of a seeded order; the document where the quota
    ends is taken in part. ``taken`` counts words with repeats and never exceeds ``cap`` times the size.

    Only (source, order key, size) of each document is sorted; texts stay where they are, and what each
    shard takes comes to them as a table of one row a shard, broadcast where Spark sees that it is small.
    The same input gives the same mix. Null text: size 0, taken 0; null source: a source of its own; rows
    with equal doc_id and text share evenly what is taken of them, rounded down; empty tables give no
    rows; columns named like the added ones are replaced.
    """
    docs = docs.select(*[c for c in docs.columns if c not in ("size", "source_size", "target", "taken")])
    # a key of the source that joins as it is, and the place in the seeded order
    source_key, place = fresh(docs, "source_key", "place")
    keyed = docs.withColumn("size", n_words(F.col("text"))).withColumn(source_key, F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    keyed = keyed.withColumn(place, F.concat(digest, F.hex(F.xxhash64("text"))))
    shard_of = lambda c, n: F.pmod(F.conv(F.substring(c, 1, 8), 16, 10).cast("long"), n)

    small = settle(keyed.select(F.col(source_key).alias("s"), "source", F.col(place).alias("place"), "size"), "sizes")
    targets = source_targets(small.groupBy("source").agg(F.sum("size").alias("source_size")), cap)
    targets = targets.withColumn("s", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")))
    targets = targets.withColumn("shards", F.least(F.lit(most_shards), F.greatest(F.lit(1), F.ceil(F.col("source_size") / (block * shard_blocks)))).cast("long"))
    # one row for each source: few beside documents
    targets = settle(targets.select("s", "source_size", "target", "shards"), "targets")
    all_seats = F.round(F.sum("target").over(Window.partitionBy("one").orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) / block)
    given = apportion(targets.withColumn("one", F.lit(1)).withColumn("seats", all_seats.cast("long")), ["one"], ["s"], "target", "seats").select("s", F.col("won").alias("blocks"))

    rows = small.select("s", "place", "size").join(targets.select("s", "shards"), "s").withColumn("shard", shard_of("place", F.col("shards")))
    cells = rows.groupBy("s", "shard").agg(F.sum("size").alias("cell_size")).join(given, "s")
    quotas = apportion(cells, ["s"], ["shard"], "cell_size", "blocks").withColumn("words", F.least(F.col("won") * block, F.col("cell_size") * cap))
    quotas = quotas.select("s", "shard", F.floor(F.col("words") / F.col("cell_size")).alias("passes"), (F.col("words") % F.col("cell_size")).alias("rest"))
    # the document where the rest of each quota ends; rows with its key share what is left
    order = Window.partitionBy("s", "shard").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.withColumn("upto", F.sum("size").over(order)).withColumn("peers", F.sum("size").over(Window.partitionBy("s", "shard", "place")))
    ends = run.join(quotas, ["s", "shard"]).filter("rest > 0 and upto >= rest and upto - peers < rest").groupBy("s", "shard").agg(
        F.min("place").alias("end"), F.first("peers").alias("peers"), (F.first("rest") - F.first("upto") + F.first("peers")).alias("part"))
    cuts = settle(quotas.join(ends, ["s", "shard"], "left").select("s", "shard", "passes", "end", "peers", "part"), "cuts")

    names = fresh(keyed, "s_", "shards_", "c_", "shard_", "passes_", "end_", "peers_", "part_")
    s, shards, c, shard, passes, end, peers, part = names
    out = keyed.join(targets.select(F.col("s").alias(s), "source_size", "target", F.col("shards").alias(shards)), F.col(source_key) == F.col(s), "left")
    cuts = cuts.select(*[F.col(x).alias(y) for x, y in zip(("s", "shard", "passes", "end", "peers", "part"), names[2:], strict=True)])
    out = out.join(cuts, (F.col(source_key) == F.col(c)) & (shard_of(place, F.col(shards)) == F.col(shard)), "left")
    last = F.when(F.col(place) < F.col(end), F.col("size")).when(F.col(place) == F.col(end), F.floor(F.col("size") * F.col(part) / F.col(peers))).otherwise(F.lit(0))
    taken = F.coalesce(F.col(passes) * F.col("size") + last, F.lit(0)).cast("long")
    return out.select(*[F.col(f"`{x}`") for x in docs.columns], "size", "source_size", "target", taken.alias("taken"))
