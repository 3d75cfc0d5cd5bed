"""Mixing of sources to target weights by Sainte-Lague apportionment, in DataFrame operations.

Sizes are words. A source's target is its weight's share of the mix, at most ``most_copies``
times its own size, with the excess shared out again by weight. Each source is dealt into shards
of about ``shard_docs`` documents by a hash of the id; a shard's documents form a line of words
in seeded order, cut in blocks of equal length. The mix is a house of a fixed number of blocks,
given to sources by highest quotients: the block after j blocks of a source with the target v has
the quotient v / (2 j + 1). Shards share their source's quota by the same quotients. The divisor
that hands out the whole house is found by bisection over the votes, one array of numbers. A shard
takes all its blocks as often as its quota allows, and for the rest picks distinct blocks by a
seeded draw; no block is taken more than ``most_copies`` times.

The draw divides a shard's n blocks in as many strata as blocks are picked (or left out, if that
is fewer) and takes the block of each that a seeded hash names. It is evaluated for a document's
blocks only, so blocks never become rows. One shuffle deals documents to shards; no shard holds a
whole source. The tables of sources and shards are small beside the documents and are broadcast
only after they were counted; windows without a partition run over one row for each source.

Nulls: a null text has no words; a null source is a source of its own, last in order; rows with
null or repeated ids are rows of their own, and equal rows stand side by side in a line. Sources without words have
the target 0. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import durable

_BISECTIONS = 100
_BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most_copies: int = 2) -> DataFrame:
    """has_source, source_key, n_docs, source_size and target of every source.

    Sources in code-point order, null last, weigh ``weights``, repeating. Where the caps of the
    sources with the lowest cap for their weight are reached, they are filled in that order.
    """
    per = sizes.groupBy("has_source", "source_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # Windows over one row for each source, not for each document.
    by_name = Window.orderBy(F.desc("has_source"), "source_key")
    cycle = F.array(*(F.lit(w) for w in weights))
    weighed = per.withColumn("weight", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights))).withColumn("cap", most_copies * F.col("source_size"))
    everything = Window.partitionBy()
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.desc("has_source"), "source_key").rowsBetween(Window.unboundedPreceding, -1)
    rest = (
        weighed.withColumn("aim", F.sum("source_size").over(everything) * percent / 100)
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(filled), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), F.lit(0)))
        .withColumn("level", (F.col("aim") - F.col("cap_before")) / F.col("weight_left"))
        # The level of the first source that stays below its cap holds for all after it.
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("final", F.min(F.when(F.col("fits"), F.struct("cap_before", "level"))).over(everything)["level"])
    )
    target = F.when(F.col("final").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("final") * F.col("weight"), F.col("cap").cast("double")))
    return rest.select("has_source", "source_key", "n_docs", "source_size", target.alias("target"))


def _block_words(most: int) -> Column:
    """Words of a block: a thousandth of the smallest target, but not fewer than 8 nor more than ``most``."""
    smallest = F.min(F.when(F.col("target") > 0, F.col("target"))).over(Window.partitionBy())
    return F.greatest(F.lit(8), F.least(F.lit(most), F.coalesce(F.floor(smallest / 1000), F.lit(most)))).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most_copies: int = 2, seed: int = 17, shard_docs: int = 2_000, block_words: int = 256, extra: tuple[str, ...] = (), passages: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken (words that the mix takes) and ``extra`` of every document.

    With ``passages`` also ``passages``: the blocks picked besides whole copies, as (start, words) of the
    document's own words, in order. ``extra`` columns may not have the names of the others.
    """
    taken_names = {"doc_id", "size", "source_size", "target", "taken", "passages"} & set(extra)
    if taken_names:
        raise ValueError(f"columns of these names are made here: {sorted(taken_names)}")
    renamed = [F.col(c).alias(f"__x_{i}") for i, c in enumerate(extra)]
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").isNotNull().alias("has_source"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source_key"),
        word_count(F.col("text").cast("string")).alias("size"),
        *renamed,
    )
    if not extra:
        sized = durable(sized)
    key = ["has_source", "source_key"]
    sources = targets(sized, weights, percent, most_copies).withColumn("block", _block_words(block_words)).withColumn("n_shards", F.ceil(F.col("n_docs") / shard_docs))
    sources = durable(sources)
    small = F.broadcast(sources) if sources.count() <= _BROADCAST_SOURCES else sources

    draw = F.xxhash64(F.lit(seed), F.col("doc_id"))
    dealt = sized.join(small, key).withColumn("draw", draw).withColumn("shard", F.pmod(F.shiftrightunsigned("draw", 20), F.col("n_shards")))
    shards = dealt.groupBy(*key, "shard").agg(F.sum("size").alias("shard_size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("block").alias("block"))
    quotas = durable(_quotas(shards, key, most_copies, seed))
    quotas = F.broadcast(quotas) if quotas.count() <= _BROADCAST_SOURCES else quotas

    line = Window.partitionBy(*key, "shard").orderBy("draw", "doc_id", "size")
    placed = dealt.withColumn("end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("begin", F.col("end") - F.col("size"))
    with_quota = placed.join(quotas.select(*key, "shard", "n_blocks", "shard_size", "whole", "part", "draws"), [*key, "shard"])
    # Block b covers the words from floor(b S / n) to floor((b + 1) S / n) of its shard's line.
    first = F.floor(F.col("begin") * F.col("n_blocks") / F.col("shard_size"))
    last = F.least(F.col("n_blocks") - 1, F.floor(F.col("end") * F.col("n_blocks") / F.col("shard_size")))
    edge = lambda b: F.floor(b * F.col("shard_size") / F.col("n_blocks")).cast("double")

    # The strata are cut for the smaller of the blocks picked and the blocks left out.
    few = F.least(F.col("part"), F.col("n_blocks") - F.col("part"))

    def picked(b: Column) -> Column:
        x = (b + 1) * few - 1
        stratum = ((x - F.pmod(x, F.col("n_blocks"))) / F.col("n_blocks")).cast("long")
        begins = F.floor(stratum * F.col("n_blocks") / few)
        size = F.floor((stratum + 1) * F.col("n_blocks") / few) - begins
        named = (few > 0) & (b == begins + F.pmod(F.xxhash64(F.col("draws"), stratum), size))
        return named == (F.col("part") <= F.col("n_blocks") - F.col("part"))

    overlap = lambda b: F.greatest(F.lit(0.0), F.least(F.col("end").cast("double"), edge(b + 1)) - F.greatest(F.col("begin").cast("double"), edge(b)))
    blocks = F.sequence(F.greatest(F.lit(0), first - 1), F.greatest(F.lit(0), last))
    partial = F.aggregate(blocks, F.lit(0.0), lambda s, b: s + F.when(picked(b), overlap(b)).otherwise(0.0))
    taken = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("whole") * F.col("size") + F.when(F.col("part") > 0, partial).otherwise(0.0)).cast("long")
    found = ["doc_id", "size", "source_size", "target", taken.alias("taken"), *(F.col(f"__x_{i}").alias(c) for i, c in enumerate(extra))]
    if passages:
        own = F.filter(blocks, lambda b: picked(b) & (overlap(b) > 0))
        cut = F.transform(own, lambda b: F.struct((F.greatest(F.col("begin").cast("double"), edge(b)) - F.col("begin")).cast("int").alias("start"), overlap(b).cast("int").alias("words")))
        none = F.expr("cast(array() as array<struct<start:int,words:int>>)")
        found.append(F.when((F.col("size") > 0) & (F.col("part") > 0), cut).otherwise(none).alias("passages"))
    return with_quota.select(*found)


def _seats(votes: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``votes`` (vote, house and others) with seats: ``house`` of each group, given by highest quotients.

    A divisor d gives round(vote / d) seats; the smallest that gives no more than the house is
    bisected, and seats that are then left, of equal quotients, go in the given order.
    """
    lists = votes.groupBy(*group).agg(F.collect_list("vote").alias("votes"), F.max("house").alias("most"))
    given = lambda d: F.aggregate("votes", F.lit(0.0), lambda s, v: s + F.floor(v / d + 0.5))

    def halve(range_: Column, _: Column) -> Column:
        middle = (range_["low"] + range_["high"]) / 2
        fits = F.array(F.struct(middle.alias("at"), (given(middle) <= F.col("most")).alias("fits")))
        return F.get(F.transform(fits, lambda f: F.struct(F.when(f["fits"], range_["low"]).otherwise(f["at"]).alias("low"), F.when(f["fits"], f["at"]).otherwise(range_["high"]).alias("high"))), F.lit(0))

    # The lowest divisor gives more than the house, and one above twice the highest vote gives no seat.
    total = F.aggregate("votes", F.lit(0.0), lambda s, v: s + v)
    start = F.struct((total / (2 * F.col("most") + F.size("votes") + 2)).alias("low"), (2.5 * F.array_max("votes") + 1e-9).alias("high"))
    steps = F.sequence(F.lit(1), F.lit(_BISECTIONS))
    divisor = lists.select(*group, F.aggregate(steps, start, halve, lambda r: r["high"]).alias("divisor"))
    held = votes.join(divisor, group).withColumn("seats", F.floor(F.col("vote") / F.col("divisor") + 0.5))
    each = Window.partitionBy(*group)
    left = held.withColumn("left", F.col("house") - F.sum("seats").over(each))
    next_ = F.row_number().over(each.orderBy(F.desc(F.col("vote") / (2 * F.col("seats") + 1)), *order))
    return left.withColumn("seats", (F.col("seats") + F.when(next_ <= F.col("left"), 1).otherwise(0)).cast("long")).drop("divisor", "left")


def _quotas(shards: DataFrame, key: list[str], most_copies: int, seed: int) -> DataFrame:
    """Each shard's blocks and how many of them the mix takes, whole rounds and a part."""
    n_blocks = F.when(F.col("shard_size") == 0, 0).otherwise(F.greatest(F.lit(1), F.round(F.col("shard_size") / F.col("block")))).cast("long")
    per_shard = shards.withColumn("n_blocks", n_blocks)
    real = per_shard.groupBy(*key).agg(F.sum("n_blocks").alias("source_blocks"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    # What is due to a source in its own blocks, whose length is its words by its number of blocks.
    due = F.when(F.col("source_size") > 0, F.col("target") * F.col("source_blocks") / F.col("source_size")).otherwise(0.0)
    house = F.round(F.sum(due).over(Window.partitionBy())).cast("long")
    quota = _seats(real.select(*key, due.alias("vote"), house.alias("house"), F.lit(1).alias("all")), ["all"], [F.desc("has_source"), "source_key"]).select(*key, F.col("seats").alias("house"))
    voted = per_shard.join(quota, key).withColumn("vote", F.col("n_blocks").cast("double"))
    seated = _seats(voted, key, ["shard"]).withColumn("taken_blocks", F.least(most_copies * F.col("n_blocks"), F.col("seats")))
    whole = F.when(F.col("n_blocks") > 0, F.floor(F.col("taken_blocks") / F.col("n_blocks"))).otherwise(0).cast("long")
    return seated.withColumn("whole", whole).select(
        *key, "shard", "shard_size", "n_blocks", "whole",
        (F.col("taken_blocks") - F.col("whole") * F.col("n_blocks")).cast("long").alias("part"),
        F.xxhash64(F.lit(seed), *key, "shard").alias("draws"),
    )
