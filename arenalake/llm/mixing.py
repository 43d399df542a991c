"""Mixing sources to target weights by Sainte-Lague apportionment.

A source's documents form a stream of tokens (words), cut into blocks of equally many tokens; the stream is dealt over
shards of bounded size, so a source that holds a third of all rows is many shards.  Blocks are allocated to sources by
the highest quotients target / (2 k + 1), then each source's blocks to its shards in the same way, which gives integer
quotas; a seeded order selects the blocks within a shard.  A quota above a shard's block count repeats whole passes.

Only sizes are shuffled, never texts.  Each row is a document; null or blank texts have size 0 and nothing is taken of
them; a null source is a source of its own, after all others; rows with equal id and size are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, words

BLOCK = 64  #: tokens in a block
SHARD_TOKENS = 1 << 20  #: a source is dealt over shards of about so many tokens, all sources over 64 at least
MOST = 3  #: a source, and so a document, is taken so many times at most
SEED = 20240601


def targets(sizes: DataFrame) -> DataFrame:
    """(key, source, source_size) -> the same with ``target``: shares by weight 1, 2, 3, ..., stopped at MOST times the size.

    With sources in the order of cap / weight, each source's level is what remains after the caps before it, by weight;
    the largest level is the common one, so no loop is needed.  One row a source passes through a single task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    one = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double")).withColumn("cap", F.col("source_size") * float(MOST))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    level = one.withColumn("level", (F.sum("source_size").over(everything) - before) / rest)
    return level.withColumn("target", F.least("cap", F.col("weight") * F.max("level").over(everything))).select("key", "source", "source_size", "target")


def apportion(items: DataFrame, group: list[str], item: str, votes: Column, seats: Column) -> DataFrame:
    """``items`` with ``quota``: the ``seats`` of each group allocated by the highest quotients votes / (2 k + 1).

    Two bounds on the last winning quotient decide nearly all seats at once; only some 3 quotients an item are ranked.
    Ties go to the smaller item.
    """
    all_ = Window.partitionBy(*group)
    x = items.withColumn("_v", votes.cast("double")).withColumn("_n", seats.cast("double"))
    x = x.withColumn("_sum", F.sum("_v").over(all_)).withColumn("_count", F.count("*").over(all_))
    at = lambda c: F.when((F.col("_sum") > 0) & (c > 0), F.floor(F.col("_v") * c / (2 * F.col("_sum")) + 0.5)).otherwise(0)
    x = x.withColumn("_sure", F.greatest(at(2 * F.col("_n") - F.col("_count")) - 1, F.lit(0)))
    x = x.withColumn("_most", F.when(F.col("_v") > 0, at(2 * F.col("_n") + F.col("_count")) + 1).otherwise(0))
    x = x.withColumn("_open", F.col("_n") - F.sum("_sure").over(all_))
    key = [*group, item]
    last = x.filter(F.col("_most") > F.col("_sure")).select(*key, "_v", "_open", F.explode(F.sequence(F.col("_sure"), F.col("_most") - 1)).alias("_k"))
    ranked = last.withColumn("_rank", F.row_number().over(all_.orderBy((F.col("_v") / (2 * F.col("_k") + 1)).desc(), item, "_k")))
    won = ranked.filter(F.col("_rank") <= F.col("_open")).groupBy(*key).agg(F.count("*").alias("_won"))
    return x.join(won, key, "left").withColumn("quota", (F.col("_sure") + F.coalesce("_won", F.lit(0))).cast("long")).select(*items.columns, "quota")


def mix(docs: DataFrame, text: str = "text", source: str = "source", seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target and taken, one row a document."""
    key = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("-"))
    sized = materialize(docs.select("doc_id", F.col(source).alias("source"), key.alias("key"), F.size(words(F.col(text))).cast("long").alias("size")), "sizes")
    total = sized.agg(F.sum("size")).first()[0] or 0
    n_shards = max(64, -(-total // SHARD_TOKENS))
    dealt = sized.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.lit(n_shards)))

    shards = dealt.groupBy("key", "source", "shard").agg(F.sum("size").alias("tokens"))
    sizes = shards.groupBy("key", "source").agg(F.sum("tokens").alias("source_size"))
    aimed = targets(sizes)
    given = apportion(aimed, [], "key", F.col("target"), F.lit(round(total / block)))
    given = materialize(given.withColumn("given", F.least("quota", MOST * F.ceil(F.col("source_size") / block))).drop("quota"), "targets")

    earlier = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.withColumn("offset", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)))
    first = F.ceil(F.col("offset") / block)
    placed = placed.select("key", "shard", "offset", first.alias("first"), (F.ceil((F.col("offset") + F.col("tokens")) / block) - first).alias("n_blocks"))
    quotas = apportion(placed.join(given.select("key", "given"), "key"), ["key"], "shard", F.col("n_blocks"), F.col("given"))
    quotas = materialize(quotas.withColumn("quota", F.least("quota", MOST * F.col("n_blocks"))), "quotas")

    blocks = quotas.filter("quota > 0").select("key", "shard", "n_blocks", "quota", F.explode(F.sequence("first", F.col("first") + F.col("n_blocks") - 1)).alias("b"))
    turn = F.row_number().over(Window.partitionBy("key", "shard").orderBy(F.xxhash64(F.lit(seed), "key", "b"), "b"))
    times = F.floor(F.col("quota") / F.col("n_blocks")) + F.when(turn <= F.col("quota") % F.col("n_blocks"), 1).otherwise(0)
    chosen = blocks.select("key", "b", times.alias("times")).filter("times > 0")

    run = Window.partitionBy("key", "shard").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    spots = dealt.filter("size > 0").withColumn("before", F.coalesce(F.sum("size").over(run), F.lit(0)))
    spots = spots.join(quotas.select("key", "shard", "offset"), ["key", "shard"]).withColumn("start", F.col("before") + F.col("offset")).select("key", "doc_id", "source", "size", "start")
    # each document meets the blocks it touches; the shared part counts as often as the block is taken
    parts = spots.select("key", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("b"))
    shared = F.least(F.col("start") + F.col("size"), (F.col("b") + 1) * block) - F.greatest("start", F.col("b") * block)
    taken = parts.join(chosen.hint("merge"), ["key", "b"]).groupBy("key", "start").agg(F.sum(shared * F.col("times")).alias("taken"))

    empty = sized.filter("size = 0").select("key", "doc_id", "source", "size", F.lit(0).cast("long").alias("taken"))
    every = spots.join(taken, ["key", "start"], "left").select("key", "doc_id", "source", "size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    out = every.unionByName(empty).join(F.broadcast(given) if given.count() <= 100_000 else given, "key")
    return out.select("doc_id", every["source"], "size", "source_size", "target", "taken")
