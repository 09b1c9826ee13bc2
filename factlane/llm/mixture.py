"""Mixing sources to target weights, with DataFrame operations alone.

The words of each source, its documents in a fixed order, are one stream cut into blocks of ``block`` words.
The sources' targets are water-filled: weights are honoured up to ``most`` times a source's size.  Output shards
of ``shard`` slots draw their source counts at random: a pseudorandom permutation (swap-or-not rounds) sends the
slots of all shards to the sources' slots, which lie end to end, so a shard's counts are a multinomial draw given the
sums over all shards, and those are the targets.  A source's slots are mapped epoch by epoch through a
pseudorandom permutation of its block numbers, so between two epochs no block is used twice more than another.
Slots are then joined to blocks, and blocks to documents, by block number.

Sizes and offsets are summed in two steps over hash ranges of documents, so a source that holds most rows is
never in one task.  Everything is a function of ids, texts and the seed: reruns agree.

A text of any length is counted whole and may lie in many blocks.  A null text has no words; a null source is a source of its own, the last.  Rows that repeat a doc_id are
documents of their own (equal ones are told apart by number).  A source without words has no target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import partitions, stored

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
BLOCK = 64
SHARD = 1024
ROUNDS = 24
#: Documents of a hash range that are numbered together.
RANGE_DOCS = 4096


def words(text: Column) -> Column:
    """The number of runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) with rank, weight and target: all words shared by weight, none above most times its size.

    With the sources in ascending order of cap / weight, the first whose share of what is left, by weight, is under its
    cap sets the level; those before it get their caps.  One row per source.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    choice = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(choice, (F.col("rank") % len(weights) + 1).cast("int")))
    full = F.col("source_size") * float(most)
    order = Window.partitionBy(F.lit(0)).orderBy("ratio", "rank")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    filled = (ranked.withColumn("cap", full).withColumn("ratio", F.col("cap") / F.col("weight"))
              .withColumn("total", F.sum("source_size").over(whole))
              .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
              .withColumn("water", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(whole)))
    return filled.select("source", "source_size", "rank", "weight", F.least("cap", F.col("water.level") * F.col("weight")).alias("target"))


def permuted(index: Column, n: Column, *key: Column, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0..n-1 chosen by key: swap-or-not rounds, each an involution of pairs."""

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(r, F.lit("pivot"), *key), n) - x + n, n)
        coin = F.pmod(F.xxhash64(r, F.greatest(x, other), *key), F.lit(2)) == 1
        return F.when(coin, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index.cast("long"), swap)


class Mix:
    """The tables of one mix; build with ``mix``."""

    def __init__(self, docs: DataFrame, sources: DataFrame, slots: DataFrame, block: int):
        self.docs, self.sources, self.slots, self.block = docs, sources, slots, block

    def taken(self) -> DataFrame:
        """doc_id, source, size, source_size, target and taken for each document."""
        uses = self.slots.groupBy("rank", "block").agg(F.count(F.lit(1)).alias("uses"))
        last = ((F.col("start") + F.col("size") - 1) / self.block).cast("long")
        pieces = (self.docs.where("size > 0").select("no", "rank", "start", "size", F.explode(F.sequence((F.col("start") / self.block).cast("long"), last)).alias("block"))
                  .withColumn("words", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * self.block) - F.greatest("start", F.col("block") * self.block)))
        got = pieces.join(uses, ["rank", "block"]).groupBy("no").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
        told = self.docs.join(self.sources.select("rank", "source_size", "target"), "rank").join(got, "no", "left")
        return told.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, shard: int = SHARD, seed: int = 7) -> Mix:
    """Mix (doc_id, text, source); slots are (shard, slot, rank, block): the block of that source in that place of the output."""
    spark = docs.sparkSession
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text").cast("string")).alias("size"),
                        F.xxhash64("text").alias("digest"))
    sized = stored(sized, "mix-sizes")
    ranges = max(partitions(spark), sized.count() // RANGE_DOCS + 1)
    spread = sized.withColumn("range", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(ranges)))
    order = Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last(), F.col("doc_id").asc_nulls_last(), "digest")
    inner = Window.partitionBy("range", "source").orderBy(F.col("doc_id").asc_nulls_last(), "digest").rowsBetween(Window.unboundedPreceding, -1)
    local = (spread.withColumn("row", F.row_number().over(order)).withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0)))
             .withColumn("no", F.col("row") * F.lit(ranges) + F.col("range")))
    parts = spread.groupBy("source", "range").agg(F.sum("size").alias("part"))
    sizes = parts.groupBy("source").agg(F.sum("part").alias("source_size"))
    sources = stored(targets(sizes, weights, most), "mix-sources")
    prior = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begin = parts.withColumn("before", F.coalesce(F.sum("part").over(prior), F.lit(0)))
    same = lambda a, b: a.eqNullSafe(b)
    begin = begin.join(sources.select(F.col("source").alias("name"), "rank"), same(F.col("source"), F.col("name"))).select("source", "range", "rank", "before")
    on = same(local["source"], begin["source"]) & (local["range"] == begin["range"])
    numbered = stored(local.join(begin, on).select("no", "doc_id", local["source"], "rank", "size", (F.col("before") + F.col("inside")).alias("start")), "mix-docs")
    return Mix(numbered, sources, stored(slots(spark, sources, most, block, shard, seed), "mix-slots"), block)


#: Slots of a task.
TASK_SLOTS = 50_000


def slots(spark: SparkSession, sources: DataFrame, most: int, block: int, shard: int, seed: int) -> DataFrame:
    """The slots of all shards, from the sources' targets alone.

    Slots that would begin a source's epoch number ``most`` (one, where a target is at its cap and was rounded up) stay
    empty, so no block is ever used more than ``most`` times.
    """
    upto = Window.partitionBy(F.lit(0)).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    plan = (sources.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
            .withColumn("wanted", F.col("target") * F.col("blocks") / F.col("source_size"))  # slots, as the last block is short
            .withColumn("high", F.round(F.sum("wanted").over(upto)).cast("long")).withColumn("low", F.round(F.sum("wanted").over(upto) - F.col("wanted")).cast("long")))
    told = plan.agg(F.max("high").alias("n"), F.count(F.lit(1)).alias("sources")).first()
    needed, bins = told["n"] or 0, max(1024, told["sources"])
    width = needed // bins + 1
    place = permuted(F.col("id"), F.lit(max(1, needed)), F.lit(seed), F.lit("slots"))
    each = (spark.range(0, needed, 1, max(partitions(spark), needed // TASK_SLOTS + 1))
            .select(F.floor(F.col("id") / shard).alias("shard"), (F.col("id") % shard).alias("slot"), place.alias("place"))
            .withColumn("bin", F.floor(F.col("place") / width)))
    parts = plan.select("rank", "blocks", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))).alias("bin"))
    drawn = (each.join(stored(parts, "mix-parts"), "bin")  # stored, so that its size is known and decides how they are joined
             .where((F.col("place") >= F.col("low")) & (F.col("place") < F.col("high"))).withColumn("n", F.col("place") - F.col("low")))
    numbered = (drawn.withColumn("epoch", F.floor(F.col("n") / F.col("blocks"))).withColumn("index", F.col("n") - F.col("epoch") * F.col("blocks"))
                .where(F.col("epoch") < most))
    chosen = permuted(F.col("index"), F.col("blocks"), F.lit(seed), F.col("rank"), F.col("epoch"))
    return numbered.select("shard", "slot", "rank", chosen.alias("block"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).taken()
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
