"""Space management: block statistics, victims, relocation, bad blocks, extents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def block_stats(valid: DataFrame) -> DataFrame:
    return valid.groupBy("block").agg(F.count("*").alias("pages"), F.count_if(~F.col("valid")).alias("invalid"), F.min("ppa").alias("born"))


def greedy(stats: DataFrame, units: int, live: bool = False) -> DataFrame:
    """(unit, block, invalid): for each parallel unit the block with most invalid pages, the first on ties; with ``live``, its valid pages too."""
    best = F.max(F.struct("invalid", (-F.col("block")).alias("b"), "pages"))
    more = [(F.col("x.pages") - F.col("x.invalid")).alias("live")] if live else []
    return stats.groupBy((F.col("block") % units).alias("unit")).agg(best.alias("x")).select("unit", (-F.col("x.b")).alias("block"), F.col("x.invalid").alias("invalid"), *more)


def oldest(stats: DataFrame, units: int) -> DataFrame:
    """(unit, block): first in, first out."""
    return stats.groupBy((F.col("block") % units).alias("unit")).agg(F.min(F.struct("born", "block")).alias("x")).select("unit", F.col("x.block").alias("block"))


def relocate(valid: DataFrame, victims: DataFrame, reserve: int) -> DataFrame:
    """(lpa, old_ppa, new_ppa): valid pages of victims(block, live) move to the reserve in address order of each victim, a block a parallel unit."""
    base = victims.select("block", F.coalesce(F.sum("live").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("block").orderBy("ppa")) - 1
    return valid.where("valid").join(base, "block").withColumn("place", place).select("lpa", F.col("ppa").alias("old_ppa"), (F.lit(reserve) + F.col("base") + F.col("place")).cast("long").alias("new_ppa"))


def remap(mapping: DataFrame, moves: DataFrame) -> DataFrame:
    """The mapping after a collection."""
    new = moves.select(F.col("old_ppa").alias("ppa"), "new_ppa")
    return mapping.join(new, "ppa", "left").select("lpa", F.coalesce("new_ppa", "ppa").alias("ppa"))


def trim(pages: DataFrame, victims: DataFrame) -> DataFrame:
    return pages.join(victims.select("block"), "block", "left_anti")


def pair_bad_blocks(blocks: DataFrame) -> DataFrame:
    """(bad, replacement) of blocks(block, bad): the n-th bad block gets the n-th good one from the end."""
    bad = blocks.where("bad").select(F.col("block").alias("bad_block"), F.row_number().over(Window.orderBy("block")).alias("n"))
    good = blocks.where("not bad").select(F.col("block").alias("replacement"), F.row_number().over(Window.orderBy(F.desc("block"))).alias("n"))
    return bad.join(good, "n", "left").select("bad_block", "replacement")


def extents(addresses: DataFrame, most: int = 32768) -> DataFrame:
    """(file, start, length): runs of consecutive addresses(file, lba), none longer than ``most``."""
    place = F.row_number().over(Window.partitionBy("file").orderBy("lba"))
    islands = addresses.distinct().withColumn("island", F.col("lba") - place)
    first = islands.groupBy("file", "island").agg(F.min("lba").alias("s"), F.count("*").alias("n"))
    cut = first.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / most).cast("int"))))
    return cut.select("file", (F.col("s") + F.col("k") * most).alias("start"), F.least(F.lit(most), F.col("n") - F.col("k") * most).cast("long").alias("length"))


def trigger(stats: DataFrame, blocks: int, percent: int = 20) -> DataFrame:
    """(free, needed, exhausted): collection starts when at most ``percent`` of all blocks are free."""
    used = stats.agg(F.count("*").alias("used")).select((F.lit(blocks) - F.col("used")).alias("free"))
    return used.select("free", (F.col("free") * 100 / blocks <= percent).alias("needed"), (F.col("free") <= 0).alias("exhausted"))


def swap_reserve(victims: DataFrame, reserve: int) -> DataFrame:
    """(unit, active, reserve): a unit's reserve takes the survivors, and its erased victim is the next reserve."""
    return victims.select("unit", (F.lit(reserve) + F.col("unit")).alias("active"), F.col("block").alias("reserve"))


def translation_updates(moves: DataFrame, entries: int) -> DataFrame:
    """(tpage, n): translation pages that a collection must read and write again, and the mappings that change in each."""
    return moves.groupBy(F.floor(F.col("lpa") / entries).cast("long").alias("tpage")).agg(F.count("*").alias("n"))


def lsm_data_updates(moves: DataFrame, found: DataFrame) -> DataFrame:
    """(level, run, n) of moves(key) and found(key, level, run): headers that a collection of values must write again."""
    return moves.join(found, "key").groupBy("level", "run").agg(F.count("*").alias("n"))
