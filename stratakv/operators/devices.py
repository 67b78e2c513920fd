"""Devices as reports over their operations, and the states of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overwritten(ops: DataFrame) -> DataFrame:
    """(seq, page) of ops(seq, op, page, block): writes to a page that its block's last erase has not cleared since it was written."""
    before = Window.partitionBy("block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    erased = F.coalesce(F.max(F.when(F.col("op") == "ERASE", F.col("seq"))).over(before), F.lit(-1))
    writes = ops.withColumn("erased", erased).where("op = 'WRITE'")
    last = F.lag("seq").over(Window.partitionBy("page").orderBy("seq"))
    return writes.withColumn("last", last).where("last > erased").select("seq", "page")


def counts(ops: DataFrame) -> DataFrame:
    """(op, n): all that a device without storage does."""
    return ops.groupBy("op").agg(F.count("*").alias("n"))


def fan_out(requests: DataFrame) -> DataFrame:
    """(id, page, last) of requests(id, off, len) in pages; only the last page of a request is acknowledged."""
    rows = requests.where("len > 0").select("id", F.posexplode(F.sequence(F.col("off"), F.col("off") + F.col("len") - 1)).alias("at", "page"), "len")
    return rows.select("id", "page", (F.col("at") == F.col("len") - 1).alias("last"))


def block_states(valid: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block, state, invalid) of every one of blocks(block): FREE without pages, CLEAN without invalid ones, else DIRTY."""
    used = valid.groupBy("block").agg(F.count_if(~F.col("valid")).alias("invalid"))
    state = F.when(F.col("invalid").isNull(), "FREE").when(F.col("invalid") == 0, "CLEAN").otherwise("DIRTY")
    return blocks.join(used, "block", "left").select("block", state.alias("state"), F.coalesce("invalid", F.lit(0)).cast("long").alias("invalid"))


def page_status(writes: DataFrame, pages_per_segment: int, blocks: int) -> DataFrame:
    """(seg, blk, written, rewritten) of writes(lpa): block-mapped pages, and how often one was written again."""
    inside = F.col("lpa") % pages_per_segment
    rows = writes.select("lpa", F.floor(F.col("lpa") / pages_per_segment).cast("long").alias("seg"), (inside % blocks).cast("long").alias("blk"))
    return rows.groupBy("seg", "blk").agg(F.count_distinct("lpa").alias("written"), (F.count("*") - F.count_distinct("lpa")).alias("rewritten"))


def merge_blocks(valid: DataFrame, victims: DataFrame, base: int, pages: int) -> DataFrame:
    """(lpa, old_ppa, new_ppa): valid pages of each victim go to a new block, each at its own offset."""
    fresh = victims.select("block", (F.lit(base) + F.row_number().over(Window.orderBy("block")) - 1).alias("new_block"))  # a victim a parallel unit
    return valid.where("valid").join(F.broadcast(fresh), "block").select("lpa", F.col("ppa").alias("old_ppa"), (F.col("new_block") * pages + F.col("ppa") % pages).cast("long").alias("new_ppa"))


def pack_grains(valid: DataFrame, victims: DataFrame, grains: int) -> DataFrame:
    """(block, grain, new_page, slot): live grains of a victim, dense and in order."""
    place = F.row_number().over(Window.partitionBy("block").orderBy("ppa")) - 1
    rows = valid.where("valid").join(victims.select("block"), "block").withColumn("place", place)
    return rows.select("block", F.col("ppa").alias("grain"), F.floor(F.col("place") / grains).cast("long").alias("new_page"), (F.col("place") % grains).cast("long").alias("slot"))


def live_pages(valid: DataFrame, grains: int) -> DataFrame:
    """(page, live, n_live): whether a page of ``grains`` grains still holds a live one."""
    return valid.groupBy(F.floor(F.col("ppa") / grains).cast("long").alias("page")).agg(F.max("valid").alias("live"), F.count_if("valid").alias("n_live"))


def arrival_order(requests: DataFrame) -> DataFrame:
    """(unit, lpa, seq, turn): requests to one page of a unit are served in order of arrival."""
    turn = F.row_number().over(Window.partitionBy("unit", "lpa").orderBy("seq"))
    return requests.select("unit", "lpa", "seq", turn.cast("long").alias("turn"))
