"""Operation logs, traces and page writes derived from the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import encode_key
from ..plans.runtime import ordinal, table


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, ts, key, op, val, vlen) from events."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    op = F.when(kind.isin("purchase", "signup"), "SET").when(kind.isin("view", "click"), "GET").otherwise("DELETE")
    return e.select(F.col("event_id").alias("seq"), "ts", encode_key("user_id").alias("key"), op.alias("op"), F.col("value").alias("val"), (F.floor(F.col("value") * 16) % 8192 + 1).cast("long").alias("vlen"))


def iolog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, lreq, type_ftl, type_lower, latency_us): device requests from events."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("event_type").alias("lreq"), (F.col("user_id") % 4).cast("int").alias("type_ftl"), (F.col("event_id") % 2).cast("int").alias("type_lower"), F.floor(F.col("value") * 100).cast("long").alias("latency_us"))


def block_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rw, off, len): 1 writes, 2 reads."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", 1).otherwise(2).alias("rw"), F.col("l_partkey").alias("off"), F.least(F.col("l_quantity").cast("int"), F.lit(8)).alias("len"))


def page_writes(spark: SparkSession, sf_dir: str, pages_per_block: int = 64) -> DataFrame:
    """(ppa, lpa, block): logical pages written in order; the ordinal is the physical address."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    width = max(1, int((li.agg(F.max("l_orderkey")).first()[0] or 0) // 4096))
    numbered = ordinal(li, F.floor(F.col("l_orderkey") / width), ["l_orderkey", "l_linenumber", "l_partkey"], "ppa")
    return numbered.select("ppa", F.col("l_partkey").alias("lpa"), F.floor(F.col("ppa") / pages_per_block).cast("long").alias("block"))


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(level, key, ppa): orders as sorted levels, newer ones above; a key once a level, its latest order."""
    o = table(spark, sf_dir, "orders")
    year = F.year("o_orderdate")
    level = F.when(year >= 1997, 0).when(year >= 1995, 1).otherwise(2)
    return o.withColumn("level", level).groupBy("level", F.col("o_custkey").alias("key")).agg(F.max("o_orderkey").alias("ppa"))
