"""Ordered access to keys: ranges, prefixes, bounds, pages of a cursor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import prefix_end


def range_scan(state: DataFrame, start, n: int, key: str = "key") -> DataFrame:
    """First n rows with key >= start, ascending."""
    return state.where(F.col(key) >= F.lit(start)).orderBy(key).limit(n)


def prefix_scan(state: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    """Rows whose key starts with the prefix, as a range of keys (which reaches the scan)."""
    end = prefix_end(prefix)
    rows = state.where(F.col(key) >= F.lit(prefix))
    return rows.where(F.col(key) < F.lit(end)) if end is not None else rows


def cursor_page(state: DataFrame, prefix: str, after: str, n: int, key: str = "key") -> DataFrame:
    """The next n rows of a prefix cursor."""
    return prefix_scan(state, prefix, key).where(F.col(key) > F.lit(after)).orderBy(key).limit(n)


def range_batch(state: DataFrame, starts: DataFrame, n: int, width: int) -> DataFrame:
    """(start, place, key) of the first n keys at or above each start, for state(key) and starts(start) of longs.

    Keys get a global position by counting buckets of ``width`` keys; a start's position is its bucket's first one
    plus the smaller keys of its bucket; then positions are joined for equality, never keys for inequality.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    keys = state.select("key").distinct().withColumn("b", bucket("key"))
    sizes = keys.groupBy("b").agg(F.count("*").alias("n")).select("b", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s"))
    placed = keys.join(sizes, "b").withColumn("p", F.col("s") + F.row_number().over(Window.partitionBy("b").orderBy("key")) - 1)
    # a start's first key lies in its own bucket or in the next one that has keys
    near = starts.withColumn("b", bucket("start")).join(keys.withColumnRenamed("key", "k"), "b", "left").groupBy("start", "b").agg(F.count_if(F.col("k") < F.col("start")).alias("smaller"))
    marks = sizes.select("b", F.col("s"), F.lit(1).alias("kind")).unionByName(near.select("b", F.lit(None).cast("long").alias("s"), F.lit(0).alias("kind")).distinct())
    ahead = Window.orderBy("b", F.col("kind").desc()).rowsBetween(0, Window.unboundedFollowing)
    at = marks.withColumn("at", F.first("s", ignorenulls=True).over(ahead))
    own = sizes.select("b", F.col("s").alias("own"))
    where = near.join(at.where("kind = 0").select("b", "at"), "b").join(own, "b", "left")
    first = F.when(F.col("own").isNotNull(), F.col("own") + F.col("smaller")).otherwise(F.col("at"))
    wanted = where.withColumn("f", first).where("f is not null").select("start", F.posexplode(F.sequence(F.col("f"), F.col("f") + n - 1)).alias("i", "p"))
    return wanted.join(placed.select("p", "key"), "p").select("start", (F.col("i") + 1).alias("place"), "key")


def bounds(keys: DataFrame, probes: DataFrame, width: int) -> DataFrame:
    """(probe, floor, lower): for longs, the greatest key <= probe and the least key >= probe; null if there is none."""
    b = lambda c: F.floor(F.col(c) / width)
    stats = keys.groupBy(b("key").alias("b")).agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    every = stats.select("b", "lo", "hi").unionByName(probes.select(b("probe").alias("b")).distinct().join(stats.select("b"), "b", "left_anti").select("b", F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi")))
    back = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy("b").rowsBetween(1, Window.unboundedFollowing)
    every = every.select("b", F.last("hi", ignorenulls=True).over(back).alias("prev"), F.first("lo", ignorenulls=True).over(ahead).alias("next"))
    inside = probes.withColumn("b", b("probe")).join(keys.select("key", b("key").alias("kb")), F.col("b") == F.col("kb"), "left")
    near = inside.groupBy("probe", "b").agg(F.max(F.when(F.col("key") <= F.col("probe"), F.col("key"))).alias("f"), F.min(F.when(F.col("key") >= F.col("probe"), F.col("key"))).alias("l"))
    return near.join(every, "b").select("probe", F.coalesce("f", "prev").alias("floor"), F.coalesce("l", "next").alias("lower"))
