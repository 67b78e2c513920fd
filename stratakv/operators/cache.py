"""Caches and write buffers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_batches(log: DataFrame, size: int = 256) -> DataFrame:
    """(batch, n, keys): sets gathered into buffers of ``size`` sequence numbers."""
    sets = log.where("op = 'SET'").withColumn("batch", F.floor(F.col("seq") / size).cast("long"))
    return sets.groupBy("batch").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


def buffer_hits(log: DataFrame, size: int = 256) -> DataFrame:
    """(op, n, hits): requests whose key was set earlier in the same buffer."""
    batch = F.floor(F.col("seq") / size)
    earlier = Window.partitionBy("key", batch).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    hit = F.coalesce(F.max((F.col("op") == "SET").cast("int")).over(earlier), F.lit(0))
    return log.withColumn("hit", hit).groupBy("op").agg(F.count("*").alias("n"), F.sum("hit").cast("long").alias("hits"))


def last_page_hits(reads: DataFrame) -> DataFrame:
    """(unit, n, hits) of reads(unit, seq, page): a read of the page read just before costs nothing."""
    same = F.lag("page").over(Window.partitionBy("unit").orderBy("seq")) == F.col("page")
    return reads.withColumn("hit", F.coalesce(same, F.lit(False)).cast("long")).groupBy("unit").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))


def lru(accesses: DataFrame, capacity: int) -> DataFrame:
    """(cache, n, hits, dirty_evictions, clean_evictions) of accesses(cache, seq, page, dirty).

    Every access changes the recency of all, so a cache is walked in order; caches run in parallel and a task
    holds ``capacity`` pages, whatever the number of accesses.
    """
    import pandas as pd

    def walk(batches):
        from collections import OrderedDict

        cache, pages, n, hits, dirty, clean = None, OrderedDict(), 0, 0, 0, 0
        for b in batches:
            out = []
            for c, page, d in zip(b["cache"], b["page"], b["dirty"], strict=True):
                if c != cache:
                    if cache is not None:
                        out.append((cache, n, hits, dirty, clean))
                    cache, pages, n, hits, dirty, clean = c, OrderedDict(), 0, 0, 0, 0
                n += 1
                if page in pages:
                    hits += 1
                    pages[page] |= bool(d)
                    pages.move_to_end(page)
                else:
                    if len(pages) == capacity:
                        if pages.popitem(last=False)[1]:
                            dirty += 1
                        else:
                            clean += 1
                    pages[page] = bool(d)
            yield pd.DataFrame(out, columns=["cache", "n", "hits", "dirty_evictions", "clean_evictions"])
        if cache is not None:
            yield pd.DataFrame([(cache, n, hits, dirty, clean)], columns=["cache", "n", "hits", "dirty_evictions", "clean_evictions"])

    ordered = accesses.repartition("cache").sortWithinPartitions("cache", "seq")
    return ordered.mapInPandas(walk, "cache long, n long, hits long, dirty_evictions long, clean_evictions long")


def miss_groups(misses: DataFrame) -> DataFrame:
    """(page, waiters): requests that wait for one read of a page."""
    return misses.groupBy("page").agg(F.count("*").alias("waiters"))
