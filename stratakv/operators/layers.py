"""Lookups through layers: write buffer, mapping cache, translation page, data page; and the caches of mappings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def demand_lookup(log: DataFrame, mapping: DataFrame, buffer: int, entries: int, sets: int) -> DataFrame:
    """(seq, lpa, answered) of reads in log(seq, op, lpa): BUFFER, CACHE, FLASH or NOTFOUND, whichever comes first.

    A write waits in the buffer of its ``buffer`` sequence numbers.  The cache holds one translation page of
    ``entries`` mappings in each of ``sets`` sets; a read that neither buffer nor cache answers loads its page.
    """
    batch, tpage = F.floor(F.col("seq") / buffer), F.floor(F.col("lpa") / entries).cast("long")
    earlier = Window.partitionBy("lpa", batch).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = log.withColumn("buffered", F.coalesce(F.max(F.col("op") == "SET").over(earlier), F.lit(False)))
    reads = rows.where("op = 'GET'").withColumn("tpage", tpage)
    before = F.lag("tpage").over(Window.partitionBy(F.col("tpage") % sets).orderBy("seq"))
    below = reads.where("not buffered").withColumn("cached", F.coalesce(before == F.col("tpage"), F.lit(False)))
    below = below.join(mapping.select("lpa", "ppa"), "lpa", "left")
    place = F.when(F.col("ppa").isNull(), "NOTFOUND").when(F.col("cached"), "CACHE").otherwise("FLASH")
    return reads.where("buffered").select("seq", "lpa", F.lit("BUFFER").alias("answered")).unionByName(below.select("seq", "lpa", place.alias("answered")))


def hit_ratio(accesses: DataFrame) -> DataFrame:
    """(reads, writes, hits, per_read, per_all) of accesses(op, hit): hits of reads over reads, and over all requests."""
    sums = accesses.agg(F.count_if(F.col("op") == "GET").alias("reads"), F.count_if(F.col("op") != "GET").alias("writes"), F.count_if((F.col("op") == "GET") & F.col("hit")).alias("hits"))
    return sums.select("reads", "writes", "hits", F.round(F.col("hits") / F.col("reads"), 6).alias("per_read"), F.round(F.col("hits") / (F.col("reads") + F.col("writes")), 6).alias("per_all"))


def fine_cache(capacity: int, entries: int) -> Callable[[Iterator[tuple[int, bool]]], tuple[int, int, int]]:
    """A walk over (lpa, dirty): (n, hits, evicted pages); mappings are held one by one, but an eviction takes all of a translation page's."""
    from collections import OrderedDict

    def walk(accesses):
        held: OrderedDict[int, bool] = OrderedDict()
        pages: dict[int, set[int]] = {}
        n = hits = evicted = 0
        for lpa, dirty in accesses:
            n += 1
            if lpa in held:
                hits += 1
                held[lpa] |= dirty
                held.move_to_end(lpa)
                continue
            if len(held) >= capacity:
                for other in pages.pop(next(iter(held)) // entries):
                    del held[other]
                evicted += 1
            held[lpa] = dirty
            pages.setdefault(lpa // entries, set()).add(lpa)
        return n, hits, evicted

    return walk


def split_cache(clean: int, dirty: int) -> Callable[[Iterator[tuple[int, bool]]], tuple[int, int, int]]:
    """A walk over (page, dirty): (n, hits, written back); clean and dirty pages have lists of their own, each least recently used."""
    from collections import OrderedDict

    def walk(accesses):
        lists: tuple[OrderedDict, OrderedDict] = (OrderedDict(), OrderedDict())
        limits = (clean, dirty)
        n = hits = written = 0
        for page, writes in accesses:
            n += 1
            at = next((k for k in (0, 1) if page in lists[k]), None)
            to = 1 if writes or at == 1 else 0
            if at is not None:
                hits += 1
                del lists[at][page]
            if len(lists[to]) >= limits[to]:
                lists[to].popitem(last=False)
                written += to
            lists[to][page] = None
        return n, hits, written

    return walk


def walk_caches(accesses: DataFrame, make: Callable[[], Callable], last: str) -> DataFrame:
    """(cache, n, hits, ``last``) of accesses(cache, seq, page, dirty): every cache is walked in order by one task that holds its pages only."""
    import pandas as pd

    def run(batches):
        def rows():
            for b in batches:
                yield from zip(b["cache"].tolist(), b["page"].tolist(), b["dirty"].tolist(), strict=True)

        from itertools import groupby

        for cache, part in groupby(rows(), key=lambda r: r[0]):
            yield pd.DataFrame([(cache, *make()((p, bool(d)) for _, p, d in part))], columns=["cache", "n", "hits", last])

    ordered = accesses.repartition("cache").sortWithinPartitions("cache", "seq").select("cache", "page", "dirty")
    return ordered.mapInPandas(run, f"cache long, n long, hits long, {last} long")


def probe_lookup(placed: DataFrame, probes: DataFrame) -> DataFrame:
    """(key, c, slot, wrong) of placed(shard, slot, key) and probes(key, shard, c, slot): the first probe whose slot holds the key, and how many held another.

    Probes beyond the one that finds the key are not made, so they don't count.
    """
    seen = probes.join(placed.select("shard", "slot", F.col("key").alias("there")), ["shard", "slot"], "left")
    hit = F.when(F.col("there") == F.col("key"), F.col("c"))
    found = seen.withColumn("at", F.min(hit).over(Window.partitionBy("key")))
    return found.groupBy("key").agg(F.min("at").alias("c"), F.min(F.when(F.col("c") == F.col("at"), F.col("slot"))).alias("slot"), F.count_if(F.col("there").isNotNull() & (F.col("c") < F.coalesce("at", F.lit(1 << 30)))).alias("wrong"))
