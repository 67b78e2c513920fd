"""Log-structured merge trees as frames of (level, key, ppa): smaller levels are newer."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import bucket_width, ordinal

#: Entries of a mapping page, pairs of a memtable.
RUN_ENTRIES, MEMTABLE = 510, 1024


def placed_runs(entries: DataFrame, by: str = "level", size: int = RUN_ENTRIES) -> DataFrame:
    """entries with the run that each falls into when they are sorted and cut into runs of ``size``; positions come from buckets of keys."""
    width = bucket_width(entries, "key")
    placed = ordinal(entries, F.floor(F.col("key") / width), ["key"], "place", (by,))
    return placed.withColumn("run", F.floor(F.col("place") / size).cast("long")).drop("place")


def flush_runs(entries: DataFrame, by: str = "level", size: int = RUN_ENTRIES) -> DataFrame:
    """(by, run, first_key, last_key, n): sorted entries cut into runs of ``size``."""
    return placed_runs(entries, by, size).groupBy(by, "run").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("n"))


def flush_by_bytes(entries: DataFrame, limit: int = 7168, count: int = RUN_ENTRIES) -> DataFrame:
    """(shard, run, n, bytes) of entries(shard, key, size): a run ends before it exceeds ``limit`` bytes or ``count`` entries.

    Each cut depends on the one before it, so a shard is walked in order by one task, batch by batch.
    """
    import pandas as pd

    def walk(batches):
        shard, run, n, held = None, 0, 0, 0
        for b in batches:
            out = []
            for s, size in zip(b["shard"], b["size"], strict=True):
                if s != shard:
                    if shard is not None:
                        out.append((shard, run, n, held))
                    shard, run, n, held = s, 0, 0, 0
                elif n == count or held + size + 4 > limit:
                    out.append((shard, run, n, held))
                    run, n, held = run + 1, 0, 0
                n, held = n + 1, held + size + 4
            yield pd.DataFrame(out, columns=["shard", "run", "n", "bytes"])
        if shard is not None:
            yield pd.DataFrame([(shard, run, n, held)], columns=["shard", "run", "n", "bytes"])

    ordered = entries.repartition("shard").sortWithinPartitions("shard", "key")
    return ordered.mapInPandas(walk, "shard long, run long, n long, bytes long")


def merge(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """Two-way merge, upper wins on equal keys."""
    return upper.unionByName(lower.join(upper.select("key"), "key", "left_anti"))


def shadowed(entries: DataFrame) -> DataFrame:
    """(level, key, ppa) that a newer level hides: pages that a full merge invalidates."""
    top = entries.groupBy("key").agg(F.min("level").alias("top"))
    return entries.join(top, "key").where("level > top").select("level", "key", "ppa")


def search(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, level, ppa): the first level that has each key; null if none does."""
    hit = entries.groupBy("key").agg(F.min(F.struct("level", "ppa")).alias("x")).select("key", "x.level", "x.ppa")
    return keys.join(hit, "key", "left").select("key", "level", "ppa")


def compact(entries: DataFrame, tombstone) -> DataFrame:
    """All levels merged into one; tombstones go, as nothing is below."""
    newest = entries.groupBy("key").agg(F.min(F.struct("level", "ppa")).alias("x")).select("key", "x.level", "x.ppa")
    return newest.where(~tombstone).select("key", "ppa")


def summary(entries: DataFrame) -> DataFrame:
    return entries.groupBy("level").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("n"))


def overlapping(runs: DataFrame, start: int, end: int) -> DataFrame:
    return runs.where((F.col("first_key") <= end) & (F.col("last_key") >= start))


def disjoint_before(runs: DataFrame, start: int) -> DataFrame:
    return runs.where(F.col("last_key") < start)


def ordered(runs: DataFrame) -> DataFrame:
    """(level, violations): runs of a level that begin at or below the end of the one before."""
    before = F.lag("last_key").over(Window.partitionBy("level").orderBy("run"))
    return runs.withColumn("bad", F.coalesce(before >= F.col("first_key"), F.lit(False)).cast("long")).groupBy("level").agg(F.sum("bad").alias("violations"))


def run_of(runs: DataFrame, keys: DataFrame, entries: DataFrame, width: int) -> DataFrame:
    """(key, level, run): the run whose key range holds each key, by buckets of keys both sides share."""
    cells = runs.select("level", "run", "first_key", "last_key", F.explode(F.sequence(F.floor(F.col("first_key") / width), F.floor(F.col("last_key") / width))).alias("b"))
    found = keys.withColumn("b", F.floor(F.col("key") / width)).join(cells, "b").where("key between first_key and last_key")
    return found.select("key", "level", "run")


def level_full(n: int, capacity: int, factor: float) -> bool:
    """Whether a level must be compacted: 95 % of large levels, else all but one part of the factor."""
    return n >= capacity * 0.95 if capacity >= 100 else n >= capacity * (factor - 1) / factor


def size_factor(runs: int, levels: int) -> float:
    """The least factor (to 0.01) whose levels hold so many runs."""
    low, high = 1.0, max(2.0, float(runs))
    while high - low > 0.01:
        mid = (low + high) / 2
        if sum(mid**k for k in range(1, levels + 1)) >= runs:
            high = mid
        else:
            low = mid
    return math.ceil(high * 100) / 100


def compact_cascade(levels: list[DataFrame], capacities: list[int], factor: float = 10.0) -> list[DataFrame]:
    """Move full levels down until none is full; the counts, not the rows, come to the driver."""
    out = list(levels)
    for k in range(len(out) - 1):
        if level_full(out[k].count(), capacities[k], factor):
            out[k + 1] = merge(out[k], out[k + 1])
            out[k] = out[k].limit(0)
    return out


def level_into(entries: DataFrame, upper: int, lower: int) -> DataFrame:
    """Leveling: the entries of ``upper`` go to ``lower`` and win there; other levels stay as they are."""
    moved = merge(entries.where(F.col("level") == upper).select("key", "ppa"), entries.where(F.col("level") == lower).select("key", "ppa"))
    rest = entries.where(~F.col("level").isin(upper, lower)).select("level", "key", "ppa")
    return rest.unionByName(moved.select(F.lit(lower).alias("level"), "key", "ppa"))


def cascade(entries: DataFrame, capacities: list[int], factor: float = 10.0) -> DataFrame:
    """Full levels move down, the top one first, until one is not full."""
    for k, capacity in enumerate(capacities):
        if not level_full(entries.where(F.col("level") == k).count(), capacity, factor):
            break
        entries = level_into(entries, k, k + 1)
    return entries


def force_largest(entries: DataFrame, last: int) -> DataFrame:
    """The level above ``last`` with most entries (the first on ties) goes to ``last``; nothing, if all above are empty."""
    sizes = {r.level: r["count"] for r in entries.where(F.col("level") < last).groupBy("level").count().collect()}  # one row a level
    return level_into(entries, max(sizes, key=lambda k: (sizes[k], -k)), last) if sizes else entries


def force_deepest(entries: DataFrame, last: int) -> DataFrame:
    """The deepest level above ``last`` that holds anything goes to ``last``."""
    found = entries.where(F.col("level") < last).agg(F.max("level")).first()[0]
    return entries if found is None else level_into(entries, found, last)


def reinsert(entries: DataFrame, moved: DataFrame) -> DataFrame:
    """Pages that a collection moved come back through level 0; a key that level 0 has already stays newer."""
    fresh = moved.join(entries.where("level = 0").select("key"), "key", "left_anti").select(F.lit(0).alias("level"), "key", "ppa")
    return entries.select("level", "key", "ppa").unionByName(fresh)


def insert_replacing(table: DataFrame, new: DataFrame) -> DataFrame:
    """(key, ppa, invalid_ppa): new entries replace old ones, whose pages become invalid."""
    old = table.select("key", F.col("ppa").alias("old"))
    both = old.join(new.select("key", F.col("ppa").alias("now")), "key", "full")
    return both.select("key", F.coalesce("now", "old").alias("ppa"), F.when(F.col("now").isNotNull(), F.col("old")).alias("invalid_ppa"))


def insert_unique(table: DataFrame, new: DataFrame) -> DataFrame:
    """(key, ppa, refused): an insert that must be new is refused where the key exists."""
    there = table.select("key", F.lit(True).alias("refused"))
    return new.join(there, "key", "left").select("key", "ppa", F.coalesce("refused", F.lit(False)).alias("refused"))


def layered_search(layers: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, layer, ppa, probed) of layers(layer, key, ppa): the first layer that has each key, and how many were asked; null and all, if none has."""
    most = layers.agg(F.count_distinct("layer").alias("all_layers"))
    names = layers.select("layer").distinct().withColumn("at", F.row_number().over(Window.orderBy("layer")))  # a row a layer
    hit = layers.groupBy("key").agg(F.min(F.struct("layer", "ppa")).alias("x")).select("key", "x.layer", "x.ppa").join(F.broadcast(names), "layer")
    found = keys.join(hit, "key", "left").crossJoin(F.broadcast(most))
    return found.select("key", "layer", "ppa", F.coalesce("at", "all_layers").cast("long").alias("probed"))


def runs_from(runs: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """(key, level, run): of found(key, level, run) each containing run and those after it, ``n`` in all where there are so many."""
    wanted = found.withColumn("run", F.explode(F.sequence(F.col("run"), F.col("run") + n - 1)))
    return wanted.join(runs.select("level", "run"), ["level", "run"]).select("key", "level", "run")


def full_levels(entries: DataFrame, capacity: int, factor: float) -> DataFrame:
    """(level, n, full) by the rule of level_full, as columns."""
    limit = F.lit(capacity * 0.95 if capacity >= 100 else capacity * (factor - 1) / factor)
    return entries.groupBy("level").agg(F.count("*").alias("n")).withColumn("full", F.col("n") >= limit)


def rates_by_level(levels: DataFrame, factor: float, depth: int, reads: float = 1.0) -> DataFrame:
    """(level, rate): false-positive rates that grow with the level, so that all filters together cost ``reads`` extra reads."""
    first = reads * (1 - factor) / (1 - factor ** (depth - 1))
    return levels.select("level", F.round(F.lit(first) * F.pow(F.lit(factor), F.col("level")), 9).alias("rate"))
