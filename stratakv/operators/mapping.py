"""Address mapping, allocation, hashed probing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import fold_words, probe_slot


def current(writes: DataFrame) -> DataFrame:
    """(lpa, ppa): where each logical page was written last."""
    return writes.groupBy("lpa").agg(F.max("ppa").alias("ppa"))


def validity(writes: DataFrame) -> DataFrame:
    """(ppa, lpa, block, valid): a page is valid until its logical page is written again."""
    last = current(writes).select("lpa", F.col("ppa").alias("now"))
    return writes.join(last, "lpa").select("ppa", "lpa", "block", (F.col("ppa") == F.col("now")).alias("valid"))


def invalidated(writes: DataFrame) -> DataFrame:
    """(ppa, old_ppa): the page that each write makes stale."""
    return writes.select("ppa", "lpa", F.lag("ppa").over(Window.partitionBy("lpa").orderBy("ppa")).alias("old_ppa")).where("old_ppa is not null")


def lookup(mapping: DataFrame, pages: DataFrame) -> DataFrame:
    return pages.join(mapping, "lpa", "left").select("lpa", "ppa", F.when(F.col("ppa").isNull(), "NOTFOUND").otherwise("OK").alias("status"))


def reverse(writes: DataFrame, pages: DataFrame) -> DataFrame:
    """(ppa, lpa) from the spare area of the pages asked for."""
    return pages.join(writes.select("ppa", "lpa"), "ppa")


def two_level(mapping: DataFrame, entries: int = 2048) -> DataFrame:
    """(tpage, n, first_lpa, last_lpa): translation pages of the mapping."""
    return mapping.groupBy(F.floor(F.col("lpa") / entries).cast("long").alias("tpage")).agg(F.count("*").alias("n"), F.min("lpa").alias("first_lpa"), F.max("lpa").alias("last_lpa"))


def probes(keys: DataFrame, slots: int, most: int) -> DataFrame:
    """(key, c, slot): the first probes of every key."""
    return keys.withColumn("h", fold_words("key")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).select("key", "c", probe_slot(F.col("h"), F.col("c"), slots).alias("slot"))


def _prime(n: int) -> int:
    """The least prime from n on."""
    while n < 2 or any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def insert_probing(keys: DataFrame, slots: int | None = None, shards: int = 8, most: int = 1024, per_shard: int = 512, with_slots: bool = False) -> DataFrame:
    """(shard, slot, key, c): keys inserted in order of arrival, each at its first free probe.

    Every insertion depends on those before it, so the table is sharded by hash and a shard is walked in order.
    keys(seq, key).  Without ``slots`` there are as many shards as hold ``per_shard`` keys each on average, and a
    shard has one slot more (slot 0 is never used) than the least prime above twice its keys: probes c + c * c then
    reach more slots than are taken, and every key is placed.  With ``slots``, a key beyond ``most`` probes is
    returned with a null slot.  with_slots: the shard's number of slots is returned too.
    """
    import pandas as pd

    hashed = keys.groupBy("key").agg(F.min("seq").alias("seq")).withColumn("h", fold_words("key"))
    fixed = max(slots // shards, 3) if slots else None
    if fixed:
        shard = F.col("h") % shards
    else:
        n = keys.agg(F.count_distinct("key")).first()[0]
        shard = F.pmod(F.xxhash64("key"), F.lit(-(-n // per_shard) or 1))

    def walk(key, rows):
        taken, out = {}, []
        own = fixed or _prime(2 * len(rows) + 1) + 1
        limit = most if fixed else own
        rows = rows.sort_values("seq")
        for name, h in zip(rows["key"], rows["h"], strict=True):
            for c in range(limit):
                slot = ((h + c + c * c) & 0xFFFFFFFF) % (own - 1) + 1
                if taken.setdefault(slot, name) == name:
                    out.append((key[0], slot, name, c))
                    break
            else:
                out.append((key[0], None, name, limit))
        return pd.DataFrame([(*row, own) for row in out], columns=["shard", "slot", "key", "c", "slots"]).astype({"slot": "Int64"})

    placed = hashed.withColumn("shard", shard).groupBy("shard").applyInPandas(walk, "shard long, slot long, key string, c long, slots long")
    return placed if with_slots else placed.drop("slots")


def allocate(writes: DataFrame, units: int = 64) -> DataFrame:
    """(ppa, unit, page): pages round-robin over parallel units."""
    return writes.select("ppa", (F.col("ppa") % units).alias("unit"), F.floor(F.col("ppa") / units).cast("long").alias("page"))


def block_address(lpas: DataFrame, pages_per_segment: int = 16384, blocks: int = 64) -> DataFrame:
    """(lpa, seg, blk, ofs) of a block-mapped address."""
    inside = F.col("lpa") % pages_per_segment
    return lpas.select("lpa", F.floor(F.col("lpa") / pages_per_segment).cast("long").alias("seg"), (inside % blocks).alias("blk"), F.floor(inside / blocks).cast("long").alias("ofs"))
