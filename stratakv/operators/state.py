"""Key-value state implied by an operation log: last write wins, a delete is a tombstone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame) -> DataFrame:
    """(key, seq, op, val, vlen) of the last SET or DELETE of every key; pre-aggregates, so hot keys are cheap."""
    last = F.max(F.struct("seq", "op", "val", "vlen"))
    return log.where("op <> 'GET'").groupBy("key").agg(last.alias("x")).select("key", "x.*")


def visible(log: DataFrame) -> DataFrame:
    """(key, seq, val, vlen) of live keys."""
    return latest(log).where("op = 'SET'").drop("op")


def get(state: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, val, status) of each requested key; unknown ones are NOTFOUND, live ones are OK even if their value is null."""
    found = keys.join(state.select("key", "val", F.lit(True).alias("there")), "key", "left")
    return found.select("key", "val", F.when(F.col("there"), "OK").otherwise("NOTFOUND").alias("status"))


def multi_get(state: DataFrame, requests: DataFrame) -> DataFrame:
    """(req, n_keys, n_found, sum_val) of requests(req, keys): all keys of a request are looked up together."""
    one = requests.select("req", F.explode("keys").alias("key"))
    found = one.join(state.select("key", "val", F.lit(True).alias("there")), "key", "left")
    return found.groupBy("req").agg(F.count("*").alias("n_keys"), F.count("there").alias("n_found"), F.round(F.sum("val"), 4).alias("sum_val"))


def multi_set(requests: DataFrame) -> DataFrame:
    """requests(seq, keys, vals) as log rows, in the order of the arrays."""
    pairs = requests.select("seq", F.posexplode(F.arrays_zip("keys", "vals")).alias("pos", "kv"))
    return pairs.select("seq", "pos", F.col("kv.keys").alias("key"), F.col("kv.vals").alias("val"))


def as_of_get(log: DataFrame, chunk: int = 1024) -> DataFrame:
    """(seq, key, val, status): every GET with what the latest earlier SET or DELETE of its key left.

    A key's log is cut into chunks of sequence numbers, so a hot key is many small windows: within a chunk the
    last write is carried forward, and a chunk starts from the last write of the chunks before it.
    """
    log = log.withColumn("c", F.floor(F.col("seq") / chunk))
    write = F.when(F.col("op") != "GET", F.struct("seq", "op", "val"))
    ends = log.where("op <> 'GET'").groupBy("key", "c").agg(F.max(F.struct("seq", "op", "val")).alias("last"))
    touched = log.select("key", "c").distinct().join(ends, ["key", "c"], "left")
    before = Window.partitionBy("key").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    carried = touched.select("key", "c", F.last("last", ignorenulls=True).over(before).alias("carry"))
    inside = Window.partitionBy("key", "c").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = log.withColumn("near", F.last(write, ignorenulls=True).over(inside)).where("op = 'GET'").join(carried, ["key", "c"])
    found = F.coalesce("near", "carry")
    live = found["op"] == "SET"
    return seen.select("seq", "key", F.when(live, found["val"]).alias("val"), F.when(live, "OK").otherwise("NOTFOUND").alias("status"))


def read_modify_write(state: DataFrame, patches: DataFrame) -> DataFrame:
    """state(key, text) with patches(key, patch, off) applied; several patches of a key form a chain, by ``seq`` if there is one, else by offset and patch."""
    order = ["seq"] if "seq" in patches.columns else []
    chains = patches.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(*order, "off", "patch"))).alias("chain"))
    patched = F.aggregate("chain", F.col("text"), lambda text, x: F.overlay(text, x["patch"], x["off"] + 1))
    return state.join(chains, "key", "left").select("key", F.when(F.col("chain").isNull(), F.col("text")).otherwise(patched).alias("text"))


def pending_overlay(state: DataFrame, pending: DataFrame) -> DataFrame:
    """State as reads see it while writes wait: the last pending write of a key hides the stored value."""
    last = latest(pending).select("key", F.col("op").alias("p_op"), F.col("val").alias("p_val"))
    both = state.select("key", "val").join(last, "key", "full")
    return both.where("p_op is null or p_op = 'SET'").select("key", F.when(F.col("p_op").isNotNull(), F.col("p_val")).otherwise(F.col("val")).alias("val"), F.col("p_op").isNotNull().alias("pending"))


def coalesce_writes(log: DataFrame, batch: int) -> DataFrame:
    """(batch, key, seq, val): of a batch's writes to a key only the last is kept."""
    sets = log.where("op = 'SET'").withColumn("batch", F.floor(F.col("seq") / batch).cast("long"))
    return sets.groupBy("batch", "key").agg(F.max(F.struct("seq", "val")).alias("x")).select("batch", "key", "x.*")


def schedule(log: DataFrame, batch: int) -> DataFrame:
    """(batch, place, seq, op): within a batch reads go before writes, each in order of arrival."""
    rank = F.when(F.col("op") == "GET", 0).otherwise(1)
    rows = log.withColumn("batch", F.floor(F.col("seq") / batch).cast("long"))
    return rows.select("batch", (F.row_number().over(Window.partitionBy("batch").orderBy(rank, "seq"))).alias("place"), "seq", "op")


def schedule_with_retries(log: DataFrame, batch: int) -> DataFrame:
    """(batch, place, seq) of log(seq, op, retry): within a batch retried requests go first, then reads, then writes."""
    rank = F.when(F.col("retry"), 0).when(F.col("op") == "GET", 1).otherwise(2)
    rows = log.withColumn("batch", F.floor(F.col("seq") / batch).cast("long"))
    return rows.select("batch", F.row_number().over(Window.partitionBy("batch").orderBy(rank, "seq")).cast("long").alias("place"), "seq")


def classify(requests: DataFrame) -> DataFrame:
    """(type, name, n): requests by type number; those of no known type are UNKNOWN, and completed like any other."""
    # fixed values: the request type numbers
    names = {1: "SET", 2: "GET", 3: "DELETE"}
    name = F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("type")], F.lit("UNKNOWN"))
    return requests.groupBy("type").agg(F.count("*").alias("n")).select("type", name.alias("name"), "n")
