"""Synthetic workloads (op, seq, key) as DataFrames; random ones hash the sequence number, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.runtime import ordinal


def even(n: int) -> int:
    """Request counts are rounded down to even."""
    return n - n % 2


def uniform(seq: Column, span: int, seed: int) -> Column:
    """A number in [0, span) from the sequence number."""
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), seq.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % span


def sequential(spark: SparkSession, op: str, start: int, end: int, n: int) -> DataFrame:
    return spark.range(even(n)).select(F.col("id").alias("seq"), F.lit(op).alias("op"), (start + F.col("id") % (end - start)).alias("key"))


def random(spark: SparkSession, op: str, start: int, end: int, n: int, seed: int = 1) -> DataFrame:
    return spark.range(even(n)).select(F.col("id").alias("seq"), F.lit(op).alias("op"), (start + uniform(F.col("id"), end - start, seed)).alias("key"))


def set_then_get(work: DataFrame, n: int) -> DataFrame:
    """The sets, then gets of the same keys in the same order."""
    return work.withColumn("op", F.lit("SET")).union(work.select(F.col("seq") + n, F.lit("GET"), "key"))


def mixed(spark: SparkSession, start: int, end: int, n: int, set_percent: int = 50, seed: int = 1) -> DataFrame:
    work = random(spark, "SET", start, end, n, seed)
    return work.withColumn("op", F.when(uniform(F.col("seq"), 100, seed + 1) < set_percent, "SET").otherwise("GET"))


def written_reads(work: DataFrame) -> DataFrame:
    """Gets of keys that no earlier request set become sets."""
    first = work.where("op = 'SET'").groupBy("key").agg(F.min("seq").alias("first_set"))
    joined = work.join(first, "key", "left")
    return joined.select("seq", F.when((F.col("op") == "GET") & (F.col("first_set") < F.col("seq")), "GET").otherwise("SET").alias("op"), "key")


def permutation(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """Every key of [0, n) once, in hash order: (seq is the sort key, not a position)."""
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("id").cast("string")).cast("binary"))
    return spark.range(n).select(digest.alias("place"), F.lit("SET").alias("op"), F.col("id").alias("key"))


def local_keys(spark: SparkSession, n: int, span: int, locality: int = 50, hot_share: float = 0.5, seed: int = 1) -> DataFrame:
    """``locality`` percent of keys fall into the first ``hot_share`` of the range."""
    hot = int(span * hot_share)
    pick = uniform(F.col("id"), 100, seed) < locality
    return spark.range(even(n)).select(F.col("id").alias("seq"), F.when(pick, uniform(F.col("id"), hot, seed + 1)).otherwise(hot + uniform(F.col("id"), span - hot, seed + 2)).alias("key"))


def permuted(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """Every key of [0, n) once, in hash order; seq is the position, found by buckets of the hash and not by a global sort."""
    rows = permutation(spark, n, seed)
    bits = max(1, min(16, (n // 1000).bit_length()))
    bucket = F.shiftright(F.conv(F.substring("place", 1, 4), 16, 10).cast("int"), 16 - bits)
    return ordinal(rows, bucket, ["place"], "seq").select("seq", "op", "key")


def value_sizes(spark: SparkSession, n: int, pieces: int, seed: int = 1) -> DataFrame:
    """(seq, pieces): value sizes from one piece to one less than a page has."""
    return spark.range(even(n)).select(F.col("id").alias("seq"), (1 + uniform(F.col("id"), pieces - 1, seed)).alias("pieces"))
