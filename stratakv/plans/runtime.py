"""Session helpers: tables, and work tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    env = spark.sparkContext.environment
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")
    if root not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, path) if x)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession, tag: str) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="stratakv-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at}/stratakv-{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: what is dear and read several times is computed once."""
    path = work_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket_width(rows: DataFrame, column: str, most: int = 16_384, least: int = 256) -> int:
    """Width that cuts a column of longs into ``most`` buckets at most, none narrower than ``least``: sums over buckets stay small, whatever the data."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    return least if low is None else max(least, -(-(high - low + 1) // most))


def ordinal(rows: DataFrame, bucket: Column, order: list, name: str = "ordinal", by: tuple = ()) -> DataFrame:
    """rows with their 0-based position in the order of (bucket, *order), within each value of ``by``, without a global sort.

    bucket must be monotonic in the order.  Rows are counted by bucket, the counts are summed over the (few)
    buckets, and positions within a bucket are added: no task holds more than a bucket.
    """
    rows = rows.withColumn("__b", bucket)
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*by, "__b").agg(F.count("*").alias("__n")).withColumn("__s", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy(*by, "__b").orderBy(*order)) - 1
    return rows.withColumn("__i", inside).join(starts, [*by, "__b"]).withColumn(name, (F.col("__s") + F.col("__i")).cast("long")).drop("__b", "__s", "__i")
