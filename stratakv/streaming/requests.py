"""The live request stream: Structured Streaming over a folder of request files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import encode_key
from ..operators.state import latest
from ..plans.runtime import work_path


def requests(spark: SparkSession, sf_dir: str, files_per_trigger: int = 4, files: str = "events.parquet") -> DataFrame:
    """A streaming (seq, ts, key, op, val, vlen) of the events files; files per trigger bound the inflow, ``files`` is a pattern of names."""
    schema = spark.read.option("pathGlobFilter", files).parquet(sf_dir).schema
    e = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", files).parquet(sf_dir)
    op = F.when(F.col("event_type").isin("purchase", "signup"), "SET").when(F.col("event_type").isin("view", "click"), "GET").otherwise("DELETE")
    return e.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), encode_key("user_id").alias("key"), op.alias("op"), F.col("value").alias("val"), (F.floor(F.col("value") * 16) % 8192 + 1).cast("long").alias("vlen"))


def drain(stream: DataFrame, log: str, mode: str, each) -> None:
    """Run a stream over all that is there and not yet in its log; ``each`` gets every micro-batch and its number."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", log).foreachBatch(each).trigger(availableNow=True).start()
    query.awaitTermination()


def _numbered(path: str):
    """Write a micro-batch under its number, so that one that runs again replaces itself."""
    return lambda batch, k: batch.write.mode("overwrite").parquet(f"{path}/k={k}")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What the micro-batches wrote; nothing, if the stream was empty."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def merge_traffic(stream: DataFrame, path: str, log: str) -> DataFrame:
    """(day, op, n, total) of a stream of requests in tumbling days, the last update of each; rows more than two days late are dropped."""
    windows = stream.withWatermark("ts", "2 days").groupBy(F.window("ts", "1 day"), "op").agg(F.count("*").alias("n"), F.sum("val").alias("total"))
    drain(windows.select(F.col("window.start").alias("day"), "op", "n", "total"), log, "update", _numbered(path))
    rows = _read(stream.sparkSession, path, "day timestamp, op string, n long, total double, k int")
    last = rows.groupBy("day", "op").agg(F.max(F.struct("k", "n", "total")).alias("x"))
    return last.select(F.col("day").cast("timestamp_ntz").alias("day"), "op", F.col("x.n").alias("n"), F.round("x.total", 2).alias("total"))


def merge_state(stream: DataFrame, path: str, log: str) -> DataFrame:
    """(key, seq, val) of a stream of requests: each micro-batch is reduced to its last writes, which are merged on reading, so late rows find their place."""
    drain(stream, log, "append", lambda batch, k: _numbered(path)(latest(batch), k))
    rows = _read(stream.sparkSession, path, "key string, seq long, op string, val double, vlen long, k int")
    return latest(rows).where("op = 'SET'").select("key", "seq", "val")


def daily_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_traffic(requests(spark, sf_dir), work_path(spark, "traffic"), work_path(spark, "traffic-log"))


def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_state(requests(spark, sf_dir), work_path(spark, "state"), work_path(spark, "state-log"))
