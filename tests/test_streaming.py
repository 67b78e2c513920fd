"""The request stream in several micro-batches, with late rows, a restart and nothing at all."""

from pyspark.sql import functions as F

from stratakv.operators import state
from stratakv.streaming import requests as R

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
SF = "/root/testdata/sf0.001"


def test_batches_late_rows_and_a_restart(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    folder, out, log = f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/log"
    events.where("event_id % 3 <> 0").repartition(5).write.parquet(folder)
    stream = lambda: R.requests(spark, folder, 1, "*.parquet")
    R.merge_state(stream(), out, log)
    events.where("event_id % 3 = 0").repartition(2).write.mode("append").parquet(folder)  # older numbers among them
    got = R.merge_state(stream(), out, log)
    batches = spark.read.parquet(out).select("k").distinct().count()
    assert batches == 7  # one file each, and the restart read only the two new ones
    op = F.when(F.col("event_type").isin("purchase", "signup"), "SET").when(F.col("event_type").isin("view", "click"), "GET").otherwise("DELETE")
    whole = events.select(F.col("event_id").alias("seq"), F.concat(F.lit("user"), F.lpad(F.col("user_id").cast("string"), 12, "0")).alias("key"), op.alias("op"), F.col("value").alias("val"), F.lit(0).alias("vlen"))
    want = {(r.key, r.seq, r.val) for r in state.visible(whole).collect()}
    assert {(r.key, r.seq, r.val) for r in got.collect()} == want


def test_windows_take_late_rows_within_the_watermark(spark, tmp_path):
    folder, out, log = f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/log"
    row = lambda i, day: (i, f"2024-01-{day:02d} 12:00:00", 1, "view", 1.0, "")
    for part in ([row(1, 10), row(2, 10)], [row(3, 12)], [row(4, 10), row(5, 11)], [row(6, 20)], [row(7, 10)]):
        df = spark.createDataFrame(part, EVENTS.replace("ts timestamp_ntz", "ts string")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        df.coalesce(1).write.mode("append").parquet(folder)
        got = R.merge_traffic(R.requests(spark, folder, 1, "*.parquet"), out, log)
    found = {r.day.day: r.n for r in got.collect()}
    assert found[10] == 3 and found[11] == 1 and found[12] == 1 and found[20] == 1  # the last row is ten days late


def test_an_empty_stream(spark, tmp_path):
    spark.createDataFrame([], EVENTS).write.parquet(f"file://{tmp_path}/in")
    stream = R.requests(spark, f"file://{tmp_path}/in", 1, "*.parquet")
    assert R.merge_state(stream, f"file://{tmp_path}/a", f"file://{tmp_path}/b").count() == 0
    assert R.merge_traffic(stream, f"file://{tmp_path}/c", f"file://{tmp_path}/d").count() == 0
