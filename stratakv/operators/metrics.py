"""Fixed reports over requests and device operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latency_by_type(io: DataFrame) -> DataFrame:
    total = io.agg(F.count("*").alias("total"))
    by = io.groupBy("type_ftl", "type_lower").agg(F.max("latency_us").alias("max_us"), F.min("latency_us").alias("min_us"), F.round(F.avg("latency_us"), 4).alias("avg_us"), F.count("*").alias("n"))
    return by.crossJoin(F.broadcast(total)).select("type_ftl", "type_lower", "max_us", "min_us", "avg_us", "n", F.round(100 * F.col("n") / F.col("total"), 4).alias("pct"))


def histogram(io: DataFrame, width: int = 10, slots: int = 100_000) -> DataFrame:
    """(slot, n): the last slot takes all above."""
    return io.groupBy(F.least(F.floor(F.col("latency_us") / width), F.lit(slots)).cast("long").alias("slot")).agg(F.count("*").alias("n"))


def cdf(io: DataFrame, width: int = 10, slots: int = 100_000) -> DataFrame:
    """(us, n, share): at most ``slots`` rows pass the running sum."""
    h = histogram(io, width, slots)
    upto = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return h.select((F.col("slot") * width).alias("us"), "n", F.round(F.sum("n").over(upto) / F.sum("n").over(whole), 6).alias("share"))


def traffic(io: DataFrame) -> DataFrame:
    return io.groupBy("lreq").agg(F.count("*").alias("n"))


def traffic_matrix(io: DataFrame, classes: list[str]) -> DataFrame:
    """A row a unit, a column a class."""
    return io.groupBy("type_ftl").agg(*[F.count_if(F.col("lreq") == c).alias(f"n_{c}") for c in classes])


def amplification(requests: DataFrame, device: DataFrame) -> DataFrame:
    """(writes, reads, waf, raf)."""
    r, d = requests.agg(F.count_if(F.expr("op = 'SET'")).alias("writes"), F.count_if(F.expr("op = 'GET'")).alias("reads")), device.agg(F.count_if("write").alias("dw"), F.count_if(~F.col("write")).alias("dr"))
    return r.crossJoin(F.broadcast(d)).select("writes", "reads", F.round(F.col("dw") / F.col("writes"), 6).alias("waf"), F.round(F.col("dr") / F.col("reads"), 6).alias("raf"))


def throughput(found: DataFrame, seconds: float, page: int = 8192) -> DataFrame:
    """(n, success, kb_s, iops) of found(status) reads; misses scale throughput."""
    n, miss = F.count("*"), F.count_if(F.expr("status = 'NOTFOUND'"))
    rows = found.agg(n.alias("n"), miss.alias("miss"))
    success = 1 - F.col("miss") / F.col("n")
    return rows.select("n", F.round(success, 6).alias("success"), F.round(F.lit(page) * F.col("n") / 1024 / seconds * success, 4).alias("kb_s"), F.round(F.col("n") / F.lit(seconds), 4).alias("iops"))


def in_flight(spans: DataFrame, width: int) -> DataFrame:
    """(bucket, peak) of spans(begin, finish), longs: most spans open at once in each bucket of time.

    Openings and closings are summed by bucket; a bucket starts from the sum of those before it.
    """
    marks = spans.select(F.col("begin").alias("t"), F.lit(1).alias("d")).union(spans.select(F.col("finish").alias("t"), F.lit(-1).alias("d")))
    at = marks.groupBy("t").agg(F.sum("d").alias("d")).withColumn("bucket", F.floor(F.col("t") / width).cast("long"))
    base = at.groupBy("bucket").agg(F.sum("d").alias("d")).select("bucket", F.coalesce(F.sum("d").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    run = F.sum("d").over(Window.partitionBy("bucket").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return at.withColumn("run", run).groupBy("bucket").agg(F.max("run").alias("run")).join(base, "bucket").select("bucket", (F.col("base") + F.col("run")).cast("long").alias("peak"))


def gather(parts: DataFrame) -> DataFrame:
    """(parent, done) of parts(parent, expected, ok): a request ends when all its parts did."""
    return parts.groupBy("parent").agg((F.count_if("ok") == F.max("expected")).alias("done"))


def millisecond_histogram(io: DataFrame) -> DataFrame:
    """(ms, n): whole milliseconds below ten, 10 for those up to a second, 11 from a second on."""
    ms = F.when(F.col("latency_us") >= 1_000_000, 11).otherwise(F.least(F.floor(F.col("latency_us") / 1000), F.lit(10)))
    return io.groupBy(ms.cast("long").alias("ms")).agg(F.count("*").alias("n"))


def demand_amplification(traffic: DataFrame) -> DataFrame:
    """(waf, raf) of traffic(kind, cause, write, n): what data requests cost with translation pages and collections counted in."""
    total = lambda write, own: F.sum(F.when((F.col("write") == write) & (~F.lit(own) | ((F.col("kind") == "data") & (F.col("cause") == "request"))), F.col("n")).otherwise(0))
    return traffic.agg(F.round(total(True, False) / total(True, True), 6).alias("waf"), F.round(total(False, False) / total(False, True), 6).alias("raf"))


def cause_breakdown(traffic: DataFrame) -> DataFrame:
    """(cause, data_reads, data_writes, trans_reads, trans_writes) of traffic(kind, cause, write, n)."""
    cell = lambda kind, write: F.coalesce(F.sum(F.when((F.col("kind") == kind) & (F.col("write") == write), F.col("n"))), F.lit(0)).cast("long")
    return traffic.groupBy("cause").agg(cell("data", False).alias("data_reads"), cell("data", True).alias("data_writes"), cell("trans", False).alias("trans_reads"), cell("trans", True).alias("trans_writes"))


def replay_rate(pages, seconds: float, page: int = 8192):
    """Decimal megabytes a second of so many replayed pages."""
    return F.round(pages * page / seconds / 1e6, 4)
