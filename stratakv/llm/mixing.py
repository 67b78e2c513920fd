"""Operator 1: mixing sources to target weights.

Every document gets a hash-random key.  Documents are range-sorted by that key within their source; the
leading bits of the key cut each source into ranges, so that a hot source is spread over many tasks, and
distributed prefix sums of sizes over the ranges place each document on its source's number line.  The
line is cut at the source's exact budget, after as many whole epochs as the budget holds.

Defined results: a null source is a source of its own, the last; null or wordless texts have size 0 and
give 0 words; repeated rows are rows of their own (equal keys are ordered by size and so interchangeable);
an empty table gives an empty result; extra columns are ignored by the plan.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, prepare, tasks, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3


def _bits(n: int) -> int:
    """Leading key bits that name a range: 256 ranges at least, some 100,000 rows each at most, 65,536 ranges at most."""
    return min(16, max(8, math.ceil(math.log2(max(n, 1) / 100_000 + 1))))


def targets(totals: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, total) to (source, total, target): shares of the sum by weight, none above max_epochs times its total.

    The level L solves sum(min(max_epochs * total, L * weight)) = sum(total).  Ordered by the level at which
    they saturate, the saturated sources are a prefix, so L is the least candidate over all prefixes.  One row
    per source passes through here, never rows of documents.
    """
    n = len(weights)
    place = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(place) - 1) % n + 1).cast("int"))
    caps = totals.withColumn("weight", weight).withColumn("cap", F.col("total") * F.lit(float(max_epochs)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = (
        caps.withColumn("sum_total", F.sum("total").over(everything).cast("double"))
        .withColumn("sum_weight", F.sum("weight").over(everything))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("sum_total") - F.col("cap_before")) / (F.col("sum_weight") - F.col("weight_before")))
        .withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    )
    first = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levels.withColumn("at", first).select("source", "total", F.least("cap", F.coalesce(F.col("at") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix", keep: tuple = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of docs(doc_id, text, source).

    taken counts words, repeats included: size for each whole epoch of the budget, and in the last, partial
    one all of a document, none of it, or its first words where the budget ends within it.  Columns to keep go with
    their row and order rows of equal doc_id and size.
    """
    prepare(docs.sparkSession)
    sizes = docs.select("doc_id", "source", word_count("text").alias("size"), *keep)
    sizes = sizes.withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")))
    sizes = materialize(sizes, "mix-sizes")  # texts are read once
    n = sizes.count()
    bits = _bits(n)
    bucket = F.shiftright(F.conv(F.substring("key", 1, 4), 16, 10).cast("int"), 16 - bits)
    sizes = sizes.withColumn("bucket", bucket)
    ranges = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("range_size"))
    goals = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("total")), weights, max_epochs)
    along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("before", F.coalesce(F.sum("range_size").over(along), F.lit(0))).drop("range_size")
    starts = starts.join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # never null: the window and the join share one shuffle
    starts = starts.select(name.alias("part"), "bucket", "before", "total", "target")
    within = Window.partitionBy("part", "bucket").orderBy("key", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("part", name).withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(starts, ["part", "bucket"])
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("total") > 0, F.expr("cast(floor(target) as bigint) div total")).otherwise(F.lit(0))
    rest = F.when(F.col("total") > 0, budget % F.col("total")).otherwise(F.lit(0))
    part = F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("before") - F.col("inside")))
    out = placed.select("doc_id", "source", "size", F.col("total").alias("source_size"), "target", (epochs * F.col("size") + part).cast("long").alias("taken"), *keep)
    return out.coalesce(tasks(docs.sparkSession, n, 100_000))
