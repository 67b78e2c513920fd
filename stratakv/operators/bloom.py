"""Explicit Bloom filters as bit positions, to skip levels before a lookup."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashes import bit_positions, murmur3


def positions(keys: DataFrame, bits: int, k: int) -> DataFrame:
    """(..., bit): k rows a key of keys(key, ...)."""

    def run(batches):
        for batch in batches:
            hashed = murmur3([x.encode() for x in batch.column("key").to_pylist()])
            rows = pa.array([i for i in range(batch.num_rows) for _ in range(k)], pa.int64())
            bit = pa.array(bit_positions(hashed, bits, k).ravel(), pa.int64())
            yield pa.RecordBatch.from_arrays([*[c.take(rows) for c in batch.columns], bit], [*batch.schema.names, "bit"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema)
    return keys.mapInArrow(run, f"{schema}, bit long")


def build(entries: DataFrame, bits: int, k: int) -> DataFrame:
    """(level, bit): set bits of the filter of each level."""
    return positions(entries.select("level", "key"), bits, k).select("level", "bit").distinct()


def may_contain(filters: DataFrame, probes: DataFrame, bits: int, k: int) -> DataFrame:
    """(key, level): levels whose filter has all bits of a key; never misses a level that has it."""
    asked = positions(probes.select("key").distinct(), bits, k).distinct()
    need = asked.groupBy("key").agg(F.count("*").alias("need"))
    met = asked.join(filters, "bit").groupBy("key", "level").agg(F.count("*").alias("met"))
    return met.join(need, "key").where("met = need").select("key", "level")
