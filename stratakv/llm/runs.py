"""Keys that recur, from rows sorted by key: a streaming pass that holds one row at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import shuffle_partitions


def recurring(rows: DataFrame, keys: list[str], by: str, later: bool = False) -> DataFrame:
    """Rows of keys that occur with at least two values of ``by``; with a column ``first``, the key's least value.

    by: a long; later: only rows whose value is above the first.  One shuffle by key; within a partition rows
    are sorted and pass by batch, so a key of any number of rows needs no memory.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]):
        held, key, first, open_ = None, None, None, False
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                held = None
            n = batch.num_rows
            if not n:
                continue
            k = [batch.column(c).to_numpy() for c in keys]
            d = batch.column(by).to_numpy()
            change = np.zeros(n - 1, bool)
            for x in k:
                change |= x[1:] != x[:-1]
            start = np.concatenate([[0], np.flatnonzero(change) + 1])
            stop = np.concatenate([start[1:], [n]])
            least = d[start]
            many = d[stop - 1] > least
            if open_ and tuple(x[0] for x in k) == key:
                least = least.copy()
                least[0], many[0] = first, True
            key, first, open_ = tuple(x[-1] for x in k), least[-1], bool(many[-1])
            if not open_:
                held = batch.slice(int(start[-1]))
            keep = np.repeat(many, stop - start)
            firsts = np.repeat(least, stop - start)
            if later:
                keep &= d > firsts
            if keep.any():
                out = batch.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(firsts[keep])], [*out.schema.names, "first"])

    ordered = rows.repartition(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys, by)
    return ordered.mapInArrow(run, f"{schema}, first long")
