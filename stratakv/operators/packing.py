"""Variable-size values into pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack(values: DataFrame, pieces: int = 16) -> DataFrame:
    """(batch, page, used, n) of values(batch, seq, size in pieces): the largest value that still fits goes next.

    Which value goes next depends only on how many of each size are left, so a batch is reduced to counts by
    size before one task fills its pages.
    """
    import pandas as pd

    def fill(key, rows):
        left = dict(zip(rows["size"], rows["n"], strict=True))
        out, page = [], 0
        while left:
            room, used, n = pieces, 0, 0
            for size in sorted(left, reverse=True):
                k = min(left[size], (room - used) // size)
                used, n = used + k * size, n + k
                left[size] -= k
            left = {s: c for s, c in left.items() if c}
            if not n:
                break
            out.append((key[0], page, used, n))
            page += 1
        return pd.DataFrame(out, columns=["batch", "page", "used", "n"])

    counts = values.where(F.col("size") <= pieces).groupBy("batch", "size").agg(F.count("*").alias("n"))
    return counts.groupBy("batch").applyInPandas(fill, "batch long, page long, used long, n long")
