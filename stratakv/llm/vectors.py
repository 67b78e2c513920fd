"""Shared by the operators on vectors: which take part, batches as matrices, k-means on a bounded sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(column: str):
    """True for a vector that is not null, not zero and holds neither nulls nor non-finite components."""
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def dimensions(vectors: DataFrame, column: str = "embedding") -> list[int]:
    """The lengths that occur; vectors of different lengths are never compared."""
    return sorted(r[0] for r in vectors.groupBy(F.size(column)).count().collect())


def matrix(column: pa.Array, dim: int, kind=np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(top > 0, top, 1)  # no overflow in the squares
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def sample(vectors: DataFrame, dim: int, bound: int, n: int, key: str = "vec_id", seed: str = "sample") -> np.ndarray:
    """About ``bound`` rows, the same in every run, as a float64 matrix."""
    share = min(1.0, bound / max(n, 1))
    near = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)
    rows = vectors.where(near).select(key, "embedding").limit(2 * bound).collect()
    rows.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    return np.array([r[1] for r in rows], np.float64).reshape(-1, dim)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k centres (fewer, if there are fewer rows) by Lloyd's iterations; empty centres restart at far rows."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near, dist = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        sizes = np.bincount(near, minlength=k)
        empty = np.flatnonzero(sizes == 0)
        centres = sums / np.maximum(sizes, 1)[:, None]
        if len(empty):
            centres[empty] = x[np.argsort(-dist)[: len(empty)]]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = squares(x, centres)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at]


def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)
