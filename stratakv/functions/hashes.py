"""Public 32-bit hashes, vectorised; used where a filter must agree with other implementations."""

from __future__ import annotations

import numpy as np


def _rotate(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint32(r)) | (x >> np.uint32(32 - r))


def murmur3(keys: list[bytes], seed: int = 2) -> np.ndarray:
    """MurmurHash3 x86-32 of every key; keys of equal length are hashed together."""
    out = np.zeros(len(keys), np.uint32)
    lengths = np.array([len(k) for k in keys])
    c1, c2 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)
    with np.errstate(over="ignore"):
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            data = np.frombuffer(b"".join(keys[i] for i in rows), np.uint8).reshape(len(rows), n)
            h = np.full(len(rows), seed, np.uint32)
            body = int(n) // 4 * 4
            blocks = np.ascontiguousarray(data[:, :body]).view("<u4")
            for b in range(body // 4):
                k = _rotate(blocks[:, b] * c1, 15) * c2
                h = _rotate(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
            if n > body:
                k = np.zeros(len(rows), np.uint32)
                for b in range(int(n) - body):
                    k |= data[:, body + b].astype(np.uint32) << np.uint32(8 * b)
                h ^= _rotate(k * c1, 15) * c2
            h ^= np.uint32(n)
            h ^= h >> np.uint32(16)
            h *= np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
            h *= np.uint32(0xC2B2AE35)
            out[rows] = h ^ (h >> np.uint32(16))
    return out


def bit_positions(hashes: np.ndarray, bits: int, k: int) -> np.ndarray:
    """(keys, k) positions in a filter of so many bits: the hash is perturbed by the round and finalised again."""
    rounds = np.arange(k, dtype=np.uint32) << np.uint32(7)
    x = hashes[:, None] | rounds[None, :]
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint32(16))) * np.uint32(0x45D9F3B)
        x = (x ^ (x >> np.uint32(16))) * np.uint32(0x45D9F3B)
    return ((x ^ (x >> np.uint32(16))).astype(np.uint64) % np.uint64(bits)).astype(np.int64)


def mix32(value):
    """A 32-bit integer mixer as a Column of longs; sums and shifts wrap at 32 bits.

    Fixed values: constants and shifts of the public six-step mixer, in order.
    """
    from pyspark.sql import functions as F

    steps = [(0x7ED55D16, "+", "<", 12), (0xC761C23C, "^", ">", 19), (0x165667B1, "+", "<", 5), (0xD3A2646C, "+^", "<", 9), (0xFD7046C5, "+", "<", 3), (0xB55A4F09, "^", ">", 16)]
    mask = F.lit(0xFFFFFFFF)
    a = value.cast("long").bitwiseAND(mask)
    for constant, how, way, by in steps:
        moved = F.shiftright(a, by) if way == ">" else F.shiftleft(a, by).bitwiseAND(mask)
        left = a.bitwiseXOR(F.lit(constant)) if how == "^" else (a + F.lit(constant)).bitwiseAND(mask)
        a = (left + moved).bitwiseAND(mask) if how == "+" else left.bitwiseXOR(moved)
    return a
