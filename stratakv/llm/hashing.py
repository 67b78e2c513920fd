"""Vectorised word boundaries and rolling hashes over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

#: Space, and tab to carriage return.
SPACES = b" \t\n\x0b\x0c\r"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Masks of the first 0 to 8 bytes of a little-endian integer.
_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _powers = (both[0], both[1])
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums from which span_hash takes the hash of any slice."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of data[start:stop], equal for equal bytes."""
    return mix((prefix[stop] - prefix[start]) * powers(len(prefix))[1][start])


def item_hash(data: np.ndarray, start: np.ndarray, stop: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of data[start:stop] that mixes eight bytes at a time: equal for equal bytes, and no sum, so that no strings cancel out.

    Meant for many short items; those above 64 bytes go through XXH64 one by one.
    """
    length = stop - start
    out = mix(length.astype(np.uint64) + np.uint64(_BASE ^ seed))
    if not len(out):
        return out
    lanes = np.ndarray(len(data), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    for k in range(0, min(int(length.max()), 64), 8):
        some = np.flatnonzero(length > k) if k else slice(None)
        out[some] = mix(out[some] * np.uint64(_BASE) ^ (lanes[start[some] + k] & _LANE[np.minimum(length[some] - k, 8)]))
    for i in np.flatnonzero(length > 64).tolist():
        from xxhash import xxh64_intdigest

        out[i] = xxh64_intdigest(data[start[i] : stop[i]].tobytes(), seed)
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, first): byte spans of all words, and for each text the number of its first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_IS_SPACE[data]
    edges = np.unique(offsets)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    before[edges[edges < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    inner = edges[(edges > 0) & (edges <= n)] - 1
    after[inner] = False
    start = np.flatnonzero(solid & ~before)
    stop = np.flatnonzero(solid & ~after) + 1
    return start, stop, np.searchsorted(start, offsets)


def gram_hash(items: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive items (at its first item); runs over the end of a text must be masked by the caller."""
    n = len(items) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out *= np.uint64(_BASE)
        out += items[k : k + n]
    return mix(out)


def sequence_hash(items: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of the items[start:stop], which must be spread hashes themselves; equal for equal items."""
    ahead, back = powers(len(items) + 1)
    prefix = np.zeros(len(items) + 1, np.uint64)
    np.cumsum(items * ahead[: len(items)], out=prefix[1:])
    return mix((prefix[stop] - prefix[start]) * back[start])


def run_starts(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, text): where runs of ``size`` items lie within one text; first as words() returns it."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    begun = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)
    return np.arange(len(text)) + begun, text


def window_min(hashes: np.ndarray, size: int) -> np.ndarray:
    """Position of the least of every ``size`` consecutive hashes, by their upper 32 bits and then the first.

    Running minima within blocks of ``size``, from the left and from the right, meet in every window.
    """
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    rows = -(-len(hashes) // size)
    marked = np.full(rows * size, np.iinfo(np.uint64).max, np.uint64)
    marked[: len(hashes)] = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    grid = marked.reshape(rows, size)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[size - 1 : size - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def spaced(data: np.ndarray, start: np.ndarray, stop: np.ndarray, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the words with one space after each, where each word begins there); only kept words, if given."""
    if kept is not None:
        start, stop = start[kept], stop[kept]
    lengths = stop - start
    begin = np.cumsum(lengths + 1) - (lengths + 1)
    out = np.full(int((lengths + 1).sum()), 32, np.uint8)
    source = np.arange(len(out)) + np.repeat(start - begin, lengths + 1)
    last = begin + lengths
    source[last] = 0
    if len(out):
        out = data[source]
        out[last] = 32
    return out, begin
