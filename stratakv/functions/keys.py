"""Key and value functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the storage model: page bytes, pages a block, blocks a segment, parallel units.
PAGE, PAGES_PER_BLOCK, BLOCKS_PER_SEGMENT, UNITS = 8192, 256, 64, 64
MASK32 = 0xFFFFFFFF


def encode_key(number, width: int = 12) -> Column:
    """'user' and the zero-padded number."""
    return F.concat(F.lit("user"), F.lpad(F.col(number).cast("string") if isinstance(number, str) else number.cast("string"), width, "0"))


def valid_key(key) -> Column:
    """Not empty, and the first byte below 0x80."""
    return (F.octet_length(key) > 0) & (F.ascii(key) < 128)


def normalise_length(n: Column) -> Column:
    """Applications' key lengths: up to a multiple of 16, less 4; never beyond the key."""
    return F.least(n, F.ceil(n / 16) * 16 - 4).cast("int")


def normalise_key(key: str) -> Column:
    return F.substring(F.col(key), F.lit(1), normalise_length(F.length(key)))


def prefix_end(prefix: str) -> str | None:
    """The least string above all strings with the prefix; None if there is none."""
    points = list(prefix)
    while points:
        last = ord(points[-1]) + 1
        if last <= 0x10FFFF:
            points[-1] = chr(0xE000 if 0xD800 <= last <= 0xDFFF else last)
            return "".join(points)
        points.pop()
    return None


def fold_words(key: str, step: int = 1) -> Column:
    """XOR of the eight 32-bit words of SHA-256 of the key: the 32-bit key hash."""
    digest = F.sha2(F.col(key), 256)
    out = None
    for k in range(0, 8, step):
        word = F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")
        out = word if out is None else out.bitwiseXOR(word)
    return out


def fingerprint(key: str, bits: int) -> Column:
    """Low bits of the XOR of the little-endian words of SHA-256 of the key."""
    digest = F.sha2(F.col(key), 256)
    out = None
    for k in range(8):
        at = 8 * k + 1
        word = F.concat(*[F.substring(digest, at + 2 * b, 2) for b in (3, 2, 1, 0)])
        value = F.conv(word, 16, 10).cast("bigint")
        out = value if out is None else out.bitwiseXOR(value)
    return out.bitwiseAND((1 << bits) - 1)


def probe_slot(hash_: Column, count: Column, slots: int) -> Column:
    """Quadratic probing in 32-bit arithmetic; slot 0 is never used."""
    return (hash_ + count + count * count).bitwiseAND(MASK32) % (slots - 1) + 1


def ppa_parts(ppa: str) -> list[Column]:
    """Parallel unit, page and block of a physical address."""
    p = F.col(ppa)
    return [p.bitwiseAND(63).alias("unit"), F.shiftright(p, 6).bitwiseAND(255).alias("page"), F.shiftright(p, 14).alias("block")]


def grains(length: Column, piece: int) -> Column:
    """Pieces that a value needs."""
    return F.ceil(length / piece).cast("long")


def overwrite(text, patch, offset) -> Column:
    """Bytes from offset (0-based) replaced by the patch."""
    return F.overlay(text, patch, offset + 1)


def bloom_bits(n: Column, p: float) -> Column:
    """Bits of a Bloom filter for n keys at false-positive rate p."""
    import math

    return F.ceil(n * F.lit(math.log(p) / math.log(1 / 2 ** math.log(2)))).cast("long")


def bloom_hashes(bits: Column, n: Column) -> Column:
    import math

    return F.round(F.lit(math.log(2)) * bits / n).cast("long")


def bloom_rate(bits: Column, n: Column, k: Column) -> Column:
    """False-positive rate of a filter of so many bits, with whole bits a key."""
    return F.pow(1 - F.exp(-k / F.floor(bits / n)), k)
