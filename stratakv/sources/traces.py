"""Readers and writers of trace formats."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lsm import placed_runs

KV_SCHEMA = "type int, keylen int, seq long, scanlength int, key string, valuelen int"
BLOCK_SCHEMA = "rw int, off long, len int"


def read_kv_trace(spark: SparkSession, path: str) -> DataFrame:
    """Text lines 'type keylen seq scanlength key valuelen'; type 1 is SET, 2 GET, others RANGE."""
    rows = spark.read.csv(path, sep=" ", schema=KV_SCHEMA)
    return rows.withColumn("op", F.when(F.col("type") == 1, "SET").when(F.col("type") == 2, "GET").otherwise("RANGE"))


def write_kv_trace(oplog: DataFrame, path: str) -> None:
    kind = F.when(F.col("op") == "SET", 1).when(F.col("op") == "GET", 2).otherwise(3)
    oplog.select(kind, F.length("key"), "seq", F.lit(0), "key", "vlen").write.csv(path, sep=" ")


def read_block_trace(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema=BLOCK_SCHEMA)


def read_bad_blocks(spark: SparkSession, path: str, pairs: bool = False) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema="page long, replacement long" if pairs else "page long")


def parse_resp(rows: DataFrame, column: str = "message") -> DataFrame:
    """(op, key, vlen) of RESP arrays 'SET key value' and 'GET key'."""
    parts = F.split(F.col(column), "\r\n")
    op = F.upper(F.element_at(parts, 3))
    vlen = F.when(op == "SET", F.substring(F.element_at(parts, 6), F.lit(2), F.lit(12)).cast("int"))
    return rows.select("*", op.alias("op"), F.element_at(parts, 5).alias("key"), vlen.alias("vlen"))


def parse_binary(files: DataFrame) -> DataFrame:
    """(type, seq, scanlength, key, vlen) of binary streams in files(content): 1 byte type, 1 byte key length,
    4 bytes sequence, for ranges 4 bytes scan length (big endian), the key, and for sets 4 bytes value length
    (big endian).  One file is one stream and must fit a task."""

    def run(batches: Iterator[pd.DataFrame]):
        for batch in batches:
            for data in batch["content"]:
                yield pd.DataFrame(decode_stream(bytes(data)), columns=["type", "seq", "scanlength", "key", "vlen"])

    return files.select("content").mapInPandas(run, "type int, seq long, scanlength int, key string, vlen int")


def decode_stream(data: bytes) -> list[tuple]:
    out, at = [], 0
    while at + 6 <= len(data):
        kind, length, seq = struct.unpack_from("<BBI", data, at)
        at += 6
        scan, vlen = 0, 0
        if kind == 3:
            (scan,) = struct.unpack_from(">I", data, at)
            at += 4
        key = data[at : at + length].decode("latin-1")
        at += length
        if kind == 1:
            (vlen,) = struct.unpack_from(">I", data, at)
            at += 4
        out.append((kind, seq, scan, key, vlen))
    return out


def encode_stream(rows: list[tuple]) -> bytes:
    out = b""
    for kind, seq, scan, key, vlen in rows:
        raw = key.encode("latin-1")
        out += struct.pack("<BBI", kind, len(raw), seq) + (struct.pack(">I", scan) if kind == 3 else b"") + raw + (struct.pack(">I", vlen) if kind == 1 else b"")
    return out


def pack_stream(rows: pd.DataFrame) -> pd.DataFrame:
    """One stream of rows(kind, seq, scan, key, vlen), in order of seq."""
    ordered = rows.sort_values("seq")
    return pd.DataFrame({"content": [encode_stream(list(zip(*(ordered[c] for c in ("kind", "seq", "scan", "key", "vlen")), strict=True)))]})


def write_levels(entries: DataFrame, path: str, size: int = 510) -> None:
    """Dump levels(level, key, ppa) as sorted runs, a folder a level."""
    runs = placed_runs(entries, "level", size)
    runs.repartition("level", "run").sortWithinPartitions("run", "key").write.partitionBy("level").parquet(path)
