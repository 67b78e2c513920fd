"""Substring search over texts and extents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quote(pattern: str) -> str:
    """The pattern as a literal of Java's regular expressions."""
    return re.sub(r"([\\.^$|?*+()\[\]{}-])", r"\\\1", pattern)


def overlapping_count(text, pattern: str) -> Column:
    """Occurrences of a pattern, overlapping ones too; 0 for null texts and empty patterns."""
    if not pattern:
        return F.lit(0).cast("long")
    return F.coalesce(F.regexp_count(text, F.lit("(?=" + quote(pattern) + ")")), F.lit(0)).cast("long")


def count(docs: DataFrame, patterns: list[str]) -> DataFrame:
    """(doc_id, n_0, n_1, ...): one scan for all patterns."""
    return docs.select("doc_id", *[overlapping_count("text", p).alias(f"n_{k}") for k, p in enumerate(patterns)])


def count_in_extents(docs: DataFrame, pattern: str, extent: int) -> DataFrame:
    """(doc_id, n): like a device that sees one extent of characters at a time, so matches across extents are lost."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / extent).cast("int")), lambda k: F.substring(F.col("text"), k * extent + 1, F.lit(extent)))
    n = F.aggregate(F.transform(parts, lambda p: overlapping_count(p, pattern)), F.lit(0).cast("long"), lambda a, b: a + b)
    return docs.select("doc_id", F.coalesce(F.when(F.length("text") > 0, n), F.lit(0)).cast("long").alias("n"))


def read_tree(spark, path: str) -> DataFrame:
    """(file, text): every file below a folder, whole."""
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
