"""The registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op1_mix_sources(spark, sf_dir):
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


ORACLE_SQL["op1_mix_sources"] = r"""
WITH sized AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS total FROM sized GROUP BY source),
caps AS (
  SELECT *, total * CAST(3.0 AS DOUBLE) AS cap,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM totals),
sums AS (
  SELECT *, CAST(sum(total) OVER () AS DOUBLE) AS st, sum(weight) OVER () AS sw,
         coalesce(sum(cap) OVER w, 0) AS cb, coalesce(sum(weight) OVER w, 0) AS wb
  FROM caps WINDOW w AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (st - cb) / (sw - wb) AS level FROM sums),
cut AS (SELECT arg_min(level, cap / weight) AS l FROM levels WHERE level * weight <= cap),
goals AS (
  SELECT source, total, least(cap, coalesce((SELECT l FROM cut) * weight, cap)) AS target FROM levels),
placed AS (
  SELECT s.*, g.total, g.target, coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, source, size, total AS source_size, target,
       CAST(CASE WHEN total > 0 THEN (CAST(floor(target) AS BIGINT) // total) * size
            + least(size, greatest(0, CAST(floor(target) AS BIGINT) % total - before)) ELSE 0 END AS BIGINT) AS taken
FROM placed
"""


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@_query
def op4_bpe(spark, sf_dir):
    from .bpe import digests

    return digests(table(spark, sf_dir, "documents"), _tokenizer())


@_query
def op5_id_files(spark, sf_dir):
    from .idstore import round_trip

    return round_trip(table(spark, sf_dir, "documents"), _tokenizer())


def _pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@_query
def op10_language(spark, sf_dir):
    from pyspark.sql import functions as F

    from .langid import held_out, predict, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(4, 2)), _pieces())
    return predict(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", F.col("score"))


@_query
def op3_simhash(spark, sf_dir):
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@_query
def op7_phrases(spark, sf_dir):
    from .phrases import dedup

    return dedup(table(spark, sf_dir, "documents"))


@_query
def op8_suffixes(spark, sf_dir):
    from .bwt import dedup

    return dedup(table(spark, sf_dir, "documents"))


@_query
def op2_additive_ann(spark, sf_dir):
    from .additive import search

    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"))


@_query
def op9_multi_index(spark, sf_dir):
    from .multiindex import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


@_query
def op6_toxicity(spark, sf_dir):
    from .langid import held_out
    from .toxicity import score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = train(docs, labels.where(~held_out(3, 1)))
    return score(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "score", "predicted")
