"""A corpus pipeline of five operators over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents.  A stage sees all that the one before it kept, and its decisions take effect on the rows:

1. language   drops documents whose language the model cannot tell (no letter, or no text);
2. simhash    keeps one row of each group of near-duplicates: that of least doc_id (null is the largest), then text,
              lang, source and n_chars;
3. phrases    removes words of 13-word passages that start in a document with a smaller doc_id as well; documents
              without such a passage keep their text as it is, those with nothing left go; n_chars is counted anew;
4. mixture    repeats each document as often as its source's budget asks, cut to its first words where the budget
              ends within it; documents beyond the budget go;
5. tokens     encodes and decodes: doc_id, n_tokens, ids_sha256, decoded_sha256 for every row.

Extra columns of the input are dropped by the first stage; missing rows anywhere give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakv.llm import bpe, langid, mixing, phrases, simhash
from stratakv.llm.common import WORD, materialize, prepare, table
from stratakv.llm.queries import _pieces, _tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL has no trained models, heaps or tries; tests hold run() against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = docs.select(*COLUMNS)
    model = langid.train(docs.where(~langid.held_out(4, 2)), _pieces())
    told = langid.predict(docs, model, keep=("text", "lang", "source", "n_chars"))
    return told.where(F.col("lang_pred") != langid.UNKNOWN).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = docs.select(*COLUMNS)
    return simhash.representatives(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    cleaned = phrases.dedup(docs.select(*COLUMNS), keep_text=True).where("n_removed = 0 or n_removed < n_words")
    return cleaned.withColumn("text", F.col("kept")).withColumn("n_chars", F.char_length("kept").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = docs.select(*COLUMNS).withColumn("digest", F.xxhash64("text", "lang", "n_chars")).withColumn("row", F.monotonically_increasing_id())
    docs = materialize(docs, "pipeline-rows")  # doc_ids need not tell rows apart
    plan = mixing.mix(docs, keep=("digest", "row")).where("taken > 0").select("row", "size", "taken")
    rows = docs.join(plan, "row")
    whole, rest = F.expr("cast(taken div size as int)"), F.expr("cast(taken % size as int)")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.expr("cast(ceil(taken / size) as int)"))))
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), rest), " ")
    text = F.when(F.col("copy") <= whole, F.col("text")).otherwise(first)
    n_chars = F.when(F.col("copy") <= whole, F.col("n_chars")).otherwise(F.char_length(first).cast("long"))
    return rows.withColumn("n_chars", n_chars).withColumn("text", text).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return bpe.digests(docs.select("doc_id", "text"), _tokenizer())


STAGES = [("language", language), ("simhash", near_copies), ("phrases", passages), ("mixture", mixture), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what each one but the last returns is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
