"""A corpus pipeline of five operators over ``documents``; each stage reads what the one before it wrote.

Language ID writes the language that it finds into ``lang`` and rejects texts in which it finds none; line dedup takes
out repeated lines, and documents that have nothing else; of each class of near-duplicates one document stays; secrets
are replaced; what is left is packed into sequences.

Null texts go in the first stage, empty ones as well; an empty table stays empty through all stages. A document is a
row: rows that repeat one, nulls among them, are one document from the third stage on. Other columns of documents are
carried along, whatever their names.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language, lines, ngram_join, packing, secrets
from tessera.llm.shared import lean, own_tables, row_key, shared_folder, unused

#: The least share of a text's words that language ID knows, or knows by n-grams of three letters and more. Of the
#: labelled languages' texts none is below 0.9, short ones included; texts of other scripts are at 0.
MIN_KNOWN = 0.5


def _with_size(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*columns) if "n_chars" in columns else docs.select(*columns)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    name = unused(docs, "__lang_pred")
    found = language.predict(docs, language.fit(docs), name=name)
    kept = found.where((F.col(name) != language.UNKNOWN) & (F.col(f"{name}_known") >= MIN_KNOWN))
    return kept.withColumn("lang", F.col(name)).select(*docs.columns)


def drop_line_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    found = lines.line_dedup(docs)
    return _with_size(found.where((F.col("lines_removed") == 0) | (F.trim("text") != "")), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a class the document with the smallest id stays, without ids the one with the smallest key; of rows that repeat it, one.

    It goes by documents (ids and texts), not by ids: an id that several texts bear is several documents.
    """
    lean(spark)
    key, gone = unused(docs, "__key"), unused(docs, "__gone")
    copies = ngram_join.ngram_join(docs).where("not first").select(F.col("rkey").alias(gone)).distinct()
    rows = docs.withColumn(key, row_key())
    return rows.join(copies, F.col(key) == F.col(gone), "left_anti").dropDuplicates([key]).select(*docs.columns)


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    name = unused(docs, "found")
    found = secrets.secret_scan(docs, redact=True, name=name)
    return _with_size(found.withColumn("text", F.col(f"{name}.redacted")), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    return packing.best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", keep_languages),
    ("line_dedup", drop_line_copies),
    ("ngram_join", drop_near_copies),
    ("secret_scan", replace_secrets),
    ("best_fit_packing", pack_sequences),
]
#: SQL can't express the fitted model, the edit join, the learned packing; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; the tables that a stage has written for itself go then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        with own_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
