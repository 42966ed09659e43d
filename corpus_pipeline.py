"""The corpus pipeline: documents through five of the operators, each stage written and read again.

All stages take any number of rows, none included, texts of any length, and columns beyond those of documents, which all
but the last pass on. Rows that repeat a doc_id are rows of their own until the second stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, curriculum, jaccard, language, secrets
from weftline.llm.common import stored, table

#: A document whose language's pooled probability is lower is rejected, as is one without a letter.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of no language: null and empty texts, those without a letter, and those whose best language has a pooled probability below LEAST_SCORE. A missing lang is filled with the predicted one; equal texts fare alike. Where nothing could be learned, all documents go."""
    found = language.predict(docs, language.fit(docs), names=("_lang_pred", "_lang_score"))
    found = found.where((F.col("_lang_pred") != language.UNDETERMINED) & (F.col("_lang_score") >= LEAST_SCORE))
    return found.withColumn("lang", F.coalesce("lang", "_lang_pred")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of documents linked by 5-word shingles, and of rows that repeat it with the same text one. Null and blank texts and null doc_ids link with nothing and stay."""
    return jaccard.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts; n_chars follows, null for a null text. All rows stay; repeated rows fare alike."""
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as the mix uses it, 0 to 3 times; ties go by doc_id. Texts without a word, null ones among them, are never used; a null source is a source like any other."""
    return curriculum.schedule(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of decoded texts, a row for each row; a null text counts as empty."""
    return bpe.byte_bpe(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("secret_scan", secret_scan),
    ("mixing", mixing),
    ("byte_bpe", tokenise),
]

#: SQL can't express a trained network.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
