"""Corpus pipeline: language ID, near-duplicates, benchmark decontamination, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written to the shared folder as Parquet and read again as the next stage's
``docs``.  All but the last return the columns of ``docs``, whatever columns
these are.

Edge cases, by stage (see the operators for more):

* language: null texts and texts without a letter, and texts whose best
  language has a score under one half, go; a model needs rows with ``lang``,
  without any no document can be identified and all go.
* near_duplicates: empty texts do not reach it; rows that repeat a
  doc_id and its text leave one; rows with a null doc_id stay.
* decontamination: an empty benchmark keeps every row.
* secrets: no row goes; values are replaced in ``text`` and ``n_chars`` follows.
* packing: one row per piece, columns of the operator.

An empty table passes every stage and gives no rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, langid, packing, secrets, simhash
from tessera.llm.store import release_broadcasts, stored
from tessera.session import configure


def _stage(fn):
    """A stage runs on any session: checkpoint folder and code shipping are set up first."""
    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        configure(spark)
        release_broadcasts()  # the stages before are written
        return fn(spark, docs, sf_dir)
    return run_stage


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is identified; learned as in the query, without the held-out fold."""
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"), 4, 2)).select("text", "lang"))
    return langid.accepted(docs, model)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component: shingles of three words, at most three differing bits."""
    return simhash.one_of_each(docs, simhash.SHINGLE, simhash.MAX_BITS)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace the secrets in the texts."""
    return secrets.redact(docs)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 4096 ids."""
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("secret_scan", secret_scan), ("packing", pack)]

#: Models, fingerprints and edit distances are no SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
