"""Corpus pipeline over ``documents``: toxicity filter, language filter, near duplicates, repeated passages, packing.

Each stage works on everything that the one before has kept; its result is written as
Parquet into the shared checkpoint folder and read again.  All stages but the last return the columns of documents.

* toxicity: rows predicted toxic go (operator 8).
* language: rows without a letter, and rows of which no language makes up ``LEAST_SHARE``, go (operator 2).
* near_duplicates: of the rows whose 5-word shingle sets reach a similarity of 0.8, directly or by
  links, the one with the smallest id stays (operator 10; a row is told by id and text, null ids come last); rows without words stay.
* passages: bytes covered by a 100-byte string that occurs earlier are cut from the text, and
  n_chars is counted anew; rows stay, also if nothing of their text is left (operator 1).
* packing: every piece of what is left with its sequence and place (operator 3).

Columns beside doc_id and text travel as one struct, so extra columns may have any names, also those that an operator
uses or adds, and come out as they went in.

SQL can't express the stages, so ORACLE_SQL is None; the tests hold the last three against brute force, and the two filters
on planted rows and held-out accuracy.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import langid, packing, setjoin, suffix, toxicity
from vigil.llm.common import packed, ship, table, unpacked
from vigil.session import checkpoint_dir

LEAST_SHARE = 0.4
TOKENIZER = "byte_bpe_50k.json"
ORACLE_SQL = None


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    found = toxicity.score(packed(docs), table(spark, sf_dir, "labels"), ["row", "text"])
    return unpacked(found.where("predicted = 0"), docs.columns)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    found = langid.identify(packed(docs, "lang"), ["row", "text"])
    return unpacked(found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SHARE)), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return unpacked(setjoin.one_of_each(packed(docs), 5, 80, 100), docs.columns)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    found = suffix.removed(packed(docs), keep=["row"]).withColumnRenamed("kept_text", "text")
    return unpacked(found, docs.columns, n_chars=F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", remove_toxic),
    ("language", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("passages", cut_passages),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage."""
    root = f"{checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.mode("errorifexists").parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
