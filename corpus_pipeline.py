"""Corpus pipeline: toxicity, language identification, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return the
columns of documents. `run` writes each result to the shared folder as Parquet and reads it again for the next stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlens.llm import langid, toxicity
from shotlens.llm.common import table
from shotlens.llm.neardup import near_duplicates
from shotlens.llm.packing import pack_documents
from shotlens.session import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labelled examples don't predict to be toxic. Clean, empty and null texts stay."""
    scored = toxicity.score_corpus(spark, docs, table(spark, sf_dir, "labels"), ~toxicity.held_out(), keep=COLUMNS[1:])
    return scored.where("predicted = 0").select(*COLUMNS)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages: those without a letter go."""
    model = langid.fit(spark, docs, ~langid.held_out())
    return langid.identify(spark, docs, model, keep=COLUMNS[1:]).where(F.col("lang_pred") != langid.UNKNOWN).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest id. Rows of a null id stay, as do repeated rows of one id."""
    gone = near_duplicates(spark, docs).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("kept")).where("NOT kept").select("doc_id")
    return docs.join(materialise(spark, gone, "duplicates"), "doc_id", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of 4096."""
    return pack_documents(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("language", keep_languages), ("near_duplicates", drop_near_duplicates), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = materialise(spark, stage(spark, docs, sf_dir), name)
    return docs


#: SQL can't express the toxicity and language models; tests hold the stages against brute force.
ORACLE_SQL = None
