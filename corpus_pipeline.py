"""A corpus pipeline: language ID, near-copies, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a stage returns to the shared folder and reads it back for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, langid, mixing, near_copies as copies, token_output
from loomgraph.llm.common import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.5  # below this no language has a majority, and the document is rejected


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (null and empty texts too) or without a predicted language of LEAST_SCORE; ``lang`` keeps its value, null or not.

    Each row is judged by its own text, so repeated rows stay or go together. An empty table, or one without labels, keeps nothing.
    """
    model = langid.train(docs.where(~langid.held_out()).select("text", "lang"))
    found = langid.predict(docs.select(*COLUMNS), model)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles are .8 alike or more, found by SimHash tries, the row with the smallest id (null last) stays.

    Several texts under one id are documents of their own; of repeated rows one stays. Null and blank texts are one group. An empty table stays empty.
    """
    return copies.drop_near_copies(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents. Null and empty texts have no word and stay, repeated rows go together; an empty benchmark or table drops nothing."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contamination(docs.select(*COLUMNS), benchmark).where("not contaminated").select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights; a document that a second epoch takes again comes twice. Documents without words go, null lang and source are leaves of their own."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), read back from the written token files: null ids first, rows of one id by their texts' hash, null text as an end id alone."""
    return token_output.token_output(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("near_copies", near_copies), ("decontamination", decontamination), ("source_mixing", source_mixing), ("token_output", tokens)]
ORACLE_SQL = None  # SimHash and the tokenizer are beyond SQL; tests hold each stage's decisions against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
