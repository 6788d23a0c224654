"""A training-data pipeline over `documents`: toxicity, near-duplicates, personal data, mixing, BPE.

Each stage takes what the one before it kept. All but the last return the columns of documents; nulls and other columns
pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, mixing, pii, simhash, toxicity
from tessella.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.7 or more go."""
    scored = toxicity.score(docs, toxicity.learn(spark, sf_dir), keep=tuple(docs.columns), offsets=False, out="__score")
    return scored.where("__score < 0.7").drop("__score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (Jaccard index of five-word shingles 0.8 or more) stays, that of the smallest doc_id."""
    return simhash.one_of_each_group(docs, shingle=5, likeness=0.8)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts gives way to its kind in brackets; n_chars follows the text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn by probabilities calibrated to source, language and topic targets."""
    return mixing.mix(docs).where("kept").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their count, their digest and that of the text decoded from them."""
    return bpe.encode_decode(docs, bpe.tokenizer_path(), ids=True, back=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can't express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, work.save(stage(spark, docs, sf_dir))
        if k:
            work.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
