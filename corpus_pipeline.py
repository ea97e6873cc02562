"""Corpus pipeline: toxicity, language, near copies, mixing, packing.

STAGES lists (name, function). Each function takes (spark, docs, sf_dir); all but the last return the columns of
`documents`. A stage's result is written as Parquet (in the folder of spark.checkpoint.dir) and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import language_id, mixing, packing, simhash, toxicity
from tesserae.llm.common import durable, release
from tesserae.llm.queries import held_out, tokenizer_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an expected severity of half a grade or more go."""
    return toxicity.keep_clean(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and mixtures whose main language holds less than 60 % of the text, go."""
    return language_id.keep_identified(docs, language_id.learn(docs.where(~held_out("doc_id"))))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more."""
    return simhash.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken once, twice, or not at all, so that sources reach their shares; each row is one taking."""
    return mixing.mix_documents(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("language_id", language_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: The stages' models and hashes are not expressible in SQL; tests/llm holds them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        made = durable(stage(spark, docs, sf_dir))
        if k:
            release(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
