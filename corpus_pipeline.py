"""Corpus preparation in five stages; each reads what the one before it wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.llm import decontaminate, linededup, pieces, simhash, toxicity
from planloom.llm.common import table
from planloom.storage import new_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the factorization machine scores at 0.5 or more."""
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.toxicity_scores(docs, machine, keep=tuple(c for c in COLUMNS if c != "doc_id"))
    return scored.where(F.col("score") < 0.5).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines found in at least ten documents; every document stays, n_chars follows its text."""
    kept = linededup.dedup_lines(docs.select(*COLUMNS), min_docs=10)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by five-word shingle similarity of 0.8 or more."""
    return simhash.drop_near_duplicates(docs.select(*COLUMNS), shingle_words=5, similarity=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of the benchmark."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, decoded again and compared."""
    return pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_ids=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: Learned scores, similarity groups, alignments and tokens have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result goes through a Parquet table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_folder(spark, name)
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
