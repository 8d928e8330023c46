"""A training corpus from raw documents, in five stages of which each reads what the one before wrote.

1. quality: documents that the quality classifier rejects go.
2. near-duplicates: of each group of linked documents, that with the smallest id stays.
3. decontamination: leaked benchmark passages are cut; a document that holds several items, or mostly leaked words, goes.
4. pii: spans of personal data are replaced by their kind.
5. pieces: texts become SentencePiece ids with byte boundaries.

No SQL can train the classifier or encode pieces, so ``ORACLE_SQL`` is None; ``tests/llm/test_pipeline.py`` compares
the whole pipeline with a plain one in Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import decontam, minhash, pieces, pii, quality
from lexmill.llm.queries import piece_model
from lexmill.llm.scratch import Scratch

SHINGLE, PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs, SHINGLE, PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keep = [c for c in docs.columns if c != "text" and c not in pieces.ADDED]
    return pieces.encode(docs, piece_model(), keep=keep).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality", quality_stage),
    ("near-duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("pieces", pieces_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table documents; a stage's table goes when the next one is written."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        last, docs = docs, scratch.table(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(last)
    return docs
