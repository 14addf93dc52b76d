"""The corpus pipeline: what a training corpus goes through, stage by stage. Part of the subpackage millrace.llm.

Stages judge rows, which they tell apart by number: repeated and null ids are rows like others, extra columns stay, and an
empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, exact_dedup, near_dedup, quality, sentence_pieces
from millrace.llm.common import shared_dir, write_parquet


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents over their language's perplexity limit go, and so do null and empty texts."""
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, that with the smallest doc_id (null: the largest); of ties any one."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates stays, that with the smallest doc_id (null: the largest)."""
    return near_dedup.drop_near_duplicates(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; documents that are mostly such passages go. Null texts stay."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, n_bytes, ids_sha256, round_trip; one row per row. Null texts have no pieces."""
    return sentence_pieces.encode(docs, digest=True)


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("decontamination", benchmark_stage), ("sentence_pieces", pieces_stage)]
#: The stages have models, signatures and automata, which SQL can't express; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        write_parquet(stage(spark, docs, sf_dir), path)
        docs = spark.read.parquet(path)
    return docs.select([F.col(c) for c in docs.columns])
