"""Training-corpus pipeline: quality rules, near-duplicates, benchmark passages, personal data, token ids.

Each stage takes the rows that the stage before kept. Stages are written as Parquet to the shared folder and read again, so that each
runs on stored rows and a lost executor costs no more than its tasks.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm import bpe, decontaminate, personal_data, quality_rules, similar
from umbra.llm.common import drop_stage, stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and that the weighed votes of the quality rules find good."""
    return quality_rules.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies (five-word shingles, similarity of 0.8 or more)."""
    return similar.deduplicated(docs, shingle=5, similarity=0.8)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which passages shared with benchmark items cover less than a twentieth."""
    return decontaminate.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    done = personal_data.cleaned(docs)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of them and of what they decode to."""
    found = bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)
    return found.withColumnRenamed("id", "doc_id")


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("benchmark passages", benchmark_passages), ("personal data", personal), ("token ids", token_ids)]

#: Expectation-maximisation, near-duplicate components and the merges of token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        before, docs = docs, stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_stage(before)
    return STAGES[-1][1](spark, docs, sf_dir)
