"""A training-data pipeline of five of the operators, each stage over all that its predecessor kept.

Quality rules drop documents, near-duplicate detection keeps one document of each group, benchmark
decontamination drops documents that contain test items, personal data are masked in the texts, and
the remaining documents are packed into sequences of token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerscope.llm.decontaminate import contained_items, without_ids
from ledgerscope.llm.near_dup import without_duplicates
from ledgerscope.llm.packing import packed_documents
from ledgerscope.llm.pii import redact
from ledgerscope.llm.quality_rules import without_rejected
from ledgerscope.session import materialize

#: Near-duplicates of a corpus: this share of common five-word shingles or more; op7 alone asks for 85.
NEAR_PERCENT = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_rejected(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_duplicates(docs, percent=NEAR_PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_ids(docs, contained_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_documents(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal data", pii_stage),
    ("packing", packing_stage),
]

#: Tokenisation by a vocabulary file and MinHash can't be written in SQL; the tests hold the pipeline
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
