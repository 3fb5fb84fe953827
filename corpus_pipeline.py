"""From raw documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns the columns of
documents; the last returns the pieces that go into the sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratum.llm.byte_tokens import public_path
from stratum.llm.common import materialize, table
from stratum.llm.exact_dedup import drop_exact_duplicates
from stratum.llm.near_dup import drop_near_duplicates
from stratum.llm.packing import pack_documents
from stratum.llm.quality import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose compression ratios are inside the bands."""
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a similarity of 0.8 or more."""
    return drop_near_duplicates(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return pack_documents(docs, public_path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("packing", packing)]

#: SQL cannot express compression ratios and token ids; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
