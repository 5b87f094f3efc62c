"""A training corpus from raw documents: filter, deduplicate, mask, mix and pack.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyward.llm import minhash, mixing, packing, pii, quality_rules
from tallyward.llm.common import Tables, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failing lines."""
    return quality_rules.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 of five-word shingles."""
    return minhash.drop_near_duplicates(docs, size=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training bins."""
    return packing.pack_documents(docs, keep=("lang", "source"))


STAGES = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_dedup),
    ("pii", personal_data),
    ("mixing", mixture),
    ("packing", packed),
]

#: Shingle links and best-fit bins are beyond SQL; tests/llm/test_pipeline.py compares run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    tables = Tables(spark, "pipeline")
    for _, stage in STAGES:
        docs = tables.put(stage(spark, docs, sf_dir))
        tables.drop(docs)  # the stages before
    return docs
