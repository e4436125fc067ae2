"""A training corpus from raw documents: toxic texts out, near copies out, benchmark texts out, personal data masked, sources mixed.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of documents; the last repeats documents as the mix takes them and
numbers the copies. Each stage works on all rows its predecessor kept, with rows as its own operator defines them for
nulls, empty texts, ties, repeated rows and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from laborlake.llm import decontaminate, mixing, near_duplicates, pii, toxicity
from laborlake.llm.columns import table
from laborlake.sources.staging import staged


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the two language models find toxic (a chance of one half or more) go; none where nothing could be learned."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that with the smallest doc_id."""
    return near_duplicates.deduplicate(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts are replaced by their kind; no document goes, and n_chars follows the text."""
    return pii.redact(docs, "n_chars" if "n_chars" in docs.columns else None)


def sources_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, with a number per copy."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("near_duplicates", near_copies_out),
    ("decontamination", benchmark_out),
    ("personal_data", personal_data_masked),
    ("mixing", sources_mixed),
]

#: The stages learn, search and align; SQL doesn't express them. The tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
