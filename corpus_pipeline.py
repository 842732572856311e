"""The corpus pipeline: five stages, each one training-data operator over all documents.

Quality classifier, SimHash near-duplicates, benchmark decontamination, personal data,
best-fit packing. Every stage gets what its predecessor kept, written as Parquet to the
shared folder and read again, so a lost executor costs one stage's tasks at most; what a
stage wrote on the way goes with it. All stages but the last return the columns of
``documents``. Null and empty texts pass every stage that doesn't judge them worthless or
copies of each other; an empty table gives no sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontaminate, packing, pii, quality, simhash_dedup
from factloom.llm.common import drop_cut, read_table, settled


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt on these documents' labels, doesn't reject."""
    return quality.keep_quality(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates."""
    return simhash_dedup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens, a row a piece."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("best-fit packing", packing_stage),
]

#: A classifier, fingerprints of hashes, templates and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept = settled(spark, lambda: stage(spark, docs, sf_dir))  # noqa: B023  called at once
        drop_cut(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
