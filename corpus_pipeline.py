"""The corpus pipeline: documents through five operators, each stage written as Parquet and read again.

Language identification drops what it rejects, the n-gram join keeps one document of each
group, decontamination drops documents that hold a benchmark item, the secret scan masks what
it finds, and packing lays the rest out in training sequences.

Defined cases: null and empty texts have no language and go with the first stage; a document that
it identifies is kept whatever its ``doc_id`` is (null and repeated ones too); of repeated
rows a single one stays, but rows without a doc_id aren't compared and all stay; all stages but the last carry every column of ``documents``,
also ones whose names a stage uses itself; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from briefloom.llm import decontaminate, langid, ngram_join, packing, secrets
from briefloom.llm.common import dropped, table, written

#: The stages aren't SQL: compression, MinHash, LSH, entropy and a linear program.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by a margin; texts without a letter go."""
    return langid.identified(docs, langid.trained_on(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies; a doc_id that stands on several texts is judged by text."""
    return ngram_join.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked and ``n_chars`` counted anew where there were any."""
    return secrets.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, in training sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_masking),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's table goes when the next one is written, the last one's stays for the rows returned."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        if k:
            dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
