"""From raw documents to packed training sequences, stage by stage.

Each stage is a function (spark, docs, sf_dir) to a DataFrame; what it returns is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixloom.llm import mixing, packing, pii, quality, similar, simhash
from helixloom.llm.common import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the likelihood ratio keep; others go."""
    return quality.quality_filter(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more), that with the least id.

    SimHash brings candidates together, texts decide them, and what it leaves apart is completed exactly."""
    return simhash.first_rows(docs, similar.groups(docs.select("doc_id", *simhash.row_name(), "text")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by kinds."""
    return pii.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, twice where they are taken twice."""
    return mixing.mixed(docs)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their bins; copies that the mix took never share one."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("PII", personal_data),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", best_fit),
]

#: The stages draw samples, link shingle sets and pack bins, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, _ = materialize(docs, f"pipeline-{k}")
    return docs
