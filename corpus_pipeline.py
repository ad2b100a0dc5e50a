"""From raw documents to packed training sequences, in five stages; each works on all that its predecessor kept.

    quality rules      documents that fail the base rules, or a rule for which their host's verdict is bad, go
    near duplicates    of each component of SimHash fingerprints the document with the least doc_id stays
    decontamination    documents that hold a passage of the benchmark go
    secrets            found secrets are replaced by [SECRET] in the texts
    packing            documents become pieces of sequences of 1024 tokens, in the order of a Hilbert curve

All stages but the last return the columns of documents. Repeated rows, nulls and empty tables are as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import decontaminate, host_quality, packing, secret_scan, simhash
from vellum.llm.common import table
from vellum.llm.tokens import default_path
from vellum.session import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return host_quality.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redacted(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, default_path())


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", sequences),
]

#: Fingerprints, secrets' tests and token ids aren't SQL; tests/llm/test_pipeline.py has a plain version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the last stage. What stages return is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
