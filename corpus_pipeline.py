"""A training corpus from ``documents``: five stages, each over all rows its
predecessor kept, written as Parquet and read again in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtext.llm import decontaminate, langid, packing, pii, simhash
from loomtext.llm.common import documents, table
from loomtext.runtime import written


# Each stage returns all columns of ``docs`` as they are, extra ones included,
# and takes null, empty and very long texts, repeated rows and empty tables; what
# becomes of such rows stands with the function that it calls.


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null, empty and wordless texts go."""
    return langid.identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least doc_id, a
    null one last. Rows equal in doc_id and text stay once."""
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no 13 words in a row with the benchmark. Null and
    empty texts stay, as do all rows where the benchmark is empty."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, identifiers replaced by their kind and n_chars brought up to date."""
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The windows: every character of every text in exactly one of them."""
    return packing.packs(docs)


STAGES = [
    ("language ID", language),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("PII", private),
    ("packing", pack),
]

#: SimHash and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written and read again."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, _ = written(docs, f"pipeline-{k}")
    return docs
