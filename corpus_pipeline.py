"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. ``run`` writes each stage's result as Parquet
in the shared folder and reads it again for the next, so a lost executor costs part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelens.llm import bpe, decontam, pii, quality, simhash
from tracelens.llm.common import materialize, read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the risk-controlled cutoffs keep.

    Null and empty texts go, a null lang is a stratum of its own, repeated rows go or stay together, labels of no document count for nothing, and
    without labels only the base rules reject. All columns stay; see ``quality.keep`` for the names it takes.
    """
    return quality.keep(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group: that with the smallest doc_id, null ids last; of rows that share it any one.

    Null and empty texts are one group. All columns stay, whatever their names but __row.
    """
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark. Null and empty texts stay, repeated rows go or stay together, and all columns stay."""
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind in brackets and n_chars counted anew.

    Null texts stay null, rows stay one to one, and all columns stay; names that begin with __pii_ are taken.
    """
    return pii.redact(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the text decoded from them, and the ids (little-endian unsigned 32-bit).

    Null and empty texts have no ids; repeated rows each give a row; other columns are left behind.
    """
    return bpe.digest(bpe.encode_documents(docs), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("token ids", token_ids),
]

#: SQL can't express fingerprints, components or merges; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not token_ids:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
