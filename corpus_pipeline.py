"""Corpus pipeline over the documents table: language ID, one document of each
near-duplicate group, redaction of personal data, mixing to target weights,
packing. Each stage gets what the one before it wrote; stages but the last
return the columns of documents. Null texts are rejected by the first stage
(no letter); empty tables pass through as empty tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import vulnxml
from vulnxml.llm import lang_id, mixing, packing, pii, simhash
from vulnxml.llm.common import materialise, read_table

# Functions that run in tasks travel with their code: workers need no copy.
cloudpickle.register_pickle_by_value(vulnxml)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents whose language it rejects go."""
    return lang_id.drop_rejected(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: one document of each group stays."""
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: personal data is replaced by its kind."""
    return docs.withColumn("text", pii.redact("text")).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents as often as the fitted rates say."""
    return mixing.mix(docs, read_table(spark, sf_dir, "labels"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: pieces of sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixture), ("packing", packed)]

#: Models and fingerprints aren't expressible in SQL; tests hold each stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what each returns is written to the shared folder
    and read back for the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
