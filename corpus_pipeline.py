"""A training corpus in five stages: language, quality, near-duplicates, mixing, encoding.

Every stage reads what its predecessor has written. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import bpe, language, mixing, quality, simhash
from holdfast.session import durable
from holdfast.sources.tables import table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the models know; rejected texts and texts without a letter go."""
    return language.identify(docs).where("not rejected").select("row.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and the verdict; documents labelled good are the trusted ones."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality.rate(docs, trusted).where("kept").select("row.*")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one whose id names the group.

    Of rows with one id one row stays, the first by its text; of groups that have only NULL ids, one row.
    """
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, from none to two times."""
    return mixing.mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text they decode to."""
    return bpe.encode_decode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_stage),
    ("quality rules", quality_stage),
    ("SimHash near-dedup", simhash_stage),
    ("mixing to target weights", mixing_stage),
    ("BPE encoding and decoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    rows = STAGES[-1][1](spark, docs, sf_dir)
    return rows.withColumn("n_tokens", F.size("ids").cast("long"))


#: Fingerprint components and language models are not expressible in SQL.
ORACLE_SQL = None
