"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import (
    alignment,
    arrow_sequences,
    bpe,
    decontamination,
    hard_negatives,
    language,
    licences,
    mixing,
    neighbours,
    quality,
    simhash,
    token_counts,
    url_filter,
)
from holdfast.sources.tables import table


TOKEN_LIMIT = 512


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document, and whether they are more than a model's context."""
    counts = token_counts.count_tokens(table(spark, folder, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op2_licences(spark: SparkSession, folder: str) -> DataFrame:
    """Licence paragraphs of every document."""
    docs = table(spark, folder, "documents")
    return licences.scan(docs, licences.train(docs))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document written to and read back from Arrow files of fixed-size lists."""
    docs = arrow_sequences.round_trip(table(spark, folder, "documents"))
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of every document."""
    taken = mixing.taken_words(table(spark, folder, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def op6_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors found of every twentieth vector."""
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as it was fetched, against the list entries valid at that time."""
    pages, events = table(spark, folder, "pages"), table(spark, folder, "events")
    found = url_filter.filter_captures(url_filter.page_captures(pages, events), url_filter.page_list_changes(pages, events))
    return found.withColumn("fetched_at", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document, decoded again; both as digests."""
    docs = bpe.encode_decode(table(spark, folder, "documents"))
    return docs.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document, learned from the documents that are not held out."""
    docs = table(spark, folder, "documents")
    found = language.identify(docs, keep=["doc_id"])
    return found.select(
        "row.doc_id", F.coalesce(language.fold(F.col("row.doc_id")) == 0, F.lit(False)).alias("held_out"),
        "lang_pred", "score", "cross_entropy", "rejected")


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality rules and verdict of every document; documents labelled good are the trusted ones."""
    trusted = table(spark, folder, "labels").where("quality = 1")
    rated = quality.rate(table(spark, folder, "documents"), trusted, keep=["doc_id"])
    return rated.select("row.doc_id", "rules.n_words", "rules.word_chars", "rules.n_symbols", "rules.n_dup_lines",
                        "rules.n_repeat_words", "rules.base_failed", "kept", "rules.score")


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Alignment of every document's tokens by two tokenizers, and its links against the corpus'."""
    return alignment.link_statistics(table(spark, folder, "documents"))


def op12_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = decontamination.find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector, on components in whole 256ths and with a seventh of the labels moved."""
    vectors = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    # Doubles from 2^53 on are whole; beyond the largest double its sign and size stay.
    whole = F.transform("embedding", lambda x: hard_negatives.whole_256ths(x.cast("double")))
    return hard_negatives.mine(vectors.select("vec_id", moved.alias("label"), whole.alias("vector")), F.col("vec_id") % 100 == 0)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_licences": op2_licences,
        "op3_simhash": op3_simhash,
        "op4_token_files": op4_token_files,
        "op5_mixing": op5_mixing,
        "op6_neighbours": op6_neighbours,
        "op7_url_filter": op7_url_filter,
        "op8_bpe": op8_bpe,
        "op9_language": op9_language,
        "op10_quality": op10_quality,
        "op11_alignment": op11_alignment,
        "op12_decontamination": op12_decontamination,
        "op13_hard_negatives": op13_hard_negatives,
    }


def llm_oracle() -> dict[str, str]:
    """SQL of the queries that SQL can express."""
    return {"op5_mixing": mixing.MIX_SQL, "op7_url_filter": url_filter.FILTER_SQL,
            "op12_decontamination": decontamination.CONTAMINATION_SQL,
            "op13_hard_negatives": hard_negatives.MINING_SQL}
