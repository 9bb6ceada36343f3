"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, filter_audit, hard_negatives, language, main_text, packing, quality, secret_scan, shards, sql, surrogate, text_dedup, token_store, vector_dedup
from .shared import table

#: Key of the surrogates in the query; a deployment passes its own secret.
SURROGATE_KEY = b"a key that only the data owner has"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of all documents with all benchmark items."""
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document, learnt from the labels."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of near vectors of a label."""
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that share 85 per cent of their shingles."""
    return text_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for the personal data in them."""
    return surrogate.pseudonymize(table(spark, sf_dir, "documents"), SURROGATE_KEY)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that are not held out."""
    return language.identify_digest(table(spark, sf_dir, "documents"))


def op7_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in random order in eight shards."""
    return shards.shard_digest(shards.shuffle_to_shards(table(spark, sf_dir, "documents")))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, by a ledger of distinct texts."""
    return secret_scan.scan_digest(secret_scan.scan_versions(table(spark, sf_dir, "documents")))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written with a keyed index and read back."""
    return token_store.round_trip(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))


def op10_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as tokens in sequences of at most 2048, with digests of the pieces."""
    digest = F.crc32("ids").alias("ids_crc32")
    return packing.pack(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")), carry=digest)


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return main_text.extract(table(spark, sf_dir, "pages"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in every order, by source, over all documents."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, searched among all vectors."""
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_decontamination, op2_quality_network, op3_vector_near_dedup, op4_minhash_near_dedup, op5_pii_surrogates, op6_language_id, op7_two_pass_shuffle, op8_secret_scan, op9_token_store, op10_residual_packing, op11_main_text, op12_filter_audit, op13_hard_negatives)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return sql.all_sql()
