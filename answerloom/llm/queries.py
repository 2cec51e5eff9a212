"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import langid, lmscore, media, packing, piecesample, prefixhash, secretscan, simhash, tokenfile, warc


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file; ANSWERLOOM_TOKENIZERS names another folder."""
    folder = os.environ.get("ANSWERLOOM_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_warc_gzip_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(spark, warc.archive_pages(table(spark, sf_dir, "pages")))


def op3_png_media_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_media_features(table(spark, sf_dir, "documents"))


def op4_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_ftrl_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.trained_model(docs))


def op6_markov_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.secret_report(table(spark, sf_dir, "documents"))


def op7_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, files = tokenfile.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return tokenfile.read_token_files(spark, folder, files)


def op8_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecesample.segmentation_digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_prefix_hash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixhash.edited_fingerprints(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_retrieval_packing,
        op2_warc_gzip_normaliser,
        op3_png_media_hashes,
        op4_cross_entropy_difference,
        op5_ftrl_language_id,
        op6_markov_secret_scan,
        op7_huffman_token_files,
        op8_sampled_pieces,
        op9_simhash_near_duplicates,
        op10_prefix_hash_fingerprints,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc_gzip_normaliser": """
            WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
            d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
            r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM d)
            SELECT page_id, payload_bytes, payload_digest,
                   CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN first_id <> page_id THEN first_id END AS refers_to
            FROM r""",
    }
