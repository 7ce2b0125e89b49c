"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from freightlens.llm import piece_codec
from freightlens.llm.bpe_codec import decode, encode, with_digests
from freightlens.llm.common import table
from freightlens.llm.decontaminate import overlaps
from freightlens.llm.exact_dedup import exact_duplicates
from freightlens.llm.jaccard_join import jaccard_links
from freightlens.llm.language_id import identify
from freightlens.llm.license_scan import scan_licenses
from freightlens.llm.lm_score import score_texts
from freightlens.llm.merkle import manifest
from freightlens.llm.quality import score_quality
from freightlens.llm.token_counts import count_tokens
from freightlens.llm.url_filter import judge_urls
from freightlens.llm.whitening import whiten

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_links(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), VOCABULARY)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), VOCABULARY)


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digests(decode(encode(table(spark, sf_dir, "documents"), VOCABULARY), VOCABULARY))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).drop("component")


def op11_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_codec.encode(table(spark, sf_dir, "documents"), PIECES)
    return piece_codec.with_digests(piece_codec.decode(coded, PIECES))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_jaccard_join,
        op2_token_counts,
        op3_exact_dedup,
        op4_language_id,
        op5_lm_score,
        op6_bpe_codec,
        op7_quality,
        op8_license_scan,
        op9_decontamination,
        op10_url_filter,
        op11_piece_codec,
        op12_merkle_manifest,
        op13_whitening,
    )
    return {f.__name__: f for f in named}
