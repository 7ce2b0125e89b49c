"""Training-corpus pipeline over ``documents``: each stage's rows are written and read by the next.

1. ``language_id`` drops documents without a letter, those whose trigrams fit no
   language of the training texts (other languages, keys, gibberish), and those that score below
   ``LEAST_SCORE``.
2. ``exact_dedup`` keeps the smallest doc_id of equal texts.
3. ``jaccard_join`` keeps the smallest doc_id of each class of near duplicates.
4. ``decontamination`` drops documents that overlap with a benchmark item.
5. ``bpe_codec`` encodes what is left, decodes it, and returns the digests of both.

All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from freightlens.llm.bpe_codec import decode, encode, with_digests
from freightlens.llm.common import table, written
from freightlens.llm.decontaminate import drop_contaminated
from freightlens.llm.exact_dedup import drop_exact_duplicates
from freightlens.llm.jaccard_join import drop_near_duplicates
from freightlens.llm.language_id import keep_identified
from freightlens.llm.queries import VOCABULARY

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: SQL cannot express the language model and BPE; tests hold each stage against brute force.
ORACLE_SQL: str | None = None
#: Below what a text can score where there are one or two families; with more, no family may claim it.
LEAST_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs, LEAST_SCORE)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_duplicates(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_digests(decode(encode(docs, VOCABULARY), VOCABULARY))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("bpe_codec", bpe_codec),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
