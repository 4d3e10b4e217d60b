"""A corpus from documents to token ids, in stages that each read what the one before has written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stripelore.llm.bpe import encode_and_decode
from stripelore.llm.common import Scratch, table
from stripelore.llm.mixing import mix_copies
from stripelore.llm.near_dedup import keep_one_of_each
from stripelore.llm.substring_dedup import remove_repeated_spans
from stripelore.llm.toxicity import reject_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents called toxic go."""
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five words, similarity 0.8)."""
    return keep_one_of_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages, of whole sentences or of 50 words, are cut from the texts."""
    return remove_repeated_spans(docs, words=50).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it."""
    return mix_copies(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts, as digests, one row for each copy."""
    return encode_and_decode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("minhash_near_dedup", near_duplicates),
    ("substring_dedup", substrings),
    ("mixing", mixing),
    ("byte_bpe", tokens),
]

#: SQL can't express a trained classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each is written and read again by the next."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        old, docs = docs, scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop(old)
    return docs
