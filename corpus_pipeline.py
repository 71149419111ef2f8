"""A training-corpus pipeline: five stages over ``documents``, each written and read again.

Defined results: every stage takes null ids, texts and sources, empty and very long texts,
repeated rows, empty tables and further columns. A null or empty text is scored like any
other by the first stage, has no words for the next two (so it is no copy, and clean), and
size 0 in the mix; its tokens are the end id alone. Of rows that repeat an id the second
stage keeps one. Ties: a score on the threshold is accepted; the least id of a group stays;
documents that share a hash are mixed together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import decontaminate, mixing, neardup, quality, wavelet
from palimpsest.llm.common import drop_stash, stash
from palimpsest.llm.queries import table, tokenizer_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking accepts."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.without_near_duplicates(docs)


def decontamination_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of any benchmark item occurs."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in wavelet shards, read back: a row per document."""
    return wavelet.token_table(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_filter),
    ("minhash near-dedup", near_duplicate_filter),
    ("benchmark decontamination", decontamination_filter),
    ("mixing to target weights", source_mix),
    ("token ids", token_output),
]

#: Learnt scores, MinHash and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_stash(before)  # written anew by then
    return docs
