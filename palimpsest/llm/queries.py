"""The registered query of each operator, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, extract_html, langid, mixing, neardup, quality, syncmers, toxicity, url_reputation, wavelet
from .common import crc_bucket, held_out

RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def learning_rows(df: DataFrame, modulus: int, remainder: int) -> DataFrame:
    """Rows with an id whose crc32 is not held out."""
    return df.filter(crc_bucket(F.col("doc_id"), modulus) != remainder)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, learning_rows(table(spark, sf_dir, "labels"), 5, 0))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted", "neighbours")


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled pages: a url's path names the document it shows, whose labels are its outcome."""
    pages = table(spark, sf_dir, "pages").select(
        url_reputation.host_of(F.col("url")).alias("host"),
        F.expr("try_cast(regexp_extract(url, '://[^/?#]*/[^/?#]*/([0-9]{1,18})', 1) as bigint)").alias("doc_id"),
    )
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("good"))
    return pages.filter("doc_id is not null").join(labels, "doc_id").select("host", "good")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge_urls(table(spark, sf_dir, "pages"), page_outcomes(spark, sf_dir), RULES)


def op3_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_table(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), spans=False)
    ids = F.array_join(F.array_sort("item_ids"), ",")
    n = F.size("item_ids").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (n >= 2).alias("contaminated"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_html.extract(table(spark, sf_dir, "pages"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    predicted = langid.predict_language(docs, langid.fit(learning_rows(docs, 4, 2)))
    return predicted.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, learning_rows(table(spark, sf_dir, "labels"), 3, 1))
    return quality.score_quality(docs, model).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_toxicity, op2_url_filters, op3_wavelet_tokens, op4_syncmers, op5_decontamination, op6_html_extraction, op7_near_duplicates, op8_mixing, op9_language, op10_quality, pipeline]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)


__all__ = ["queries", "oracle_sql"]
