"""Counts, gates and redacted reports: never a value, only how many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.columns import rx


def hits_by_kind(hits: DataFrame) -> DataFrame:
    return hits.groupBy("kind").agg(F.count("*").alias("hits"))


def residual_counts(residuals: DataFrame) -> DataFrame:
    """Distinct values by kind over the whole run, one column a kind."""
    distinct = residuals.select("kind", "value").distinct()
    return distinct.agg(*[F.count_if(F.col("kind") == k).cast("long").alias(f"residual_{k}") for k in X.RESIDUAL_KINDS])


def severity(residuals: DataFrame) -> DataFrame:
    """high_confidence (addresses, valid IBANs) and warn: distinct values over the run."""
    distinct = residuals.select("kind", "value").distinct()
    high = F.col("kind").isin(X.HIGH_CONFIDENCE)
    return distinct.agg(F.count_if(high).cast("long").alias("high_confidence"), F.count_if(~high).cast("long").alias("warn"))


def per_file_summary(hits: DataFrame, residuals: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """file_ord, hits, hits_by_kind and residual of the files that have any; most hits first."""
    def counts(df: DataFrame, name: str, prefix: str = "") -> DataFrame:
        by_kind = df.groupBy("file_ord", "kind").agg(F.count("*").alias("n"))
        entries = F.array_sort(F.collect_list(F.struct(F.concat(F.lit(prefix), "kind").alias("kind"), "n")))
        return by_kind.groupBy("file_ord").agg(F.sum("n").alias(f"{name}_total"), F.map_from_entries(entries).alias(name))

    h, r = counts(hits, "hits_by_kind"), counts(residuals, "residual", "residual_")
    out = h.join(r, "file_ord", "full_outer").select(
        "file_ord", F.coalesce("hits_by_kind_total", F.lit(0)).cast("long").alias("hits"),
        F.coalesce("hits_by_kind", F.expr("cast(map() as map<string,bigint>)")).alias("hits_by_kind"), "residual",
    )
    if files is not None:
        return out.join(files.select("file_ord", F.col("rel_path").alias("file")), "file_ord").orderBy(F.desc("hits"), "file")
    return out.orderBy(F.desc("hits"), "file_ord")


def probe_words(text: Column) -> Column:
    """The probes among a text's words, each as often as it occurs."""
    words = F.regexp_extract_all(F.lower(text), F.lit(rx(r"\w+")), F.lit(0))
    return F.filter(words, lambda w: w.isin(X.PROBES))


def word_count(words: Column, word: str) -> Column:
    return F.size(F.filter(words, lambda w: w == word))


def prose_damage(hits: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Signs that ordinary prose was rewritten: stop words among names, words that went missing.

    ``documents``: original and text. One row of counts and their total.
    """
    o = F.trim("original")
    named = hits.filter(F.col("kind").isin("name", "org", "username") & (o != ""))
    denied = F.lower(o).isin(X.DENY)
    out = named.agg(F.count_if(denied).cast("long").alias("stopword_name_hits"), F.count_if(~denied & (F.length(o) <= 3)).cast("long").alias("short_name_hits"))
    if documents is None:
        out = out.withColumn("stopword_loss", F.lit(0).cast("long"))
    else:
        changed = documents.filter((F.col("original") != "") & (F.col("original") != F.col("text")))
        # each text is cut into words once; only the probes among them are counted
        changed = changed.select(probe_words(F.col("original")).alias("original"), probe_words(F.col("text")).alias("text")).filter("size(original) > 0")
        lost = F.lit(0)
        for w in X.PROBES:
            lost = lost + F.greatest(F.lit(0), word_count(F.col("original"), w) - word_count(F.col("text"), w))
        loss = changed.agg(F.coalesce(F.sum(lost), F.lit(0)).cast("long").alias("stopword_loss"))
        out = out.crossJoin(loss)  # a row each
    return out.withColumn("total", F.col("stopword_name_hits") + F.col("short_name_hits") + F.col("stopword_loss"))


def ner_status(documents: DataFrame) -> DataFrame:
    """ok if any document's recogniser ran, else skipped if it was asked for, else off."""
    rank = F.max(F.when(F.col("ner_status") == "ok", 2).when(F.col("ner_status") == "skipped", 1).otherwise(0))
    return documents.agg(F.when(rank == 2, "ok").when(rank == 1, "skipped").otherwise("off").alias("ner_status"))


def gate_summary(hits: DataFrame, residuals: DataFrame) -> dict:
    """The detect-only gate's JSON object."""
    by_kind = {r["kind"]: r["hits"] for r in hits_by_kind(hits).collect()}  # a row a kind
    counts = residual_counts(residuals).first().asDict()
    level = severity(residuals).first()
    return {"hits": sum(by_kind.values()), "hits_by_kind": dict(sorted(by_kind.items())), **counts, "high_confidence": level["high_confidence"], "warn": level["warn"]}
