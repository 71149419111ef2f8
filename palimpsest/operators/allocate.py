"""Stable tokens: one long map table, allocated in order of first appearance.

The map has a row per known value: kind, key (its normal form), token, n (its number),
and where it was first seen (file_ord, pass, pos; -1 for entries loaded from before).
Numbers are dense per kind and do not depend on partitioning: first appearances are found
with map-side aggregation, ranked inside blocks of documents, and only the blocks' counts
are summed in order, so no task sees all values of a kind.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import textops

MAP_SCHEMA = "kind string, key string, token string, n int, file_ord long, pass int, pos long"
FOUND = "file_ord long, pass int, pos long, kind string, key string, value string"
BLOCK = 8192


def empty_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MAP_SCHEMA)


def allocation_key(kind: Column, key: Column) -> Column:
    """Names and organisations that differ by case share a token."""
    return F.when(kind.isin("person", "org"), F.lower(key)).otherwise(key)


def token_text(kind: Column, n: Column, key: Column, value: Column) -> Column:
    """The token of a number: widths are least widths, and grow."""
    three = F.format_string("%03d", n)
    two = F.format_string("%02d", n)
    email = F.concat(F.when(key.startswith("uhmaskedaddr_"), F.lit("UHMASKEDADDR_")).otherwise(F.lit("")), F.lit("user_"), three, F.lit("@example.test"))
    ip = F.when(key.contains(":"), F.concat(F.lit("2001:db8::"), F.lower(F.hex(n.cast("long"))))).otherwise(F.concat(F.lit("203.0.113."), n % 254 + 1))
    postcode = F.concat(F.when(value.contains(" ") | (F.length(value) > 6), F.lit("9999 XX")).otherwise(F.lit("9999XX")), two)
    plain = {"username": "username_", "person": "PERSON_", "org": "ORG_", "phone": "PHONE_", "iban": "IBAN_", "machine": "MACHINE_", "path": "PATH_", "cmd": "CMD_", "cert": "CERT_"}
    out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "postcode", postcode)
    out = out.when(kind == "bsn", F.concat(F.lit("0000000"), two))
    out = out.when(kind == "mac", F.concat(F.lit("00:00:5e:00:53:"), F.lower(F.format_string("%02x", n))))
    out = out.when(kind == "dob", F.concat(F.lit("1900-01-"), F.format_string("%02d", n % 28 + 1)))
    for k, prefix in plain.items():
        out = out.when(kind == k, F.concat(F.lit(prefix), three))
    return out


def dense_numbers(rows: DataFrame, group: str, order: list[str], out: str, block: int = BLOCK) -> DataFrame:
    """1, 2, 3 ... per group by file_ord and ``order``: ranks in blocks plus the blocks' offsets."""
    rows = rows.withColumn("__block", F.floor(F.col("file_ord") / block))
    counts = rows.groupBy(group, "__block").agg(F.count("*").alias("__n"))
    before = W.partitionBy(group).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select(group, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    own = W.partitionBy(group, "__block").orderBy("file_ord", *order)
    ranked = rows.withColumn("__rank", F.row_number().over(own))
    return ranked.join(bases, [group, "__block"]).withColumn(out, (F.col("__base") + F.col("__rank")).cast("int")).drop("__block", "__rank", "__base")


def hmac_tokens(secret: bytes):
    """A column function of (kind, key): the irreversible token."""

    @F.pandas_udf("string")
    def f(kind: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([textops.hmac_token(k, v, secret) for k, v in zip(kind, key, strict=True)])

    return f


def allocate(found: DataFrame, pii_map: DataFrame, secret: bytes | None = None) -> DataFrame:
    """The map with every found value in it; known ones keep their token.

    ``found``: file_ord, pass, pos, kind, key, value. With a secret, tokens are keyed
    digests and no number is used.
    """
    seen = F.struct("file_ord", "pass", "pos", "key", "value")
    firsts = found.withColumn("akey", allocation_key(F.col("kind"), F.col("key"))).groupBy("kind", "akey").agg(F.min(seen).alias("s"))
    firsts = firsts.select("kind", "akey", "s.*")
    known = pii_map.withColumn("akey", allocation_key(F.col("kind"), F.col("key")))
    known = known.groupBy("kind", "akey").agg(F.min_by(F.struct("token", "n"), F.struct("file_ord", "pass", "pos")).alias("old"))
    new = firsts.join(known.select("kind", "akey"), ["kind", "akey"], "left_anti")
    if secret is None:
        start = pii_map.groupBy("kind").agg(F.max("n").alias("used"))
        new = dense_numbers(new, "kind", ["pass", "pos", "akey"], "rank").join(F.broadcast(start), "kind", "left")  # a row a kind
        new = new.withColumn("n", (F.coalesce("used", F.lit(0)) + F.col("rank")).cast("int"))
        new = new.withColumn("token", token_text(F.col("kind"), F.col("n"), F.col("key"), F.col("value")))
    else:
        new = new.withColumn("n", F.lit(None).cast("int")).withColumn("token", hmac_tokens(secret)("kind", "akey"))
    tokens = new.select("kind", "akey", "token", "n").unionByName(known.select("kind", "akey", "old.token", "old.n"))
    # every spelling of a name is a row of its own
    spelled = found.groupBy("kind", "key").agg(F.min(F.struct("file_ord", "pass", "pos")).alias("s"))
    spelled = spelled.join(pii_map.select("kind", "key"), ["kind", "key"], "left_anti").withColumn("akey", allocation_key(F.col("kind"), F.col("key")))
    added = spelled.join(tokens, ["kind", "akey"]).select("kind", "key", "token", "n", "s.*")
    return pii_map.unionByName(added)


def expand_names(pii_map: DataFrame) -> DataFrame:
    """Add the words of full names, each with its first owner's token; no number is used."""
    from ..functions.columns import name_parts

    names = pii_map.filter("kind = 'person'")
    full = names.filter(~F.col("token").startswith("PERSON_SHORT")).select("token", "n", "file_ord", "pass", "pos", "key", F.posexplode(name_parts(F.col("key"))).alias("word_no", "part"))
    by = F.struct("file_ord", "pass", "pos", "key", "word_no")
    owners = full.withColumn("low", F.lower("part")).groupBy("low").agg(F.min_by(F.struct("token"), by).alias("o"))
    taken = names.select(F.lower("key").alias("low"), F.col("token").alias("old")).groupBy("low").agg(F.min("old").alias("old"))
    rows = full.withColumn("low", F.lower("part")).join(owners, "low").join(taken, "low", "left")
    rows = rows.filter(F.col("token") == F.coalesce("old", F.col("o.token")))
    rows = rows.groupBy("part").agg(F.min(F.struct("file_ord", "pass", "pos", "token", "n")).alias("s"))
    rows = rows.join(names.select(F.col("key").alias("part")), "part", "left_anti")
    return pii_map.unionByName(rows.select(F.lit("person").alias("kind"), F.col("part").alias("key"), "s.token", "s.n", "s.file_ord", "s.pass", "s.pos"))


def prune(pii_map: DataFrame, hits: DataFrame) -> DataFrame:
    """Only entries whose token this run's replacements used."""
    return pii_map.join(hits.select(F.col("replacement").alias("token")).distinct(), "token", "left_semi").select(*pii_map.columns)


def reverse(pii_map: DataFrame, tokens: DataFrame) -> DataFrame:
    """token -> the set of values it may stand for: numbers of ip and dob tokens recur."""
    return tokens.select("token").distinct().join(pii_map, "token").groupBy("token").agg(F.array_sort(F.collect_set(F.struct("kind", "key"))).alias("values"))


def poison_count(pii_map: DataFrame) -> DataFrame:
    """How many name keys must never be replaced: tokens, ordinary words, three letters or fewer."""
    from ..functions import fixed
    from ..functions.columns import is_token

    bad = (F.col("kind") == "person") & (is_token(F.col("key")) | F.lower("key").isin(fixed.DENY) | (F.length("key") <= 3))
    return pii_map.agg(F.count_if(bad).cast("long").alias("map_poison_keys"))
