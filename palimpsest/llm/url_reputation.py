"""URL filtering: explicit rules first, then empirical-Bayes host reputation.

Each url's host and path are cut out; the longest rule that fits decides. Where none
does, the host's reputation decides: labelled page outcomes (good or not) of the host
are shrunk towards its registered domain, the domain's towards its suffix and the
suffix's towards all pages, each through a beta prior whose mean is the level above's
posterior mean and whose strength comes from the data (beta-binomial, method of
moments, within ``strength`` bounds). A host is blocked when the upper posterior bound
of its good share lies below ``block_below``: only hosts that are bad with confidence.

DataFrame expressions only. Outcomes are counted by host with map-side sums, so a host
with a third of all pages costs one row a task; level tables are joined by key and left
to adaptive execution, which broadcasts them only while they are small.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no
rule and is judged by the overall prior; a page without outcome counts for nothing;
repeated pages count as often as they occur; with no outcome at all every prior is even.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, stash

Rule = tuple[str, str, str]  # verdict, host, path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_verdict(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule as ``host + path`` text, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for how, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the last fit is the longest
        fits = ((host == F.lit(h)) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(how)).otherwise(verdict)
    return name, verdict


def registered_domain(host: Column, second_level: Sequence[str] = ("co", "com", "org", "net", "ac", "gov", "edu")) -> Column:
    """The last two labels, or three where the last but one is a second-level suffix of a country."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    country = (F.length(F.element_at(parts, -1)) == 2) & F.when(n >= 3, F.element_at(parts, -2).isin(*second_level)).otherwise(False)
    keep = F.when(country, F.lit(3)).otherwise(F.lit(2))
    return F.when(n <= keep, host).otherwise(F.array_join(F.slice(parts, n - keep + 1, keep), "."))


def suffix_of(host: Column) -> Column:
    """The registered domain without its first label."""
    domain = registered_domain(host)
    return F.when(F.instr(domain, ".") > 0, F.regexp_replace(domain, r"^[^.]*\.", "")).otherwise(domain)


def _strength(n: Column, good: Column, mean: Column, least: float, most: float) -> Column:
    """Prior strength a+b of groups under one mean, by moments of their shares.

    For group sizes n_i, shares p_i and mean m, the variance between groups is what is
    left of sum n_i (p_i - m)^2 after the binomial part; strength = m(1-m)/variance - 1.
    """
    big = F.sum(n)
    spread = F.sum(n * F.pow(good / n - mean, F.lit(2))) / big
    scale = big - F.sum(n * n) / big
    k = F.count(n)
    var = F.max(mean * (1 - mean))
    between = (spread * big - (k - 1) * var) / F.when(scale > 0, scale)
    fit = F.when(between > 0, var / between - 1).otherwise(F.lit(most))
    return F.coalesce(F.least(F.lit(most), F.greatest(F.lit(least), fit)), F.lit(most))


def host_reputation(
    outcomes: DataFrame,
    host_col: str = "host",
    good_col: str = "good",
    strength: tuple[float, float] = (4.0, 400.0),
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Posterior tables of hosts, domains, suffixes and all pages, each with mean and weight.

    ``outcomes`` has a row per labelled page; ``good`` is 1 or 0, and rows in which it is
    null count for nothing.
    """
    least, most = strength
    rows = pick(outcomes, [(host_col, "host"), (good_col, "good")]).filter("good is not null and host is not null")
    hosts = rows.groupBy("host").agg(F.count("good").alias("n"), F.sum("good").alias("g"))
    # a row per host: every level is counted and fitted from this small table, not from the pages again
    hosts = stash(hosts.withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    root = suffixes.agg(((F.coalesce(F.sum("g"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("m0"))

    def level(children: DataFrame, parents: DataFrame, on: list[str], parent_mean: str, name: str) -> DataFrame:
        joined = children.join(parents, on) if on else children.crossJoin(parents)  # crossJoin: a single row
        fits = joined.groupBy(*on).agg(_strength(F.col("n"), F.col("g"), F.col(parent_mean), least, most).alias("k"))
        joined = joined.join(fits, on) if on else joined.crossJoin(fits)
        weight = F.col("n") + F.col("k")
        return joined.withColumn(f"m_{name}", (F.col("g") + F.col("k") * F.col(parent_mean)) / weight).withColumn(f"w_{name}", weight)

    s = level(suffixes, root, [], "m0", "s").select("suffix", "m_s", "w_s")
    s = stash(s, "suffixes")
    d = stash(level(domains, s.select("suffix", "m_s"), ["suffix"], "m_s", "d").select("domain", "m_d", "w_d"), "domains")
    h = level(hosts, d.select("domain", "m_d"), ["domain"], "m_d", "h").select("host", "m_h", "w_h", F.col("n").alias("n_h"))
    return h, d, s, root


def upper_bound(mean: Column, weight: Column, z: float) -> Column:
    """Normal upper bound of a beta posterior with this mean and weight (a + b)."""
    return mean + z * F.sqrt(mean * (1 - mean) / (weight + 1))


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[Rule],
    page_col: str = "page_id",
    url_col: str = "url",
    block_below: float = 0.5,
    z: float = 1.96,
    prior_weight: float = 4.0,
) -> DataFrame:
    """One row per page: host, path, rule, verdict, and the posterior it rests on."""
    rows = pick(pages, [(page_col, "page_id"), (url_col, "url")])
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).drop("url")
    h, d, s, root = host_reputation(outcomes)
    # the levels meet on a row per host; pages are joined once, by host
    hosts = rows.select("host").distinct()
    hosts = hosts.withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    hosts = hosts.join(h, "host", "left").join(d, "domain", "left").join(s, "suffix", "left").crossJoin(root)  # root: one row
    seen = F.col("m_h").isNotNull()  # an unseen host has the prior's weight
    hosts = hosts.select(
        "host",
        F.coalesce("m_h", "m_d", "m_s", "m0").alias("mean"),
        F.when(seen, F.col("w_h")).otherwise(F.lit(prior_weight)).alias("weight"),
        F.coalesce("n_h", F.lit(0)).cast("long").alias("n_outcomes"),
    )
    rows = rows.join(hosts, "host")
    mean, bound = F.col("mean"), upper_bound(F.col("mean"), F.col("weight"), z)
    rule, ruled = rule_verdict(F.col("host"), F.col("path"), rules)
    learnt = F.when(bound < block_below, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(ruled, learnt).alias("verdict"),
        F.round(mean, 9).alias("good_mean"), F.round(bound, 9).alias("good_upper"), "n_outcomes",
    )
