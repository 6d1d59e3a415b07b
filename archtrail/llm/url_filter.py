"""URL filtering: explicit rules first, then the reputation of the host.

The share of bad pages of a host is shrunk towards that of its registered domain, which
is shrunk towards that of its suffix and that towards all pages (beta-binomial at every
level, the weight of a parent estimated from how much its children differ). A host is
blocked where the lower bound of its posterior share is above what is tolerated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archtrail.llm.chunks import written

#: Second labels that form a suffix together with a two-letter country label.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: Bounds of a parent's weight in pages.
MIN_WEIGHT, MAX_WEIGHT = 10.0, 10_000.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    parts = F.split(host, r"\.")
    two = (F.size(parts) > 2) & (F.length(F.element_at(parts, -1)) == 2) & F.element_at(parts, F.when(F.size(parts) > 1, -2).otherwise(-1)).isin(*SECOND_LEVEL)
    return F.when(two, F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    long_ = F.size(F.split(suffix_of(host), r"\.")) == 2
    return F.when(long_, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """Longest of ``(verdict, host/path)`` ``rules`` that fits, and its verdict (null where none does).

    A rule fits its host and all subdomains where the path starts with the rule's. Of rules
    of one length the one with the longer host counts, then ``block``.
    """
    name = verdict = F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: (len(r[1]), len(r[1].partition("/")[0]), r[0] == "block")):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _weight(children: DataFrame, parent: str | None) -> float:
    """Prior weight (pages) of a parent: how alike the shares of its children are, by moments.

    Sum n (p - m)^2 / (m (1 - m)) over k children of j parents is about (k - j) + r (n - k)
    for a correlation r of pages of one child; the weight is 1 / r - 1 within MIN_WEIGHT
    and MAX_WEIGHT, the former where no parent has two labelled children.
    """
    labelled = children.where("n > 0")
    keys = [parent] if parent else []
    means = labelled.groupBy(*keys).agg(((F.sum("bad") + 0.5) / (F.sum("n") + 1.0)).alias("m"))
    if not parent:
        m = means.first()["m"]
        joined, parents = labelled.withColumn("m", F.lit(m if m is not None else 0.5)), 1
    else:
        joined, parents = labelled.join(means, parent), means.count()
    row = joined.agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("m"), 2) / (F.col("m") * (1 - F.col("m")))).alias("spread"), F.count("*").alias("k"), F.sum("n").alias("n")
    ).first()
    if row["k"] <= parents or row["n"] <= row["k"]:
        return MIN_WEIGHT
    r = (row["spread"] - (row["k"] - parents)) / (row["n"] - row["k"])
    return round(min(MAX_WEIGHT, max(MIN_WEIGHT, 1 / r - 1 if r > 0 else MAX_WEIGHT)), 6)


def host_reputation(pages: DataFrame, outcomes: DataFrame, page_key: str = "page_id", url_col: str = "url", bad_col: str = "bad", z: float = 1.645) -> DataFrame:
    """``host, n, bad, share, low, high``: labelled pages, bad ones, posterior mean and bounds of every host.

    ``outcomes`` has ``page_key`` and ``bad_col`` (0 or 1; null and unlabelled pages say
    nothing). A page with several outcomes counts them all. ``n`` pages of a child tell its
    parent as much as ``n w / (w + n)`` of its own would, ``w`` being the parent's weight;
    the bounds are ``z`` standard deviations off, with what is uncertain about the parents.
    """
    labelled = pages.select(page_key, host_of(F.col(url_col)).alias("host")).join(outcomes.select(page_key, F.col(bad_col).alias("bad")), page_key, "left")
    hosts = labelled.groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"))
    hosts = written(hosts.select("*", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix")))

    def told(children: DataFrame, weight: float, *keys: str) -> DataFrame:
        part = F.lit(weight) / (weight + F.col("n"))
        return children.groupBy(*keys).agg(F.sum(F.col("n") * part).alias("n"), F.sum(F.col("bad") * part).alias("bad"))

    def shrunk(children: DataFrame, weight: float) -> DataFrame:
        out = children.withColumn("share", (weight * F.col("parent_share") + F.col("bad")) / (weight + F.col("n")))
        own, passed_on = F.col("share") * (1 - F.col("share")) / (weight + F.col("n") + 1), weight / (weight + F.col("n"))
        return out.withColumn("variance", own + passed_on * passed_on * F.col("parent_variance"))

    def prior(parents: DataFrame, name: str) -> DataFrame:
        return parents.select(name, F.col("share").alias("parent_share"), F.col("variance").alias("parent_variance"))

    on_host = _weight(hosts, "domain")
    domains = written(told(hosts, on_host, "domain", "suffix"))
    on_domain = _weight(domains, "suffix")
    suffixes = written(told(domains, on_domain, "suffix"))
    on_suffix = _weight(suffixes, None)
    total = told(suffixes, on_suffix).first()
    overall = ((total["bad"] or 0) + 0.5) / ((total["n"] or 0) + 1.0)
    first = {"parent_share": F.lit(overall), "parent_variance": F.lit(overall * (1 - overall) / ((total["n"] or 0) + 2.0))}
    suffixes = shrunk(suffixes.withColumns(first), on_suffix)
    domains = shrunk(domains.join(prior(suffixes, "suffix"), "suffix"), on_domain)
    hosts = shrunk(hosts.join(prior(domains, "domain"), "domain"), on_host)
    error = z * F.sqrt("variance")
    return hosts.select("host", F.col("n").cast("long"), F.col("bad").cast("long"), "share", (F.col("share") - error).alias("low"), (F.col("share") + error).alias("high"))


def filter_urls(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]], page_key: str = "page_id", url_col: str = "url",
    bad_col: str = "bad", tolerated: float = 0.25, z: float = 1.645,
) -> DataFrame:
    """Judge every page: ``page_key, host, path, rule, verdict, share, low``, one row per input row.

    ``verdict`` is the rule's, else ``block`` where ``low`` is above ``tolerated`` and ``allow``
    where it is not. A null url, or one without ``://``, has an empty host and path, which
    is judged like any host. Other columns are not read.
    """
    reputation = host_reputation(pages, outcomes, page_key, url_col, bad_col, z)
    judged = pages.select(page_key, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("low") > tolerated, "block").otherwise("allow")
    return judged.join(reputation.select("host", "share", "low"), "host", "left").select(
        page_key, "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "share", "low"
    )
