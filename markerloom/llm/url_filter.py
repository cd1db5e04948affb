"""URL filters: path rules first, then the host's reputation by empirical Bayes.

A page's outcome is a label of that page (1 good, 0 bad). Bad outcomes are counted per host, registered domain and
suffix. The bad rate of a suffix is a beta posterior around the rate of all pages, that of a domain around its
suffix, and that of a host around its domain. How much a level trusts the one above is estimated from the data: the
beta-binomial correlation of each level by moments. A host is blocked when the lower bound of its posterior bad rate
reaches the limit, so hosts with few labels follow their domain and unknown ones their suffix.

Defined results: a null url, or one without "://", has empty host and path and no rule; its host is the empty one,
judged like any other. Ports and user names count as part of the host but not of its domain. Repeated pages are
judged alike and each counts its label. Several labels of a page all count; null labels don't. With no labels at all
nothing is blocked but by rules. Extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markerloom.llm.common import ascii_lower, stored

# (verdict, host, path)
Rule = tuple[str, str, str]
MAX_RULES = 1000

# Second-level suffixes under which domains are registered; others have one label.
SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "com.br", "co.jp", "co.nz", "co.in", "com.cn")

# Lower bound of the bad rate from which a host is blocked, the bound's normal quantile, and the range of the
# correlation within a level.
MAX_BAD, Z, LOW_RHO, HIGH_RHO = 0.2, 1.645, 0.001, 0.5

# Outcomes that all pages are taken to have before any label: bad ones, and in all.
PRIOR_BAD, PRIOR = 1.0, 10.0



def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    whole = F.coalesce(url, F.lit(""))
    at = F.instr(whole, "://")
    rest = F.when(at > 0, F.substr(whole, at + F.lit(3))).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def registered_domain(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of a host; a numeric address is its own domain with an empty suffix."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"(:[0-9]*)?[.]?$", "")
    two = F.substring_index(bare, ".", -2)
    suffix = F.when(two.isin(*suffixes), two).otherwise(F.substring_index(bare, ".", -1))
    labels = F.size(F.split(suffix, "[.]")) + F.lit(1)
    parts = F.split(bare, "[.]")
    domain = F.array_join(F.slice(parts, F.greatest(F.size(parts) - labels + F.lit(1), F.lit(1)), labels), ".")
    address = bare.rlike(r"^[0-9.]+$|^\[")
    return F.when(address, bare).otherwise(domain), F.when(address, F.lit("")).otherwise(suffix)


def rule_order(rules: Sequence[Rule]) -> list[Rule]:
    """Longest host and path first; ties by the longer host, then by the text."""
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does.

    A rule fits its host and all its subdomains where the path starts with the rule's. Rules are configuration, at most MAX_RULES.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    found = []
    for verdict, rule_host, rule_path in rule_order(rules):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        found.append(F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*found) if found else F.lit(None).cast("struct<rule:string,verdict:string>")


def _rho(children: DataFrame) -> float:
    """The correlation of outcomes within a child, by moments around the parent's rate, clipped. `children` has n and bad, and the
    parent's p_n and p_bad."""
    p = F.try_divide("p_bad", "p_n")
    spread = F.try_divide(F.col("n") * (F.try_divide("bad", "n") - p) ** 2, p * (1 - p))
    sums = children.where("n > 0 AND p_bad > 0 AND p_bad < p_n").agg(
        F.sum(spread).alias("s"), F.count("*").alias("k"), F.sum("n").alias("n")
    )
    row = sums.first()
    if not row.k or row.n <= row.k:
        return LOW_RHO
    return max(LOW_RHO, min(HIGH_RHO, (row.s - row.k) / (row.n - row.k)))


def _posterior(mean: Column, rho: float) -> tuple[Column, Column]:
    """Posterior mean and precision of a level's bad rate around the mean of the level above."""
    strength = F.lit((1.0 - rho) / rho)
    size = strength + F.col("n")
    return (strength * mean + F.col("bad")) / size, size


def host_reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(host, n, bad, bad_rate, bound) of every host in `pages` (key, host); `outcomes` has (key, n, bad).

    Counts are combined before the shuffle, so a hot host is one row per task. Three correlations, one number each, come to
    the driver.
    """
    domain, suffix = registered_domain(F.col("host"))
    counts = (
        pages.join(outcomes, "key", "left")
        .groupBy("host")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    )
    hosts = stored(counts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad"), "url-hosts")
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = stored(hosts.groupBy("domain", "suffix").agg(*sums), "url-domains")
    tops = stored(domains.groupBy("suffix").agg(*sums), "url-suffixes")
    total = tops.agg(*sums).first()
    n, bad = (total.n or 0), (total.bad or 0)
    whole = [F.lit(n).alias("p_n"), F.lit(bad).alias("p_bad")]
    above = [F.col("n").alias("p_n"), F.col("bad").alias("p_bad")]
    rhos = [
        _rho(tops.select("n", "bad", *whole)),
        _rho(domains.join(tops.select("suffix", *above), "suffix")),
        _rho(hosts.join(domains.select("domain", "suffix", *above), ["domain", "suffix"])),
    ]
    start = F.lit((bad + PRIOR_BAD) / (n + PRIOR))
    mean, _ = _posterior(start, rhos[0])
    tops = tops.select("suffix", mean.alias("top_mean"))
    mean, _ = _posterior(F.col("top_mean"), rhos[1])
    domains = domains.join(tops, "suffix").select("domain", "suffix", mean.alias("domain_mean"))
    mean, size = _posterior(F.col("domain_mean"), rhos[2])
    rate = F.col("bad_rate")
    return (
        hosts.join(domains, ["domain", "suffix"])
        .select("host", "n", "bad", mean.alias("bad_rate"), size.alias("size"))
        .select("host", "n", "bad", "bad_rate", (rate - F.lit(Z) * F.sqrt(rate * (1 - rate) / (F.col("size") + 1))).alias("bound"))
    )


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[Rule],
    key: str = "page_id",
    url: str = "url",
    label_key: str = "doc_id",
    good: str = "quality",
    max_bad: float = MAX_BAD,
) -> DataFrame:
    """Every page with host, path, the rule that decides (or null), the verdict, and its host's counts and bound."""
    host, path = url_parts(F.col(url))
    parsed = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    outcomes = (
        labels.where(F.col(good).isNotNull())
        .groupBy(F.col(label_key).alias("key"))
        .agg(F.count("*").alias("n"), F.sum(F.when(F.col(good) == 0, 1).otherwise(0)).alias("bad"))
    )
    hosts = stored(host_reputation(parsed.select("key", "host"), outcomes), "url-reputation")
    rule = matched_rule(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("bound") >= max_bad, "block").otherwise("allow")
    return parsed.join(hosts, "host").withColumn("fit", rule).select(
        F.col("key").alias(key),
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", by_host).alias("verdict"),
        F.col("n").alias("n_labels"),
        F.col("bad").alias("n_bad"),
        F.round("bound", 6).alias("bound"),
    )
