"""URL filtering by empirical-Bayes host reputation.

Labelled page outcomes are counted per host, registered domain and suffix. Each level's rate is
shrunk to its parent's through a beta-binomial prior whose strength is estimated from the spread
of the children's counts (method of moments). A host is blocked if the lower bound of its
posterior share of bad pages is above a threshold; explicit rules come first.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import ascii_lower


@dataclass(frozen=True)
class UrlRule:
    verdict: str  # "allow" or "block"
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


#: Second-level labels under which names are registered, as in name.co.uk.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without a ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """The text of the longest rule whose host is ``host`` or a parent and whose path begins ``path``; else null."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.lit(r.text)).otherwise(found)
    return found


def registered_domain(host: Column) -> Column:
    """The last two labels, or three below a two-letter suffix with a second-level label."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    three = (n >= 3) & (F.length(F.get(parts, n - 1)) == 2) & F.get(parts, n - 2).isin(*SECOND_LEVEL)
    return F.when(three, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def _precision(level: DataFrame, parent: str) -> float:
    """The beta prior's strength: counts that vary more than binomial ones mean a weak prior."""
    p = F.least(F.greatest(F.col(parent), F.lit(0.001)), F.lit(0.999))
    row = level.agg(
        F.sum((F.col("y") - F.col("n") * p) * (F.col("y") - F.col("n") * p) / (p * (1 - p))).alias("spread"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"),
    ).first()
    rho = (row["spread"] - row["n"]) / row["pairs"] if row["pairs"] else 0.1
    rho = min(0.5, max(0.01, rho))
    return 1 / rho - 1


def host_reputation(outcomes: DataFrame, threshold: float = 0.5, z: float = 1.645) -> tuple[DataFrame, float, float, float]:
    """From (host, bad 0 or 1) rows: the hosts' table and what applies to hosts without outcomes.

    The table has host, domain, suffix, the shrunk rates and ``bound``. The numbers returned with
    it are the overall rate and the prior strengths of domains and hosts. Rows of null host or
    outcome are no outcomes.
    """
    found = _reputation(outcomes, z)
    return found.hosts, found.rate, found.m_domain, found.m_host


@dataclass(frozen=True)
class _Reputation:
    """The levels' tables, (domain, domain_rate) and (suffix, suffix_rate), and the prior strengths of each."""

    hosts: DataFrame
    domains: DataFrame
    suffixes: DataFrame
    rate: float
    m_suffix: float
    m_domain: float
    m_host: float


def _suffix(domain: str) -> Column:
    return F.expr(f"substring({domain}, length(substring_index({domain}, '.', 1)) + 2)")


def _reputation(outcomes: DataFrame, z: float) -> _Reputation:
    hosts = outcomes.filter("host IS NOT NULL AND bad IS NOT NULL").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("y"))
    hosts = hosts.withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", _suffix("domain"))
    total = hosts.agg(F.sum("y").alias("y"), F.sum("n").alias("n")).first()
    rate = ((total["y"] or 0) + 1) / ((total["n"] or 0) + 2)

    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).withColumn("overall", F.lit(float(rate)))
    m_suffix = _precision(suffixes, "overall")
    suffixes = suffixes.select("suffix", ((F.col("y") + m_suffix * rate) / (F.col("n") + m_suffix)).alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix")
    m_domain = _precision(domains, "suffix_rate")
    domains = domains.select("domain", ((F.col("y") + m_domain * F.col("suffix_rate")) / (F.col("n") + m_domain)).alias("domain_rate"))
    hosts = hosts.join(domains, "domain")
    m_host = _precision(hosts, "domain_rate")
    return _Reputation(posterior(hosts, m_host, z), domains, suffixes, rate, m_suffix, m_domain, m_host)


def _prior_bound(rate: Column, strengths: Sequence[float], z: float) -> Column:
    """Lower bound of a host without outcomes, ``rate`` being known ``len(strengths)`` levels above it.

    Each level between spreads the share once more: its variance is p (1 - p) (1 - the product of m / (m + 1)).
    """
    spread = 1 - math.prod(m / (m + 1) for m in strengths)
    return rate - z * F.sqrt(rate * (1 - rate) * spread)


def host_bounds(hosts: DataFrame, found: _Reputation, z: float) -> DataFrame:
    """(host, bad_bound): a host's own posterior, else the prior from its domain, its suffix or all outcomes."""
    known = found.hosts.select("host", "bound")
    named = hosts.join(known, "host", "left").withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", _suffix("domain"))
    named = named.join(found.domains, "domain", "left").join(found.suffixes, "suffix", "left")
    prior = F.coalesce(
        _prior_bound(F.col("domain_rate"), [found.m_host], z),
        _prior_bound(F.col("suffix_rate"), [found.m_host, found.m_domain], z),
        _prior_bound(F.lit(float(found.rate)), [found.m_host, found.m_domain, found.m_suffix], z),
    )
    return named.select("host", F.coalesce("bound", F.when(F.col("host") != "", prior)).alias("bad_bound"))


def posterior(hosts: DataFrame, strength: float, z: float) -> DataFrame:
    a = F.col("y") + strength * F.col("domain_rate")
    b = F.col("n") - F.col("y") + strength * (1 - F.col("domain_rate"))
    mean = a / (a + b)
    return hosts.withColumn("bound", mean - z * F.sqrt(mean * (1 - mean) / (a + b + 1)))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[UrlRule], threshold: float = 0.5, z: float = 1.645, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, bad_bound.

    ``outcomes`` has url and bad (0 or 1), one row per labelled page. A null url, or one without
    ``://``, has empty host and path, which no rule fits. Hosts without outcomes take the
    bound of the prior from their registered domain, else their suffix, else all outcomes; only
    an empty host without outcomes has no reputation and a null bound. Repeated rows are judged alike; an empty table gives an empty result; other columns are ignored.
    """
    judged = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    judged = judged.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    found = _reputation(outcomes.select(url_host(F.col("url")).alias("host"), F.col("bad").cast("long").alias("bad")), z)
    judged = judged.join(host_bounds(judged.select("host").distinct(), found, z), "host", "left")
    verdict = F.when(F.col("bad_bound") > threshold, "block").otherwise("allow")
    for r in rules:
        verdict = F.when(F.col("rule") == r.text, F.lit(r.verdict)).otherwise(verdict)
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "bad_bound")
