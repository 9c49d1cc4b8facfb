"""Operator 1, URL filters: empirical-Bayes host reputation, DataFrame functions only.

``reputation``: labelled page outcomes per host are shrunk through a chain of
beta-binomial priors. The suffix mean is shrunk to the overall mean, the
registered domain's to its suffix's, the host's to its domain's. At each level
the prior strength is the moment estimate
``s = (sum n*m*(1-m) ) / sum (k - n*m)^2 / (n-1)``-style over-dispersion, kept
within ``[s_min, s_max]``. A host is blocked when the upper bound of its
posterior good rate is below ``min_good``.

``judge``: rules first (longest fitting rule wins), then reputation.

Defined results: a null URL or one without ``://`` has an empty host and path,
fits no rule and is judged as host "". Repeated rows are judged each; extra
columns are kept out of the result. No labels: all hosts get the flat prior and pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract: rule string -> verdict.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty when null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict (nulls where none fits)."""
    rule = verdict = None
    for r in sorted(rules, key=lambda x: (-len(x), x)):
        domain, at = r.split("/", 1)
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + at)
        rule = F.when(fits, F.lit(r)) if rule is None else rule.when(fits, F.lit(r))
        verdict = F.when(fits, F.lit(rules[r])) if verdict is None else verdict.when(fits, F.lit(rules[r]))
    return rule, verdict


def registered_domain(host: Column) -> Column:
    """Last two labels of a host."""
    return F.substring_index(host, ".", -2)


def suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _shrink(df: DataFrame, n: str, k: str, prior: str, s: str) -> Column:
    return (F.col(k) + F.col(s) * F.col(prior)) / (F.col(n) + F.col(s))


def _strength(units: DataFrame, n: str, k: str, prior: str, lo: float, hi: float) -> DataFrame:
    """One row: prior strength from the over-dispersion of ``k`` of ``n`` around ``prior``."""
    spread = F.sum(F.pow(F.col(k) - F.col(n) * F.col(prior), 2))
    binom = F.sum(F.col(n) * F.col(prior) * (1 - F.col(prior)))
    square = F.sum(F.col(n) * (F.col(n) - 1) * F.col(prior) * (1 - F.col(prior)))
    # E spread = binom + rho * square with rho = 1 / (s + 1)
    g = units.agg(spread.alias("v"), binom.alias("b"), square.alias("q"))
    s = F.when((F.col("v") > F.col("b")) & (F.col("q") > 0), F.col("q") / (F.col("v") - F.col("b")) - 1).otherwise(hi)
    return g.select(F.coalesce(F.least(F.greatest(s, F.lit(lo)), F.lit(hi)), F.lit(hi)).alias("s_" + n))


def reputation(outcomes: DataFrame, lo: float = 2.0, hi: float = 200.0, z: float = 2.0) -> DataFrame:
    """Posterior good rate per host from ``outcomes(host, good)``: mean, lower and upper bound."""
    hosts = (outcomes.groupBy("host").agg(F.count("good").alias("n"), F.sum("good").cast("double").alias("k"))
             .fillna(0.0, ["k"]).withColumn("domain", registered_domain(F.col("host")))
             .withColumn("suffix", suffix(F.col("host"))))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk"))
    tops = domains.groupBy("suffix").agg(F.sum("dn").alias("tn"), F.sum("dk").alias("tk"))
    total = tops.agg(((F.coalesce(F.sum("tk"), F.lit(0.0)) + 1) / (F.coalesce(F.sum("tn"), F.lit(0)) + 2)).alias("base"))
    # one-row frames joined below hold three sums each; suffixes and domains are joined by key
    tops = tops.crossJoin(F.broadcast(total))
    tops = tops.crossJoin(F.broadcast(_strength(tops, "tn", "tk", "base", lo, hi)))
    tops = tops.select("suffix", _shrink(tops, "tn", "tk", "base", "s_tn").alias("t_rate"))
    domains = domains.join(tops, "suffix")
    domains = domains.crossJoin(F.broadcast(_strength(domains, "dn", "dk", "t_rate", lo, hi)))
    domains = domains.select("domain", "suffix", _shrink(domains, "dn", "dk", "t_rate", "s_dn").alias("d_rate"))
    hosts = hosts.join(domains, ["domain", "suffix"])
    hosts = hosts.crossJoin(F.broadcast(_strength(hosts, "n", "k", "d_rate", lo, hi)))
    mean = _shrink(hosts, "n", "k", "d_rate", "s_n")
    half = z * F.sqrt(mean * (1 - mean) / (F.col("n") + F.col("s_n") + 1))
    return hosts.select("host", "n", F.round(mean, 6).alias("good_rate"),
                        F.round(F.greatest(mean - half, F.lit(0.0)), 6).alias("rate_low"),
                        F.round(F.least(mean + half, F.lit(1.0)), 6).alias("rate_high"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: dict[str, str] = RULES, min_good: float = 0.5) -> DataFrame:
    """Verdict per page of ``pages(page_id, url)`` given ``outcomes(url, good)`` (good null: unlabelled)."""
    host, path = host_path(F.col("url"))
    rule, fixed = rule_for(F.col("host"), F.col("path"), rules)
    slim = pages.select("page_id", host.alias("host"), path.alias("path"))
    rates = reputation(outcomes.select(host.alias("host"), "good"))
    out = slim.join(rates, "host", "left")
    own = F.when(F.col("rate_high") < min_good, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(fixed, own).alias("verdict"),
                      "good_rate", "rate_low", "rate_high")
