"""URL filter: allow and block rules first, else the empirical-Bayes reputation of the host.

Labelled page outcomes are counted by host, registered domain and suffix. Each level has a beta-binomial model:
its prior has the posterior mean of the level above and a strength fitted to the spread of the level's rates
around that mean by the method of moments. A host is blocked when the lower bound of its posterior rate of bad
pages, mean - z * standard deviation, is over a limit. Hosts without labels have their domain's or suffix's
posterior as prior, and so inherit its mean with that level's spread. User names and ports do not count, IP addresses
are domains without a suffix, and suffixes of two labels come from a short list that is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules of the query, (verdict, rule).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

#: The posterior bound: a host is blocked if its rate of bad pages is above BAD_LIMIT by Z standard deviations.
BAD_LIMIT, Z = 0.25, 1.0
#: Least and largest strength of a prior, in pages.
STRENGTH = (2.0, 1000.0)
#: What the rate over all pages starts from: so many bad ones among so many, so that no labels block nothing.
START_BAD, START_PAGES = 0.5, 5.0


def url_host(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.translate(host, UPPER, LOWER)).otherwise(F.lit(""))


def url_path(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(F.instr(url, "://") > 0, path).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else nulls. One CASE branch a rule: meant for short lists."""
    name = verdict = None
    for kind, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    if name is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return name, verdict


# Suffixes of two labels under which domains are registered; all others are taken to have one label.
LONG_SUFFIXES = (
    "ac.jp", "ac.uk", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.hk",
    "com.mx", "com.my", "com.pl", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn", "go.jp", "gov.au", "gov.br", "gov.cn", "gov.uk", "ne.jp", "net.au",
    "net.br", "net.cn", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.nz", "org.uk", "org.za",
)
IP_ADDRESS = r"^([0-9]+[.][0-9]+[.][0-9]+[.][0-9]+|\[.*)$"


def plain_host(host: Column) -> Column:
    """A host without user name and port, under which its outcomes are counted."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def suffix(host: Column, long_suffixes=LONG_SUFFIXES) -> Column:
    """The last two labels of a host if they are a suffix of two, else the last one; none for an IP address."""
    two = F.substring_index(host, ".", -2)
    return F.when(host.rlike(IP_ADDRESS), "").when(two.isin(*long_suffixes), two).otherwise(F.substring_index(host, ".", -1))


def registered_domain(host: Column, long_suffixes=LONG_SUFFIXES) -> Column:
    """The suffix of a host and the label before it (all of a shorter one); an IP address is its own domain."""
    two = F.substring_index(host, ".", -2)
    return F.when(host.rlike(IP_ADDRESS), host).when(two.isin(*long_suffixes), F.substring_index(host, ".", -3)).otherwise(two)


def _strength(groups: DataFrame, n: Column, bad: Column, mean: Column) -> DataFrame:
    """One row: prior strength m from the moments of bad / n around mean over groups with a labelled page.

    Under a beta-binomial with mean p and strength m, E[(k - n p)^2] = n p (1 - p) (m + n) / (m + 1); summed over
    groups and solved for m.
    """
    low, high = STRENGTH
    p = F.greatest(F.least(mean, F.lit(1 - 1e-6)), F.lit(1e-6))
    sums = groups.where(n > 0).agg(
        F.sum(F.pow(bad - n * p, F.lit(2.0))).alias("seen"),
        F.sum(n * p * (1 - p)).alias("one"),
        F.sum(n * n * p * (1 - p)).alias("square"),
    )
    return sums.select(
        F.when(F.col("seen").isNull() | (F.col("seen") <= F.col("one")), F.lit(high)).otherwise(
            F.greatest(F.lit(low), F.least(F.lit(high), F.try_divide(F.col("square") - F.col("seen"), F.col("seen") - F.col("one"))))
        ).alias("m")
    )


def _shrunk(groups: DataFrame, above: DataFrame, key: str, level: str) -> DataFrame:
    """groups with the posterior mean and strength of this level, whose prior mean is that of the level above."""
    joined = groups.join(above, key)
    m = _strength(joined, F.col("n"), F.col("bad"), F.col("prior"))
    joined = joined.crossJoin(F.broadcast(m))  # one row
    return joined.withColumn(f"{level}_mean", (F.col("bad") + F.col("m") * F.col("prior")) / (F.col("n") + F.col("m"))).withColumn(f"{level}_strength", F.col("n") + F.col("m")).drop("prior", "m")


def host_reputation(pages: DataFrame, outcomes: DataFrame, long_suffixes=LONG_SUFFIXES, scratch: Scratch | None = None) -> DataFrame:
    """(host, n, bad, mean, lower) for every host of pages (page_id, host).

    outcomes: (page_id long, bad 0/1 int), at most one row a page; null outcomes are ignored. n and bad count the
    labelled pages of a host, mean is its posterior rate of bad pages and lower its bound. Without any label
    every rate is START_BAD / START_PAGES. The figures of suffixes and domains are written before they are joined, so that
    no aggregate stands between an exchange and its join and Spark's skew join can split the hosts of a large domain.
    """
    scratch = scratch or Scratch(pages.sparkSession, "hosts")
    labelled = pages.join(outcomes.where("bad IS NOT NULL"), "page_id", "left")
    hosts = labelled.groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"))
    hosts = hosts.withColumn("domain", registered_domain(F.col("host"), long_suffixes)).withColumn("suffix", suffix(F.col("host"), long_suffixes))
    total = hosts.agg(((F.coalesce(F.sum("bad"), F.lit(0.0)) + START_BAD) / (F.coalesce(F.sum("n"), F.lit(0.0)) + START_PAGES)).alias("prior"))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    by_suffix = _shrunk(suffixes, suffixes.select("suffix").crossJoin(F.broadcast(total)), "suffix", "suffix")
    by_domain = _shrunk(domains, scratch.keep(by_suffix.select("suffix", F.col("suffix_mean").alias("prior"))), "suffix", "domain")
    by_host = _shrunk(hosts, scratch.keep(by_domain.select("domain", F.col("domain_mean").alias("prior"))), "domain", "host")
    mean, strength = F.col("host_mean"), F.col("host_strength")
    lower = mean - F.lit(Z) * F.sqrt(mean * (1 - mean) / (strength + 1))
    return by_host.select("host", F.col("n").cast("long").alias("n"), F.col("bad").cast("long").alias("bad"), mean.alias("mean"), lower.alias("lower"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, bad_limit: float = BAD_LIMIT, long_suffixes=LONG_SUFFIXES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages (page_id long, url string).

    A rule that fits decides; else a page is blocked if its host's posterior lower bound is over bad_limit. A url
    that is null or without :// has an empty host and path, fits no rule, and shares the reputation of the empty
    host. Pages without a page_id have no outcome of their own. Repeated rows stay, other columns are ignored, an empty table gives no rows.
    """
    urls = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    urls = urls.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    urls = urls.withColumn("_plain", plain_host(F.col("host")))
    scratch = Scratch(pages.sparkSession, "urls")
    hosts = host_reputation(urls.select("page_id", F.col("_plain").alias("host")), outcomes, long_suffixes, scratch)
    # Written before the join, as above: the pages of a large host, or those without one, are then split over tasks.
    blocked = scratch.keep(hosts.where(F.col("lower") > bad_limit).select(F.col("host").alias("_plain"), F.lit(True).alias("bad_host")))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    judged = urls.join(blocked, "_plain", "left")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, F.when(F.col("bad_host"), "block").otherwise("allow")).alias("verdict"))


def label_outcomes(labels: DataFrame) -> DataFrame:
    """Page outcomes from a label table (doc_id, quality, toxic) whose ids are page ids: low quality or toxic is bad."""
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    return labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad.cast("int")).alias("bad"))
