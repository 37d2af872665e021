"""URL filter: rules by host and path, else the host's reputation by empirical
Bayes.

Labelled pages give each host a number of good and bad outcomes.  A host's
good share has a beta prior around the share of its registered domain, that
one around its suffix, that one around all labelled pages.  How strongly a
level holds to its parent (the beta's sample size) is fitted by moments: the
variance between children beyond what binomial noise makes, pooled within
parents and weighted by pages.  A host passes if the lower bound of its
posterior, mean less ``Z`` standard deviations, reaches ``MIN_GOOD``; a host
without labelled pages is judged by what it inherits.

Everything is counted: one aggregate over the pages by host, then aggregates
of aggregates.  Joins go through ``heavy_join``, so neither a host with a
third of the pages nor a domain with a third of the hosts lands in one task.

Defined results: a null url, or one without ``://``, has an empty host and
path, fits no rule and is judged by the mean of all; user names and ports
belong to the host (as rules see it) but not to its domain; numeric addresses
and single names are their own domain under the empty suffix; labels repeated
for one document count once, as bad if any row is bad; rows whose labels are
null are no outcome; without any labelled page the good share is one half.
Extra columns of the pages are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import heavy_join
from .common import stored

#: (verdict, host/path).  A rule fits its host and all subdomains.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/"))
#: Suffixes of two labels under which domains are registered; else a suffix is the last label.
LONG_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn",
                 "com.mx", "com.tr", "gov.uk", "org.uk")
MIN_GOOD = 0.5
Z = 1.645
#: A beta prior's sample size: at most, and where no parent has two labelled children.
MAX_STRENGTH = 1000.0
DEFAULT_STRENGTH = 10.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return (F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits (of equal length, the one with the longer
    host; of equal rules, block), else null.  One branch a rule: for rule sets of up to some hundreds."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), -r[1].index("/"), r[0] != "block")):
        rule_host, rule_path = rule[:rule.index("/")], rule[rule.index("/"):]
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def domain_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain (suffix and one label) and suffix of a host, without user name and port."""
    name = F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r"(?<!\.)\.*(:[0-9]*)?\z", "")
    labels = F.split(name, r"\.")
    n = F.size(labels)
    two = F.concat_ws(".", F.slice(labels, F.greatest(n - 1, F.lit(1)), 2))
    k = F.when(two.isin(*LONG_SUFFIXES), 2).otherwise(1)
    own = (n == 1) | name.rlike(r"^[0-9.]+\z") | name.startswith("[")
    last = lambda m: F.concat_ws(".", F.slice(labels, F.greatest(n - m + 1, F.lit(1)), m))
    return (F.when(own, name).otherwise(last(k + 1)), F.when(own, F.lit("")).otherwise(last(k)))


def outcomes(labels: DataFrame) -> DataFrame:
    """(doc_id, good) of labelled documents: good is 1 for quality without toxicity, 0 if any row is bad."""
    good = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 0).when(F.col("quality") == 1, 1)
    return labels.groupBy("doc_id").agg(F.min(good).alias("good")).filter("doc_id IS NOT NULL AND good IS NOT NULL")


def shown_document(path: Column) -> Column:
    """The id of the document that a page shows: the number that begins the last part of its path."""
    number = F.regexp_extract(path, r"/([0-9]{1,18})([^/0-9][^/]*)?/?\z", 1)
    return F.when(number != "", number).cast("long")


def _strength(children: DataFrame, parent: str) -> DataFrame:
    """One row: the fitted sample size of the prior that ``children`` (parent, n, good) have within parents."""
    p = children.filter("n > 0").groupBy(parent).agg(
        F.sum("n").alias("n"), F.sum("good").alias("good"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col("good") * F.col("good") / F.col("n")).alias("q"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    share = F.col("good") / F.col("n")
    t = p.agg(
        F.sum(F.col("q") - F.col("good") * share - (F.col("k") - 1) * share * (1 - share)).alias("excess"),
        F.sum((F.col("n") - F.col("nn") / F.col("n")) * share * (1 - share)).alias("noise"),
        F.sum(F.when(F.col("k") > 1, F.col("k"))).alias("several"))
    fitted = F.col("noise") / F.col("excess") - 1
    return t.select(F.when(F.col("several").isNull(), DEFAULT_STRENGTH)
                    .when(F.col("excess") * (MAX_STRENGTH + 1) <= F.col("noise"), MAX_STRENGTH)
                    .otherwise(F.greatest(F.lit(1.0), fitted)).alias("strength"))


def _posterior(level: DataFrame, prior: Column, strength: DataFrame) -> DataFrame:
    """``level`` with a, b (of its beta posterior) and share (its mean)."""
    d = level.withColumn("_prior", prior).crossJoin(F.broadcast(strength))
    return (d.withColumn("a", F.col("strength") * F.col("_prior") + F.col("good"))
            .withColumn("b", F.col("strength") * (1 - F.col("_prior")) + F.col("n") - F.col("good"))
            .withColumn("share", F.col("a") / (F.col("a") + F.col("b"))).drop("_prior", "strength"))


def host_reputation(hosts: DataFrame) -> DataFrame:
    """``hosts`` (host, n labelled pages, good ones) with domain, suffix, the posterior a, b, share, and its lower bound."""
    domain, suffix = domain_suffix(F.col("host"))
    hosts = hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "good")
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    root = suffixes.agg(((F.coalesce(F.sum("good"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("root"))
    top = _posterior(suffixes.crossJoin(F.broadcast(root)), F.col("root"), _strength(suffixes.withColumn("all", F.lit(1)), "all"))
    mid = _posterior(heavy_join(domains, top.select("suffix", F.col("share").alias("up")), "suffix"), F.col("up"),
                     _strength(domains, "suffix"))
    mid = stored(mid.select("domain", F.col("share").alias("up")), "url-domains")
    low = _posterior(heavy_join(hosts, mid, "domain"), F.col("up"), _strength(hosts, "domain"))
    s = F.col("a") + F.col("b")
    return low.withColumn("bound", F.col("share") - Z * F.sqrt(F.col("a") * F.col("b") / (s * s * (s + 1)))).drop("up")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, min_good: float = MIN_GOOD) -> DataFrame:
    """Each page's page_id, host, path, rule and verdict: its rule's, else allow if the lower bound
    of its host's good share reaches ``min_good``, else block."""
    host, path = host_path(F.col("url"))
    d = pages.select("page_id", host.alias("host"), path.alias("path"))
    d = d.withColumn("_rule", fitting_rule(F.col("host"), F.col("path"), rules))
    shown = d.select("host", shown_document(F.col("path")).alias("doc_id"))
    hosts = stored(heavy_join(shown, outcomes(labels), "doc_id").groupBy("host")
                   .agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
                        F.count(F.lit(1)).alias("pages")), "url-hosts")
    known = stored(host_reputation(hosts).select("host", (F.round("bound", 9) >= min_good).alias("_passes")), "url-known")
    out = heavy_join(d, known, "host", hosts.select("host", F.col("pages").alias("n")))
    return out.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"),
                      F.coalesce(F.col("_rule.verdict"), F.when(F.col("_passes"), "allow").otherwise("block")).alias("verdict"))
