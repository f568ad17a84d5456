"""URL filter by the reputation of hosts, in DataFrame operations alone.

Labelled pages tell good outcomes from bad ones.  The share of bad pages of a suffix
is shrunk towards that of all pages, that of a registered domain towards its
suffix's, that of a host towards its domain's: at each level the parent's mean is
the mean of a beta prior, whose strength (the beta-binomial's a + b) is estimated
from all units of the level by the method of moments.  A host is blocked if even the
lower bound of its posterior share of bad pages is above a limit.

Fixed rules on host and path go before: the longest that fits decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The share of bad pages to be expected before any label is seen; it weighs as one page.
PRIOR_BAD = 0.1


@dataclass(frozen=True)
class Rule:
    """A host with its subdomains, a prefix of the path, and what to do."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rule(text: str, verdict: str) -> Rule:
    host, _, path = text.partition("/")
    return Rule(host, "/" + path, verdict)


def host_of(url: Column) -> Column:
    """From after the first :// to /, ?, # or the end, A-Z in lower case; null or no ://: empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From after the host to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, null if none does; of two equally long ones the first by name."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name), reverse=True):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


# Suffixes of two labels below which domains are registered, as public lists have them.
SUFFIXES = (
    "ac.at", "co.at", "or.at", "com.au", "edu.au", "gov.au", "net.au", "org.au", "com.br", "gov.br", "net.br", "org.br", "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn",
    "com.co", "com.eg", "com.es", "com.hk", "edu.hk", "org.hk", "ac.id", "co.id", "or.id", "ac.il", "co.il", "org.il", "ac.in", "co.in", "gov.in", "net.in", "org.in",
    "ac.jp", "co.jp", "go.jp", "ne.jp", "or.jp", "ac.ke", "co.ke", "ac.kr", "co.kr", "go.kr", "or.kr", "com.mx", "gob.mx", "org.mx", "com.my", "com.ng", "ac.nz", "co.nz",
    "govt.nz", "net.nz", "org.nz", "com.pe", "com.ph", "com.pk", "com.pl", "edu.pl", "org.pl", "com.pt", "com.ru", "com.sa", "com.sg", "edu.sg", "ac.th", "co.th", "go.th",
    "com.tr", "edu.tr", "gov.tr", "org.tr", "com.tw", "edu.tw", "org.tw", "com.ua", "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "nhs.uk", "org.uk", "plc.uk",
    "sch.uk", "com.ve", "com.vn", "edu.vn", "ac.za", "co.za", "gov.za", "org.za",
)


def suffix(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The last label of a host, or its last two if they are one of suffixes."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(host, ".", -1))


def registered_domain(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The label before the suffix with the suffix (the host, if it has fewer labels)."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), F.substring_index(host, ".", -3)).otherwise(two)


def _shrunk(units: DataFrame, keys: list[str], *, least_strength: float, most_strength: float) -> DataFrame:
    """units (keys, n, bad, prior) with their posterior mean and the prior's strength s.

    The variance of a unit's share is v (1 + (n - 1) r) / n, v = prior (1 - prior) and
    r = 1 / (s + 1).  r is the one at which the squared deviations of all units have
    their expectation; s is held between the bounds.
    """
    v = F.col("prior") * (1 - F.col("prior"))
    fit = units.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), 2)).alias("dev"), F.sum(v).alias("var"), F.sum(v * (F.col("n") - 1)).alias("room")
    ).first()
    r = (fit.dev - fit["var"]) / fit.room if fit.room else 0.0
    s = 1 / min(max(r, 1 / (most_strength + 1)), 1 / (least_strength + 1)) - 1
    return units.select(*keys, "n", "bad", F.lit(s).alias("s"), ((F.col("bad") + s * F.col("prior")) / (F.col("n") + s)).alias("mean"))


def host_reputation(outcomes: DataFrame, *, z: float = 1.645, least_strength: float = 1.0, most_strength: float = 1000.0, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(host, n, bad, mean, lower) of every host in outcomes (host, n, bad).

    outcomes has one row for each host with its counts of labelled and bad pages.
    mean is the posterior mean share of bad pages and lower its bound, z standard
    deviations of the beta posterior below; hosts without labelled pages have what their
    domain's posterior gives them.  suffixes: those of several labels that the hosts may have.
    """
    keyed = outcomes.select("host", registered_domain(F.col("host"), suffixes).alias("domain"), suffix(F.col("host"), suffixes).alias("suffix"), "n", "bad")
    total = keyed.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    prior = F.lit((total.bad + PRIOR_BAD) / (total.n + 1))
    bounds = {"least_strength": least_strength, "most_strength": most_strength}
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    suffixes = _shrunk(keyed.groupBy("suffix").agg(*sums).withColumn("prior", prior), ["suffix"], **bounds)
    domains = _shrunk(keyed.groupBy("suffix", "domain").agg(*sums).join(suffixes.select("suffix", F.col("mean").alias("prior")), "suffix"), ["domain"], **bounds)
    hosts = _shrunk(keyed.join(domains.select("domain", F.col("mean").alias("prior")), "domain").select("host", "n", "bad", "prior"), ["host"], **bounds)
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("s") + 1))
    return hosts.select("host", "n", "bad", "mean", F.greatest(F.lit(0.0), F.col("mean") - z * sd).alias("lower"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[Rule], *, limit: float = 0.25, z: float = 1.645, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's lower bound, one row for each page.

    A page is bad if a label of its id says toxic = 1 or quality = 0; a page with
    several labels counts once, bad if any is.  Null ids have no label, null urls an
    empty host, which is judged like any other.  Without labels all hosts have the same
    reputation and are allowed.  Repeated pages are judged each.  A host may have
    any share of the pages: only counts of hosts are shuffled, and the join by host
    is one whose skewed partitions Spark splits.
    """
    url = F.col("url")
    parsed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    bad = F.max(((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.coalesce(bad, F.lit(0)).alias("bad"))
    outcomes = parsed.join(known, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    blocked = host_reputation(written(outcomes, "hosts"), z=z, suffixes=suffixes).select("host", F.round("lower", 9).alias("lower"))
    fits = matching_rule(F.col("host"), F.col("path"), rules)
    judged = parsed.withColumn("fits", fits).join(blocked, "host", "left")
    method = F.when(F.col("lower") > limit, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("fits.rule").alias("rule"), F.coalesce(F.col("fits.verdict"), method).alias("verdict"), "lower")
