"""URL filter by empirical-Bayes host reputation.

Labelled outcomes (1 good, 0 bad) are counted per host, registered domain and suffix.  Each
level's rate is shrunk towards the level above it by a beta-binomial prior: the overall rate
is the prior of a suffix, the suffix's posterior that of a domain, and the domain's posterior
that of a host.  A level's prior strength is the moment estimate over its own groups.  A page
passes if the lower posterior bound of its host is high enough.  Explicit rules go first.

Names leave out user and port.  A suffix is the last label, or the last two where the last has
two letters and the one before it is one of ``SECOND``; a registered domain is a suffix and one
label more.  A numeric address is its own domain and suffix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next / ? # or the end, A-Z lower-cased; else ''."""
    return F.coalesce(F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


#: Labels that form a suffix together with a country's two letters, as in co.uk.
SECOND = "ac|co|com|edu|go|gob|gov|mil|ne|net|nom|or|org"
SUFFIX = f"(?:^|\\.)((?:{SECOND})\\.[a-z][a-z]|[^.]*)$"
DOMAIN = f"(?:^|\\.)([^.]+\\.(?:(?:{SECOND})\\.[a-z][a-z]|[^.]*))$"
PORT, USER, ADDRESS = ":[0-9]*$", "^.*@", "^([0-9]+\\.[0-9.]+|\\[.*)$"


def names(host: Column) -> tuple[Column, Column, Column]:
    """(name, registered domain, suffix) of a host."""
    name = F.regexp_replace(F.regexp_replace(host, USER, ""), PORT, "")
    domain = F.regexp_extract(name, DOMAIN, 1)
    address = name.rlike(ADDRESS)
    return name, F.when(address | (domain == ""), name).otherwise(domain), F.when(address, name).otherwise(F.regexp_extract(name, SUFFIX, 1))


def _strength(groups: DataFrame) -> float:
    """The moment estimate of the prior's strength over ``groups`` (n, good, prior), between 1 and 1000.

    Of group rates p around the prior rate m, each from n outcomes, the variance in excess of
    the binomial one gives s = m (1 - m) / excess - 1.
    """
    noise = F.col("prior") * (1 - F.col("prior"))
    t = groups.agg(F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("prior"), 2)).alias("spread"), F.sum(noise).alias("noise"), F.sum(F.col("n") * noise).alias("mass"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    if not t["k"]:
        return 1000.0
    excess = (t["spread"] - t["noise"]) / max(t["n"] - t["k"], 1)
    return min(max(t["mass"] / max(t["n"], 1) / excess - 1, 1.0), 1000.0) if excess > 0 else 1000.0


def _named(df: DataFrame) -> DataFrame:
    name, domain, suffix = names(F.col("host"))
    return df.withColumn("name", name).withColumn("domain", domain).withColumn("suffix", suffix)


def reputation(outcomes: DataFrame, z: float = 1.645) -> tuple[dict[str, DataFrame], float]:
    """Posterior (key, mean, bound) by name, domain and suffix, and the overall rate.

    ``outcomes`` has host and good (0 or 1); rows with a null in either are no outcomes.  Each
    level is written once, and its prior's strength, one number, goes on as a literal.
    """
    o = _named(outcomes.where("good IS NOT NULL AND host IS NOT NULL"))
    counted = cut(o.groupBy("name", "domain", "suffix").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good")))
    n, good = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    overall = (good + 1) / (n + 2)
    out: dict[str, DataFrame] = {}
    for level, above in (("suffix", None), ("domain", "suffix"), ("name", "domain")):
        groups = counted.groupBy(level, *([above] if above else [])).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
        groups = groups.join(out[above].select(F.col("key").alias(above), F.col("mean").alias("prior")), above) if above else groups.withColumn("prior", F.lit(overall))
        groups = cut(groups)
        strength = _strength(groups)
        weight = F.col("n") + F.lit(strength)
        mean = (F.col("good") + F.col("prior") * F.lit(strength)) / weight
        out[level] = groups.select(F.col(level).alias("key"), mean.alias("mean"), weight.alias("weight")).select("key", "mean", (F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))).alias("bound"))
    return out, overall


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] = RULES, limit: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, bound, verdict) for every row of ``pages``.

    A host without outcomes takes its domain's bound, then its suffix's, then the overall
    rate.  A null url or one without :// has an empty host and path, no rule, and is
    judged by the overall rate unless outcomes have an empty host too.  Repeated rows are judged
    alike, other columns are not read, long urls are read whole; no pages give no rows, and
    without outcomes the overall rate is one half.
    """
    p = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    r, overall = reputation(outcomes)
    # Bounds are looked up once for each host, so that only the last join meets a hot host.
    hosts = _named(p.select("host").distinct())
    for k in ("name", "domain", "suffix"):
        hosts = hosts.join(r[k].select(F.col("key").alias(k), F.col("bound").alias(f"{k}_bound")), k, "left")
    hosts = cut(hosts.select("host", F.coalesce("name_bound", "domain_bound", "suffix_bound", F.lit(overall)).alias("bound")))
    p = p.join(hosts, "host")
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("bound") >= limit, "allow").otherwise("block")
    for what, host, path in sorted(rules, key=lambda x: len(x[1] + x[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return p.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), "bound", verdict.alias("verdict"))
