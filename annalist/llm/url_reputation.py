"""URL filters: rules first, else an empirical-Bayes reputation of the host.

Labelled outcomes of pages (bad or not) are counted per host, registered domain and suffix. The suffix is the last label, or
the last two where a two-letter label follows one of SECOND ("co.uk"); the registered domain is one label more. Each
level's rates are shrunk towards the level above through a beta prior whose mean is the parent's posterior mean and whose
strength comes from the spread of the level's rates (method of moments, between MIN_STRENGTH and MAX_STRENGTH). A host is
blocked when the lower posterior bound of its bad rate (mean - Z deviations) exceeds LIFT times the rate of all outcomes,
or LIMIT if that is less. A host without outcomes has its domain's expectation.
Null urls and urls without `://` have empty host and path. Every page gives one row, repeated ones and ones of a null id too;
repeated pages count as often as they come, a page of a null id has no outcome. With no outcomes at all nothing but the
rules blocks; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import materialize

# Fixed rules: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
MIN_STRENGTH, MAX_STRENGTH = 2.0, 1000.0
Z = 1.645
LIMIT = 0.5
LIFT = 1.5
SALTS = 64
SECOND = ("ac", "co", "com", "edu", "gov", "net", "org")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    host = lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, own, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        name = F.when(fits, F.lit(own + start)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _strength(level: DataFrame) -> tuple[float, float]:
    """Mean rate and prior strength of a level's (n, k) rows."""
    row = level.where("n > 0").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("*").alias("units"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("s")).first()
    if not row.n:
        return 0.5, MIN_STRENGTH
    p = row.k / row.n
    spread = row.s / row.n - p * p - row.units * p * (1 - p) / row.n
    strength = p * (1 - p) / spread - 1 if spread > 0 else MAX_STRENGTH
    return p, min(max(strength, MIN_STRENGTH), MAX_STRENGTH)


def domain_of(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host."""
    labels = F.split(host, r"\.")
    double = (F.size(labels) > 2) & (F.length(F.element_at(labels, -1)) == 2) & F.get(labels, F.size(labels) - 2).isin(*SECOND)
    pick = lambda n: F.when(double, F.substring_index(host, ".", -n - 1)).otherwise(F.substring_index(host, ".", -n))
    return pick(2), pick(1)


def host_reputation(outcomes: DataFrame, z: float = Z, limit: float = LIMIT, lift: float = LIFT) -> DataFrame:
    """(host, n, k, mean, lower, blocked) from outcomes (host, bad: 1, 0 or null where nothing is known)."""
    hosts = outcomes.where("host IS NOT NULL").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("k"))
    domain, suffix = domain_of(F.col("host"))
    # Counts of hosts are written once; five plans read them.
    hosts = materialize(hosts.withColumn("domain", domain).withColumn("suffix", suffix), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    top, s1 = _strength(suffixes)
    _, s2 = _strength(domains)
    _, s3 = _strength(hosts)
    suffixes = suffixes.select("suffix", ((F.col("k") + s1 * top) / (F.col("n") + s1)).alias("m1"))
    domains = domains.join(suffixes, "suffix").select("domain", ((F.col("k") + s2 * F.col("m1")) / (F.col("n") + s2)).alias("m2"))
    out = hosts.join(domains, "domain").select("host", "n", "k", (F.col("k") + s3 * F.col("m2")).alias("a"), (F.col("n") - F.col("k") + s3 * (1 - F.col("m2"))).alias("b"))
    a, b = F.col("a"), F.col("b")
    mean = a / (a + b)
    lower = mean - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return out.select("host", "n", "k", mean.alias("mean"), lower.alias("lower"), (lower > min(limit, lift * top)).alias("blocked"))


def judge(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(id_col, host, path, rule, verdict) for every row of pages. outcomes: id_col, bad; rows of unknown pages are ignored.

    Only hosts that are blocked are joined back, salted, so a host with a third of all pages is spread over SALTS keys.
    """
    host, path = split_url(F.col(url_col))
    base = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    known = outcomes.where(F.col("bad").isNotNull()).groupBy(id_col).agg(F.max("bad").alias("bad"))
    blocked = host_reputation(base.join(known, id_col, "left").select("host", "bad")).where("blocked").select("host", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit("block").alias("reputation"))
    salted = base.withColumn("salt", F.pmod(F.xxhash64(id_col, "path"), F.lit(SALTS)).cast("int"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return salted.join(blocked, ["host", "salt"], "left").select(id_col, "host", "path", name.alias("rule"), F.coalesce(verdict, "reputation", F.lit("allow")).alias("verdict"))
