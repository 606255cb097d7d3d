"""URL filter: explicit rules first, then empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted per host.  At each level of suffix, registered
domain and host a beta prior is centred on the parent's posterior mean; its strength comes from the
nested ANOVA estimate of the intraclass correlation within parents, bounded to 1 to 100 pages.  Every host of the
pages is judged, one without outcomes by its domain's prior.  A host is blocked if the lower bound of its
posterior bad rate is over the rate of all outcomes: it is credibly worse than the crawl as a whole, so
a few bad pages don't condemn a host, and the limit follows the base rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

#: (verdict, host, path); the longest rule that fits decides.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: How many deviations (on the log-odds scale) the bound lies below the middle, and how many times the base rate it must exceed.
Z, TIMES = 1.0, 1.0
#: Steps of the recurrences of digamma and trigamma.
STEPS = 6
#: Bounds of a prior's strength, in pages.
WEAKEST, STRONGEST = 1.0, 100.0
#: Second-level labels that belong to the suffix of a two-letter domain, as in co.uk.
SECOND = ("co", "com", "org", "net", "ac", "gov", "edu", "or", "ne", "go")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


_NUMBER = r"^[^?#]*/([0-9]{1,18})(?:[.][A-Za-z0-9]+)?/?(?:[?#]|$)"


def document_number(url: Column) -> Column:
    """The number that ends a page's path: the id of the document that the page shows."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _NUMBER, 1).try_cast("long")


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as host and path, its verdict) of the longest rule that fits, or nulls."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r))
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in reversed(ranked):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _labels(host: Column) -> tuple[Column, Column]:
    """(host without port, number of labels in its suffix)."""
    name = F.regexp_replace(host, ":[0-9]*$", "")
    return name, F.when(name.rlike(rf"(?:^|[.])(?:{'|'.join(SECOND)})[.][a-z]{{2}}$"), 2).otherwise(1)


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one label more, as far as there is one."""
    name, n = _labels(host)
    return F.when(n == 2, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def suffix_of(host: Column) -> Column:
    name, n = _labels(host)
    return F.when(n == 2, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))


def host_reputation(outcomes: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """outcomes(host, bad 0/1) -> per host: n, bad, the posterior's mean and lower_bound, and base_rate (of all outcomes).

    hosts(host) adds hosts without outcomes (n = 0), judged by their domain's or suffix's posterior, or the base rate.
    Null outcomes and hosts are left out; no outcomes give no rows.
    """
    counted = outcomes.where("bad is not null and host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("k"))
    if hosts is not None:
        counted = hosts.where("host is not null").select("host").distinct().join(counted, "host", "full").fillna(0, ["n", "k"])
    # one row a host, written once: every level below reads it
    counted = written(counted.select("*", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix")), "hosts")
    domains = counted.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk"))
    s = _strength(suffixes, "sn", "sk", None, "ms").crossJoin(_strength(domains, "dn", "dk", "suffix", "md").drop("p")).crossJoin(_strength(counted, "n", "k", "domain", "mh").drop("p"))  # one row
    level = suffixes.crossJoin(F.broadcast(s))
    level = level.withColumn("s_mean", (F.col("sk") + F.col("ms") * F.col("p")) / (F.col("sn") + F.col("ms")))
    level = domains.join(level, "suffix").withColumn("d_mean", (F.col("dk") + F.col("md") * F.col("s_mean")) / (F.col("dn") + F.col("md")))
    level = counted.join(level.drop("suffix"), "domain")
    a = F.col("k") + F.col("mh") * F.col("d_mean")
    b = F.col("n") - F.col("k") + F.col("mh") * (1 - F.col("d_mean"))
    level = level.select("host", "n", F.col("k").alias("bad"), a.alias("a"), b.alias("b"), F.col("p").alias("base_rate"))
    return level.select("host", "n", "bad", (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"), lower_bound(F.col("a"), F.col("b")).alias("lower_bound"), "base_rate")


def lower_bound(a: Column, b: Column, z: float = Z) -> Column:
    """z deviations below the mean of beta(a, b) on the log-odds scale, where it is nearly normal; 0 or 1 at the ends.

    Log odds have the mean digamma(a) - digamma(b) and the variance trigamma(a) + trigamma(b).  Both are taken by their first
    terms at x + STEPS, where these are near, and brought back to x by their recurrences, so that small parameters are right too.
    """

    def mean(x: Column) -> Column:
        y = x + STEPS
        return F.log(y) - 1 / (2 * y) - 1 / (12 * y * y) - sum((1 / (x + i) for i in range(1, STEPS)), 1 / x)

    def variance(x: Column) -> Column:
        y = x + STEPS
        return 1 / y + 1 / (2 * y * y) + 1 / (6 * y * y * y) + sum((1 / ((x + i) * (x + i)) for i in range(1, STEPS)), 1 / (x * x))

    odds = mean(a) - mean(b) - z * F.sqrt(variance(a) + variance(b))
    return F.when(a <= 0, 0.0).when(b <= 0, 1.0).otherwise(1 / (1 + F.exp(-odds)))


def _strength(groups: DataFrame, n: str, k: str, parent: str | None, out: str) -> DataFrame:
    """One row: overall rate p and the strength of the prior of groups within their parents, 1 / rho - 1 within its bounds.

    rho is the intraclass correlation of a nested analysis of variance; groups without outcomes don't count.
    """
    groups = groups.where(F.col(n) > 0)
    n_, k_ = F.col(n).cast("double"), F.col(k).cast("double")
    own = groups.groupBy(*([parent] if parent else [])).agg(F.count(F.lit(1)).alias("g"), F.sum(n_).alias("n1"), F.sum(n_ * n_).alias("n2"), F.sum(k_).alias("k1"), F.sum(k_ * k_ / n_).alias("kk"))
    total = {c: F.sum(c) for c in ("g", "n1", "k1", "kk")} | {"pk": F.sum(F.col("k1") * F.col("k1") / F.col("n1")), "pn": F.sum(F.col("n2") / F.col("n1")), "parents": F.count(F.lit(1))}
    sums = own.where("n1 > 0").agg(*(c.alias(x) for x, c in total.items()))
    free = F.nullif(F.col("g") - F.col("parents"), F.lit(0))
    # between and within mean squares, in sums over groups: sum n(k/n - p)^2 = kk - k1^2/n1 in each parent
    msb = (F.col("kk") - F.col("pk")) / free
    msw = (F.col("k1") - F.col("kk")) / F.nullif(F.col("n1") - F.col("g"), F.lit(0.0))
    n0 = (F.col("n1") - F.col("pn")) / free
    rho = F.try_divide(msb - msw, msb + (n0 - 1) * msw)
    strength = F.when(rho > 0, 1 / rho - 1).otherwise(STRONGEST)
    return sums.where("n1 > 0").select((F.col("k1") / F.col("n1")).alias("p"), F.least(F.lit(STRONGEST), F.greatest(F.lit(WEAKEST), strength)).alias(out))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, times: float = TIMES) -> DataFrame:
    """pages(url, ...) with host, path, rule and verdict; outcomes(host, bad) trains the reputation.

    A null url, or one without ://, has empty host and path, which no rule fits and which is allowed, and so is
    every host if there are no outcomes.  Repeated rows are judged alike; columns named host, path, rule and
    verdict are replaced, all others kept; an empty table gives an empty table.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    key, bad = fresh(pages, "key", "bad")
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    judged = host_reputation(outcomes, pages.select(host.alias("host"))).where(F.col("host") != "")
    judged = judged.select(F.col("host").alias(key), (F.col("lower_bound") > times * F.col("base_rate")).alias(bad))
    base = pages.withColumns({"host": host, "path": path})
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    out = base.join(judged, F.col("host") == F.col(key), "left")
    own = F.when(F.coalesce(F.col(bad), F.lit(False)), "block").otherwise("allow")
    return out.withColumns({"rule": rule, "verdict": F.coalesce(verdict, own)}).drop(key, bad)


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad) of the pages whose document is labelled: bad is low quality or toxic."""
    found = pages.select(url_host(F.col("url")).alias("host"), document_number(F.col("url")).alias("doc_id")).where("doc_id is not null")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    marks = labels.groupBy("doc_id").agg(F.max(bad).alias("bad"))
    return found.join(marks, "doc_id").select("host", "bad")


def digest(pages: DataFrame, labels: DataFrame) -> DataFrame:
    pages = pages.select("page_id", "url")
    return filter_urls(pages, page_outcomes(pages, labels)).select("page_id", "host", "path", "rule", "verdict")


def _strength_sql(table: str, n: str, k: str, parent: str, out: str) -> str:
    return f"""(SELECT k1 / n1 AS p, least({STRONGEST}, greatest({WEAKEST}, CASE WHEN rho > 0 THEN 1 / rho - 1 ELSE {STRONGEST} END)) AS {out}
 FROM (SELECT *, (msb - msw) / nullif(msb + (n0 - 1) * msw, 0) AS rho
 FROM (SELECT *, (kk - pk) / nullif(g - parents, 0) AS msb, (k1 - kk) / nullif(n1 - g, 0) AS msw, (n1 - pn) / nullif(g - parents, 0) AS n0
 FROM (SELECT sum(g) AS g, sum(n1) AS n1, sum(k1) AS k1, sum(kk) AS kk, sum(k1 * k1 / n1) AS pk, sum(n2 / n1) AS pn, count(*) AS parents
 FROM (SELECT {parent} AS parent, count(*) AS g, sum({n}::DOUBLE) AS n1, sum({n}::DOUBLE * {n}) AS n2, sum({k}::DOUBLE) AS k1, sum({k}::DOUBLE * {k} / {n}) AS kk FROM {table} WHERE {n} > 0 GROUP BY 1))) ))"""


_TWO = f"regexp_matches(nm, '(^|[.])({'|'.join(SECOND)})[.][a-z]{{2}}$')"
_LABEL = "[^.]*([.][^.]*)"
_MEAN = f"ln({{x}} + {STEPS}) - 1 / (2 * ({{x}} + {STEPS})) - 1 / (12 * ({{x}} + {STEPS}) ** 2) - (" + " + ".join(f"1 / ({{x}} + {i})" for i in range(STEPS)) + ")"
_VARIANCE = f"1 / ({{x}} + {STEPS}) + 1 / (2 * ({{x}} + {STEPS}) ** 2) + 1 / (6 * ({{x}} + {STEPS}) ** 3) + " + " + ".join(f"1 / (({{x}} + {i}) ** 2)" for i in range(STEPS))
SQL = f"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, try_cast(regexp_extract(coalesce(url, ''), '{_NUMBER}', 1) AS BIGINT) AS num FROM pages),
marks AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad FROM labels GROUP BY doc_id),
o AS (SELECT host, count(*) AS n, sum(bad) AS k FROM p JOIN marks ON num = doc_id WHERE bad IS NOT NULL GROUP BY host),
nm0 AS (SELECT host, regexp_replace(host, ':[0-9]*$', '') AS nm, coalesce(n, 0) AS n, coalesce(k, 0) AS k FROM (SELECT DISTINCT host FROM p) LEFT JOIN o USING (host)),
h AS (SELECT host, n, k, CASE WHEN {_TWO} THEN regexp_extract(nm, '{_LABEL}{{0,2}}$') ELSE regexp_extract(nm, '{_LABEL}?$') END AS domain,
  CASE WHEN {_TWO} THEN regexp_extract(nm, '{_LABEL}$') ELSE regexp_extract(nm, '[^.]*$') END AS suffix FROM nm0),
d AS (SELECT domain, suffix, sum(n) AS dn, sum(k) AS dk FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, sum(dn) AS sn, sum(dk) AS sk FROM d GROUP BY suffix),
m AS (SELECT a.p, a.ms, b.md, c.mh FROM {_strength_sql("s", "sn", "sk", "1", "ms")} a, {_strength_sql("d", "dn", "dk", "suffix", "md")} b, {_strength_sql("h", "n", "k", "domain", "mh")} c WHERE a.p IS NOT NULL),
sm AS (SELECT suffix, (sk + ms * p) / (sn + ms) AS s_mean, md, mh, p FROM s, m),
dm AS (SELECT domain, (dk + md * s_mean) / (dn + md) AS d_mean, mh, p FROM d JOIN sm USING (suffix)),
ab AS (SELECT host, k + mh * d_mean AS a, n - k + mh * (1 - d_mean) AS b, p FROM h JOIN dm USING (domain)),
judged AS (SELECT host, CASE WHEN a <= 0 THEN 0 WHEN b <= 0 THEN 1 ELSE 1 / (1 + exp(-({_MEAN.format(x='a')} - ({_MEAN.format(x='b')}) - {Z} * sqrt({_VARIANCE.format(x='a')} + {_VARIANCE.format(x='b')})))) END > {TIMES} * p AS bad FROM ab WHERE host <> ''),
r AS (SELECT p.page_id, p.host, p.path, j.bad,
  CASE WHEN (p.host = 'example.net' OR p.host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
       WHEN (p.host = 'example.com' OR p.host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
       WHEN (p.host = 'org' OR p.host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
       WHEN (p.host = 'net' OR p.host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p LEFT JOIN judged j ON p.host = j.host)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN coalesce(bad, false) THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
