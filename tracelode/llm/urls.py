"""URL filters: rules first, then host reputation by empirical Bayes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: (verdict, host, path), in the contract's order.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MAX_RULES = 1000
#: Suffixes of more than one label under which names are registered, unless a table of them is given; any other last label is one.
SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.mx", "gov.uk", "org.uk")
#: Labels of a suffix in such a table at most.
DEEPEST = 5
#: A host is blocked if its bad rate exceeds MAX_BAD with a posterior probability of at least SURE.
MAX_BAD, SURE = 0.5, 0.95
#: Range of a prior's strength in pages.
STRENGTH = (1.0, 1000.0)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty without `://`."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(F.substr(after, F.length(host) + 1), r"^[^?#]*", 0)


def _labels(host: Column) -> Column:
    return F.split(F.regexp_replace(host, r"^.*@|:[0-9]*$", ""), r"\.")


def _last(labels: Column, n: Column) -> Column:
    return F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - n + 1), n), ".")


def domain_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host without user and port, by SUFFIXES."""
    labels = _labels(host)
    n = F.when(_last(labels, F.lit(2)).isin(*SUFFIXES), 2).otherwise(1)
    return _last(labels, n + 1), _last(labels, n)


def with_domains(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """hosts(host, ...) with domain and suffix; suffixes(suffix) is a public-suffix table without wildcards, SUFFIXES where None.

    The longest suffix of the table that ends the host counts, else its last label. Hosts are distinct, and each
    meets the table by DEEPEST equalities at most, in a plain join.
    """
    if suffixes is None:
        domain, suffix = domain_suffix(F.col("host"))
        return hosts.withColumns({"domain": domain, "suffix": suffix})
    labels = _labels(F.col("host"))
    each = hosts.select("host", F.explode(F.sequence(F.lit(1), F.least(F.lit(DEEPEST), F.size(labels)))).alias("depth"))
    each = each.withColumn("suffix", _last(labels, F.col("depth")))
    known = each.join(suffixes.select("suffix").distinct(), "suffix").groupBy("host").agg(F.max("depth").alias("depth"))
    n = F.coalesce("depth", F.lit(1))
    return hosts.join(known, "host", "left").withColumns({"domain": _last(labels, n + 1), "suffix": _last(labels, n)}).drop("depth")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path joined, and its verdict; nulls if none fits."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules don't belong in one expression")
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block"))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ranked]
    pick = lambda value: F.coalesce(F.lit(None).cast("string"), *[F.when(fit, F.lit(value(r))) for fit, r in zip(fits, ranked)])
    return pick(lambda r: r[1] + r[2]), pick(lambda r: r[0])


def _strength(groups: DataFrame, mean: Column | float) -> float:
    """Pages that a beta prior around the given means is worth: 1 / rho - 1, rho the groups' intraclass correlation by moments."""
    mean = F.lit(mean) if isinstance(mean, float) else mean
    rate = F.col("bad") / F.col("n")
    k, total, squares, spread = groups.where("n > 0").agg(F.count("*"), F.sum("n"), F.sum(F.col("n") * F.col("n")), F.sum(F.col("n") * F.pow(rate - mean, F.lit(2.0)) / (mean * (1 - mean)))).first()
    if not total:
        return STRENGTH[1]
    room = total - squares / total - (k - 1)
    rho = (spread - (k - 1)) / room if room > 0 else 0.0
    return STRENGTH[1] if rho <= 0 else min(max(1 / rho - 1, STRENGTH[0]), STRENGTH[1])


def _log_gamma(z: Column) -> Column:
    """ln of the gamma function for z > 0: Stirling's series seven places further up."""
    up, below = z + 7, sum((F.log(z + k) for k in range(1, 7)), F.log(z))
    series = 1 / (12 * up) - 1 / (360 * up * up * up) + 1 / (1260 * up * up * up * up * up)
    return (up - 0.5) * F.log(up) - up + 0.9189385332046727 + series - below


def beta_below(x: float, a: Column, b: Column) -> Column:
    """Probability that a beta(a, b) variable is at most x: the regularised incomplete beta function by its continued fraction.

    The fraction converges on its side of the mean in about the root of the larger parameter's steps; the other side is the complement.
    """
    flip = F.lit(x) > (a + 1) / (a + b + 2)
    p, q = F.when(flip, b).otherwise(a), F.when(flip, a).otherwise(b)
    t = F.when(flip, 1 - x).otherwise(x)
    tiny = F.lit(1e-300)
    safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)

    def step(acc: Column, m: Column) -> Column:
        even = m * (q - m) * t / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * t / ((p + 2 * m) * (p + 2 * m + 1))
        d1, c1 = 1 / safe(1 + even * acc["d"]), safe(1 + even / acc["c"])
        d2, c2 = 1 / safe(1 + odd * d1), safe(1 + odd / c1)
        return F.struct(c2.alias("c"), d2.alias("d"), (acc["f"] * d1 * c1 * d2 * c2).alias("f"))

    d0 = 1 / safe(1 - (p + q) * t / (p + 1))
    start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("f"))
    steps = F.sequence(F.lit(1), (40 + 6 * F.sqrt(F.greatest(a, b))).cast("int"))
    fraction = F.aggregate(F.transform(steps, lambda m: m.cast("double")), start, step)["f"]
    front = F.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * F.log(t) + q * F.log(1 - t)) / p
    return F.when(flip, 1 - front * fraction).otherwise(front * fraction)


def reputation(hosts: DataFrame, max_bad: float = MAX_BAD, suffixes: DataFrame | None = None) -> DataFrame:
    """hosts(host, n, bad): labelled pages and bad ones; adds bad_rate, the bad rate's posterior mean, and doubt, the posterior probability that the rate is max_bad or less.

    A suffix is shrunk towards the overall rate, a registered domain towards its suffix,
    a host towards its domain, each by a beta prior whose strength is estimated from
    how much that level's groups differ. A host without labels has its domain's
    rate, with the prior's width. Only four numbers come to the driver.
    """
    held = written(with_domains(hosts.select("host", "n", "bad"), suffixes), "hosts")
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    n, bad = held.agg(*sums).first()
    overall = ((bad or 0) + 1) / ((n or 0) + 2)
    of_suffix = held.groupBy("suffix").agg(*sums)
    m = _strength(of_suffix, overall)
    of_suffix = of_suffix.select("suffix", ((F.lit(overall * m) + F.col("bad")) / (m + F.col("n"))).alias("above"))
    of_domain = written(held.groupBy("suffix", "domain").agg(*sums).join(of_suffix, "suffix"), "domains")
    m = _strength(of_domain, F.col("above"))
    of_domain = of_domain.select("domain", ((F.col("above") * m + F.col("bad")) / (m + F.col("n"))).alias("prior"))
    joined = written(held.join(of_domain, "domain"), "reputations")
    m = _strength(joined, F.col("prior"))
    a, b = F.col("prior") * m + F.col("bad"), (1 - F.col("prior")) * m + F.col("n") - F.col("bad")
    posterior = joined.select("host", a.alias("a"), b.alias("b"))
    return posterior.select("host", (F.col("a") / (F.col("a") + F.col("b"))).alias("bad_rate"), beta_below(max_bad, F.col("a"), F.col("b")).alias("doubt"))


def judge(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, max_bad: float = MAX_BAD, sure: float = SURE, suffixes: DataFrame | None = None) -> DataFrame:
    """(id, host, path, rule, verdict) of every page; outcomes(id, bad) are the labelled pages.

    A fitting rule decides, of equally long ones a blocking one; else the host's reputation does: blocked if its bad rate exceeds max_bad with
    posterior probability sure. A null url has the empty host, which has a reputation like any other. An id labelled more than once is bad if any label says
    so; null labels count as none. Repeated pages and null ids are pages like others, other columns take no part, and a url may have any length. A host's
    pages are summed before the shuffle; its verdict is joined back by a plain join, whose hot keys Spark splits.
    """
    host, path = host_path(F.col(url_col))
    seen = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    known = outcomes.where("id is not null and bad is not null").groupBy("id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    hosts = seen.join(known, "id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    bad = reputation(hosts, max_bad, suffixes).select("host", (F.col("doubt") <= 1 - sure).alias("blocked"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = seen.withColumns({"rule": rule, "ruled": verdict})
    return ruled.join(bad, "host", "left").select("id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))
