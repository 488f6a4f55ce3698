"""URL filter: explicit rules, and Empirical-Bayes reputation of hosts for what no rule covers.

Labelled page outcomes (1 bad, 0 good) are counted by site (the host without user and port). Three beta-binomial priors
follow each other: the suffix's rate is shrunk towards the global rate, the registered domain's towards its suffix's, the
site's towards its domain's. A prior's mean is the parent's posterior mean; its variance is the parent's posterior variance
and the spread of children around their parents, so doubt is handed down: what nothing is known of keeps the whole spread
of all levels above. The spread comes from the data by the analysis of variance of each level (method of moments), as
pseudo-counts; a level of g labelled groups shows its spread no better than g observations do, so it gives g pseudo-counts
at most, and the global rate is known from g suffixes only (a uniform prior on it). A site is blocked when the lower
bound of its posterior bad rate reaches a limit. DataFrame functions only.

The registered domain is the label before the suffix and the suffix, the last label or one of ``suffixes`` (of two labels).
Numeric addresses are their own domain and suffix.

Defined results: a null url, or one without ``://``, has empty host and path, no rule, and the verdict of the empty
host. Repeated rows are judged each. A null outcome is no evidence. With no labelled page at all every unruled page is
allowed. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, small

#: (host, path, verdict)
Rule = tuple[str, str, str]

LEVELS = ("site", "domain", "suffix")
STRENGTH = (0.5, 1000.0)
# Public suffixes of two labels.
SUFFIXES = (
    "ac.jp", "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn",
    "com.hk", "com.mx", "com.sg", "com.tr", "com.tw", "edu.au", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk",
)


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest fitting rule, else null."""
    out = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def site_of(host: Column) -> Column:
    """The host without user and port."""
    return F.regexp_replace(host, r"^.*@|:[0-9]*$", "")


def _address(site: Column) -> Column:
    return site.rlike(r"^([0-9]+(\.[0-9]+){3}|\[.*)$")


def suffix_of(site: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    two = F.substring_index(site, ".", -2)
    return F.when(_address(site), site).when(two.isin(*suffixes), two).otherwise(F.substring_index(site, ".", -1))


def domain_of(site: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    two = F.substring_index(site, ".", -2)
    return F.when(_address(site), site).when(two.isin(*suffixes), F.substring_index(site, ".", -3)).otherwise(two)


def _moments(groups: DataFrame) -> dict[str, float]:
    row = groups.agg(
        F.count(F.lit(1)).alias("g"), F.sum("n").alias("n"), F.sum("k").alias("k"),
        F.sum(F.col("k") * F.col("k") / F.col("n")).alias("q"),
    ).first()
    return {c: float(row[c] or 0) for c in ("g", "n", "k", "q")}


def prior_strength(child: dict[str, float], parent: dict[str, float]) -> float:
    """Pseudo-counts of the prior that children get from their parents: (1 - r) / r for the intra-class correlation r,
    within STRENGTH and at most the number of children; that end where children do not differ more than chance makes them."""
    most = min(max(child["g"], STRENGTH[0]), STRENGTH[1])
    between, within = child["g"] - parent["g"], child["n"] - child["g"]
    if between <= 0 or within <= 0:
        return most
    msb, msw = (child["q"] - parent["q"]) / between, (child["k"] - child["q"]) / within
    size = child["n"] / child["g"]
    total = msb + (size - 1) * msw
    r = round((msb - msw) / total, 9) if total > 0 else 0.0
    if r <= 0:
        return most
    return min(max((1 - r) / r, STRENGTH[0]), most)


def _posterior(n: Column, k: Column, mean: Column, var: Column, strength: float) -> Column:
    """struct(mean, var) of a group's bad rate, from its counts and its parent's posterior."""
    chance = mean * (1 - mean)
    spread = var + (chance - var) / (strength + 1)
    worth = F.when(spread > 0, chance / spread - 1).otherwise(F.lit(STRENGTH[1]))  # pseudo-counts of a beta prior so wide
    post = (k + worth * mean) / (n + worth)
    return F.struct(post.alias("mean"), (post * (1 - post) / (n + worth + 1)).alias("var"))


def host_reputation(outcomes: DataFrame, *, z: float = 1.645, limit: float = 0.5, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """``outcomes`` (site, bad: 1, 0 or null), a row for each page, to a row for each site: site, n, k, mean, lower, blocked.

    Counts are summed before they are shuffled; only one row of sums for each level reaches the driver.
    """
    site = F.col("site")
    counts = (F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("k"))
    sites = outcomes.groupBy("site").agg(*counts)
    sites = cut(sites.withColumns({"domain": domain_of(site, suffixes), "suffix": suffix_of(site, suffixes)}), "sites")
    total = (F.sum("n").alias("n"), F.sum("k").alias("k"))
    domains = cut(sites.groupBy("domain", "suffix").agg(*total), "domains")
    suffix = cut(domains.groupBy("suffix").agg(*total), "suffixes")
    tables = {"site": sites, "domain": domains, "suffix": suffix}
    sums = {level: _moments(df.filter("n > 0")) for level, df in tables.items()}
    n, k = sums["site"]["n"], sums["site"]["k"]
    sums["all"] = {"g": float(n > 0), "n": n, "k": k, "q": k * k / n if n else 0.0}
    m = {a: prior_strength(sums[a], sums[b]) for a, b in zip(LEVELS, (*LEVELS[1:], "all"), strict=True)}
    groups = sums["suffix"]["g"]
    rate = (groups * (round(k / n, 9) if n else 0.0) + 1) / (groups + 2)
    top = F.lit(rate), F.lit(rate * (1 - rate) / (groups + 3))

    def posterior(level: str, mean: Column, var: Column) -> Column:
        return _posterior(F.col("n"), F.col("k"), mean, var, m[level])

    of_suffix = suffix.select("suffix", posterior("suffix", *top).alias("up"))
    of_domain = domains.join(small(of_suffix), "suffix").select("domain", posterior("domain", F.col("up.mean"), F.col("up.var")).alias("up"))
    of_site = sites.join(small(cut(of_domain, "domain_prior")), "domain").withColumn("x", posterior("site", F.col("up.mean"), F.col("up.var")))
    lower = F.round(F.col("x.mean") - z * F.sqrt("x.var"), 9)
    return of_site.select("site", "n", "k", F.col("x.mean").alias("mean"), lower.alias("lower"), (lower >= limit).alias("blocked"))


def judge_urls(pages: DataFrame, rules: list[Rule], *, id_col: str = "page_id", url_col: str = "url", bad: Column | None = None,
               z: float = 1.645, limit: float = 0.5, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages``; lower: the bound that decided, null where a rule did.

    ``bad`` is the labelled outcome of a page (1, 0 or null). Without it, the pages that rules cover are the labelled
    ones: blocked is 1, allowed 0.
    """
    url = F.col(url_col)
    p = pages.select(F.col(id_col).alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"),
                     (bad if bad is not None else F.lit(None).cast("int")).alias("_bad"))
    p = p.withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    outcome = F.col("_bad") if bad is not None else F.when(F.col("_rule.verdict") == "block", 1).when(F.col("_rule").isNotNull(), 0)
    p = p.withColumn("_site", site_of(F.col("host")))
    scores = host_reputation(p.select(F.col("_site").alias("site"), outcome.cast("int").alias("bad")), z=z, limit=limit, suffixes=suffixes)
    scores = cut(scores.select(F.col("site").alias("_site"), "lower", "blocked"), "reputation")
    joined = p.join(small(scores, 50_000), "_site", "left")
    ruled = F.col("_rule").isNotNull()
    return joined.select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"),
        F.when(ruled, F.col("_rule.verdict")).when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow").alias("verdict"),
        F.when(~ruled, F.col("lower")).alias("lower"),
    )
