"""Empirical-Bayes host reputation for URL filtering (operator 2): built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import LOWER, UPPER, saved, shared_folder

#: What the contract's query applies: (verdict, host, path prefix).
RULES = (
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
)
#: Strength of a prior (pseudo-pages) stays in these limits, however little or much its children differ.
WEAKEST, STRONGEST = 1.0, 1000.0


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or a URL without ://."""
    pattern = r"://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)


#: Labels under which country domains register names at the third level (the default rule).
SECOND_LEVELS = ("ac", "co", "com", "edu", "go", "gob", "gov", "mil", "ne", "net", "nom", "or", "org", "sch")


def suffix_and_domain(host: Column, second_levels: Sequence[str], suffixes: Column | None = None) -> tuple[Column, Column]:
    """Public suffix and registered domain (one label more) of a host.

    User names and ports are taken off first; numeric addresses are a suffix and a domain of their own. By default
    the suffix is the last label, or the last two where a two-letter label follows one of second_levels. suffixes, an
    array column of a public suffix list's names, goes before that rule: the longest that the host ends with.
    """
    name = F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":[0-9]*$", "")
    labels = F.split(name, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - n + 1), n), ".")
    two = (F.size(labels) > 2) & F.length(last(F.lit(1))).eqNullSafe(F.lit(2)) & F.get(labels, F.size(labels) - 2).isin(list(second_levels))
    n = F.when(two, 2).otherwise(1)
    if suffixes is not None:
        listed = F.array_max(F.transform(F.filter(suffixes, lambda s: (name == s) | name.endswith(F.concat(F.lit("."), s))), lambda s: F.size(F.split(s, r"\."))))
        n = F.coalesce(listed, n)
    address = name.rlike(r"^([0-9]+(\.[0-9]+){3}|\[.*\])$")
    return F.when(address, name).otherwise(last(n)), F.when(address, name).otherwise(last(n + 1))


def strength(level: DataFrame) -> float:
    """a + b of the beta prior that a level's children (n, good, mu) have around their parents' means.

    Beta-binomial moments: the squared deviations beyond binomial noise, over their maximum, are the
    correlation rho within a child, and a + b = 1 / rho - 1.
    """
    noise = F.col("mu") * (1 - F.col("mu"))
    over = F.sum(F.pow(F.col("good") - F.col("n") * F.col("mu"), 2) - F.col("n") * noise)
    most = F.sum(F.col("n") * (F.col("n") - 1) * noise)
    row = level.agg(over.alias("over"), most.alias("most")).first()
    rho = row.over / row.most if row.most else 0.0
    return min(STRONGEST, max(WEAKEST, 1 / rho - 1)) if rho > 0 else STRONGEST


def shrunk(level: DataFrame) -> tuple[DataFrame, float]:
    s = strength(level)
    return level.withColumn("mean", (F.col("good") + s * F.col("mu")) / (F.col("n") + s)), s


def host_posteriors(hosts: DataFrame, z: float) -> DataFrame:
    """hosts has host, suffix, domain, n, good; adds mean and bound (mean less z posterior deviations).

    Top down: the overall rate (Jeffreys) is the prior mean of each suffix, a suffix's posterior mean that of
    its domains, a domain's that of its hosts.
    """
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")).first()
    counts = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    suffixes, _ = shrunk(hosts.groupBy("suffix").agg(*counts).withColumn("mu", F.lit((total.good + 0.5) / (total.n + 1))))
    domains = hosts.groupBy("suffix", "domain").agg(*counts)
    domains, _ = shrunk(domains.join(suffixes.select("suffix", F.col("mean").alias("mu")), "suffix"))
    own, s = shrunk(hosts.join(domains.select("suffix", "domain", F.col("mean").alias("mu")), ["suffix", "domain"]))
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + s + 1))
    return own.withColumn("bound", F.col("mean") - z * sd)


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, rules: the rules whose host is the host or a parent of it, longest first. rules: verdict, host, path."""
    labels = F.split("host", r"\.")
    ups = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    named = rules.select(F.col("host").alias("up"), F.col("path").alias("at"), "verdict", F.concat("host", "path").alias("rule"))
    fit = hosts.select("host", F.explode(ups).alias("up")).join(named, "up")
    return fit.groupBy("host").agg(F.sort_array(F.collect_set(F.struct(F.length("rule").alias("n"), "rule", "at", "verdict")), asc=False).alias("rules"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", second_levels: Sequence[str] = SECOND_LEVELS, suffix_list: Sequence[str] | None = None, z: float = 1.645, least_good: float = 0.75) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, good_mean, good_bound, n_labelled.

    outcomes (page_id, good 0/1) are the labelled pages. A host's good pages are shrunk towards its registered
    domain, that towards its public suffix and that towards all pages, through beta-binomial priors whose
    strength comes from the moments of each level. A page is allowed if the lower posterior bound (normal
    approximation, z deviations) of its host's good rate reaches least_good; the longest rule that fits host
    and path goes before that. Hosts without labels have their domain's posterior.

    A null URL or one without :// has empty host and path, which are a host like any other and fit no rule.
    Outcomes with null good count nowhere; repeated pages or outcomes each count. Equally long rules: the
    greater text wins. Without any outcome the mean is 0.5. An empty table gives no rows.
    Public suffixes are told by a rule (second_levels under two-letter domains), or by suffix_list, names of a public
    suffix list that the caller holds; ports, user names and numeric addresses: see suffix_and_domain.
    Per page only id, host and path are shuffled; hosts are counted with a map-side combine first.
    """
    folder = shared_folder(pages.sparkSession)
    host, path = url_parts(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    good = outcomes.where("good is not null").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("long")).alias("good"))
    seen = urls.join(good, urls["id"] == good["page_id"], "left")
    listed = F.array(*map(F.lit, suffix_list)) if suffix_list else None
    suffix, domain = suffix_and_domain(F.col("host"), second_levels, listed)
    zero = F.lit(0).cast("long")
    hosts = seen.groupBy("host").agg(F.coalesce(F.sum("n"), zero).alias("n"), F.coalesce(F.sum("good"), zero).alias("good"))
    hosts = saved(hosts.withColumns({"suffix": suffix, "domain": domain}), folder, "hosts")
    known = host_posteriors(hosts, z).join(rules_by_host(hosts, rules), "host", "left")
    known = saved(known.select("host", "mean", "bound", F.col("n").alias("n_labelled"), "rules"), folder, "known")
    best = F.get(F.filter("rules", lambda r: F.col("path").startswith(r["at"])), F.lit(0))
    out = urls.join(known, "host").withColumn("best", best)
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("bound") >= least_good, "allow").otherwise("block"))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), F.col("mean").alias("good_mean"), F.col("bound").alias("good_bound"), "n_labelled")
