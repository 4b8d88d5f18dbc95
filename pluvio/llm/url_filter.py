"""URL filters: host rules, and an empirical-Bayes reputation of hosts; DataFrame functions only.

Outcomes of labelled pages are shrunk from suffix to registered domain to host. At each level the bad share of a node
is a draw from a Beta around its parent's posterior mean; how tightly is estimated from the spread between the
nodes of that level (method of moments). A page is blocked when the lower posterior bound of its host's bad share
is above the limit, so a host without clear evidence is allowed. A host without outcomes is a new draw from its registered
domain, or, when that has none either, from its suffix: the bound then holds the spread between the nodes of the levels below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvio.llm.common import staged

#: verdict, host, path
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
LIMIT, Z = 0.5, 1.645  # bad share above which a host is blocked, and how sure it must be (one-sided 95 %)
WEAKEST, STRONGEST = 2.0, 1000.0  # bounds of a prior's weight in pages
#: Suffixes of two labels under which names are registered; all others have one label.
LONG_SUFFIXES = ["co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz", "com.cn", "co.za"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both are empty without `://` and for null."""
    after = F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([\s\S]*)$", 1), F.lit(""))
    return F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=None) -> Column:
    """The longest rule (verdict, rule) that fits, null if none does. A tie goes to `block`."""
    rules = sorted(RULES if rules is None else rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r))
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(v).alias("verdict"), F.lit(h + p).alias("rule")))
            for v, h, p in rules]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<verdict:string,rule:string>")


def _levels(df: DataFrame) -> DataFrame:
    """Adds domain and suffix of `host`."""
    labels = F.split("host", r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2), ".")
    n = F.when(two.isin(LONG_SUFFIXES), 2).otherwise(1)

    def last(k):
        return F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - k + 1), k), ".")

    return df.withColumn("suffix", last(n)).withColumn("domain", last(n + 1))


def _weight(nodes: DataFrame) -> float:
    """Weight of the prior in pages: how little nodes (n, bad, prior) differ from their priors beyond chance."""
    expect = F.col("prior") * (1 - F.col("prior"))
    got = nodes.where("n > 0").agg(
        F.sum(F.pow(F.col("bad") - F.col("n") * F.col("prior"), 2) / F.greatest(expect, F.lit(1e-6)) - F.col("n")).alias("excess"),
        F.sum(F.col("n") * (F.col("n") - 1.0)).alias("pairs")).first()
    if not got["pairs"]:
        return STRONGEST
    # Var(bad) = n p (1 - p) (1 + (n - 1) rho) under a Beta-binomial with rho = 1 / (weight + 1)
    rho = max(got["excess"] / got["pairs"], 0.0)
    return round(min(max(1 / rho - 1, WEAKEST), STRONGEST), 6) if rho else STRONGEST


def _low(share: Column, n, weight: float) -> Column:
    return share - Z * F.sqrt(share * (1 - share) / (n + weight + 1))


def reputation(outcomes: DataFrame) -> dict[str, DataFrame]:
    """(node, n, bad, share, low) of each suffix, domain and host of labelled pages (host, bad 0/1).

    `share` is the posterior mean of the bad share, `low` its lower bound: for a host that of the host, for a domain or suffix
    that of a host below it that has no outcomes.
    """
    hosts = _levels(outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad")))
    hosts = staged(hosts, "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    nodes = hosts.withColumn("prior", F.lit((total["bad"] + 1) / (total["n"] + 2) if total["n"] else 0.5))
    levels, weights = {}, {}
    for level in ("suffix", "domain"):
        keys = ["suffix"] if level == "suffix" else ["suffix", "domain"]
        here = nodes.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.first("prior").alias("prior"))
        here = staged(here, "level")  # a domain may hold most hosts; a join of two tables can be split by key
        weights[level] = weight = _weight(here)
        share = (F.col("bad") + weight * F.col("prior")) / (F.col("n") + weight)
        levels[level] = here.withColumn("share", share)
        nodes = nodes.drop("prior").join(here.select(*keys, share.alias("prior")), keys)
        nodes = staged(nodes, "nodes")
    weights["host"] = weight = _weight(nodes)
    levels["host"] = nodes.withColumn("share", (F.col("bad") + weight * F.col("prior")) / (F.col("n") + weight))
    # Share of p (1 - p) by which a new host differs from its domain; below a suffix its domain is new as well.
    of_host, of_domain = 1 / (weight + 1), 1 / (weights["domain"] + 1)
    new = {"domain": of_host, "suffix": of_domain + (1 - of_domain) * of_host}
    return {level: df.withColumn("low", _low(F.col("share"), F.col("n"), weight) if level == "host" else _low(F.col("share"), 0, 1 / new[level] - 1))
            .select(F.col(level).alias("node"), "n", "bad", "share", "low") for level, df in levels.items()}


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """host, n, bad, share, low from labelled pages (host, bad 0/1): posterior mean and lower bound of the bad share."""
    return reputation(outcomes)["host"].withColumnRenamed("node", "host")


def blocked_hosts(hosts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The rows of `hosts` (host, distinct) whose bound is above LIMIT, at the deepest level that has outcomes."""
    found = _levels(hosts)
    for level, nodes in reputation(outcomes).items():
        found = found.join(nodes.select(F.col("node").alias(level), F.col("low").alias(f"{level}_low")), level, "left")
    return found.where(F.coalesce("host_low", "domain_low", "suffix_low") > LIMIT).select("host")


def judge(pages: DataFrame, labels: DataFrame, rules=None) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of `pages` (page_id, url; other columns are ignored).

    `labels` (doc_id, quality, toxic) gives outcomes of pages with that id: bad is quality 0 or toxic 1; a row without id or
    quality is no outcome, and a page with several outcomes has each. Without a rule a page gets its host's verdict: block when
    the lower bound of the host's bad share is above LIMIT, else allow. A host without outcomes is judged by its registered domain, a
    domain without outcomes by its suffix; without any outcome, and for an empty host, the verdict is allow.
    Repeated rows get a row each. Empty tables give no rows, or no outcomes.
    """
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    outcome = labels.where("doc_id is not null and quality is not null").select(
        F.col("doc_id").alias("id"), ((F.col("quality") == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("long").alias("bad"))
    outcomes = rows.join(outcome, F.col("page_id") == F.col("id")).where("host <> ''").select("host", "bad")
    hosts = staged(rows.where("host <> ''").select("host").distinct(), "page_hosts")
    blocked = staged(blocked_hosts(hosts, outcomes).select(F.col("host").alias("blocked")), "blocked")
    found = rows.join(blocked, F.col("host") == F.col("blocked"), "left").withColumn("r", matching_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("blocked").isNotNull(), "block").otherwise("allow")
    return found.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", own).alias("verdict"))
