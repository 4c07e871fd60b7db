"""Verdicts on page image addresses: rules first, else the reputation of the host.

Only DataFrame functions: nothing here leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafscribe.llm.common import copied, pin

#: One-sided 95 % bound, and the blocked share that it must exceed.
Z = 1.645
MOST_BLOCKED = 0.5
#: Pages that a parent's mean counts for where the children are too few to tell.
DEFAULT_STRENGTH = 2.0
#: Least and largest correlation between pages of one group that is believed.
LEAST_CORRELATION, MOST_CORRELATION = 0.001, 0.999

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]  # verdict, host, path


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, ASCII letters lower-cased; else empty."""
    found = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://`."""
    rest = F.regexp_replace(_after_scheme(url), r"^[^/?#]*", "")
    return F.coalesce(F.regexp_extract(rest, r"^[^?#]*", 0), F.lit(""))


def _last_labels(host: Column, n: int) -> Column:
    return F.substring_index(host, ".", -n)


def first_rule(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits (host itself or a subdomain, and the start of the path), and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return name, verdict


def _strength(groups: DataFrame, n: str, k: str) -> float:
    """Strength of the beta prior of groups with `n` pages, `k` of them blocked, by the method of moments."""
    counted = groups.where(F.col(n) > 0)
    row = counted.agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum(n).alias("pages"),
        F.sum(k).alias("blocked"),
        F.sum(F.col(n).cast("double") * F.col(n)).alias("squares"),
        F.sum(F.col(k).cast("double") * F.col(k) / F.col(n)).alias("between"),
    ).first()
    if row["groups"] < 2:
        return DEFAULT_STRENGTH
    mean = row["blocked"] / row["pages"]
    spread = mean * (1 - mean)
    room = row["pages"] - row["squares"] / row["pages"] - (row["groups"] - 1)
    if spread <= 0 or room <= 0:
        return DEFAULT_STRENGTH
    excess = row["between"] - row["pages"] * mean * mean - (row["groups"] - 1) * spread
    correlation = min(max(excess / (spread * room), LEAST_CORRELATION), MOST_CORRELATION)
    return 1 / correlation - 1


def _shrunk(n: str, k: str, parent: Column, strength: float) -> Column:
    return (F.col(k) + strength * parent) / (F.col(n) + strength)


def host_reputation(judged: DataFrame, suffix_labels: int = 1) -> DataFrame:
    """Posterior of the blocked share of every host, shrunk to its registered domain, its suffix and the whole.

    judged: `host` and `blocked` (1, 0, or null where the page has no outcome), one row per page. The registered domain is
    the suffix (the last `suffix_labels` labels) and one label more. Each level's prior is a beta distribution
    around the posterior mean of the level above; its strength comes from the spread of the level's shares.
    Returns per host `host`, `pages` (with an outcome), `blocked_pages`, `mean`, `bound` (the mean less Z deviations).
    Hosts without outcomes get their domain's prior. Counts are combined before each shuffle, so a host or domain
    with most pages is no hot spot.
    """
    counts = judged.groupBy("host").agg(
        F.count("blocked").alias("n"), F.coalesce(F.sum("blocked"), F.lit(0)).cast("long").alias("k")
    )
    hosts = pin(
        counts.withColumns(
            {
                "domain": _last_labels(F.col("host"), suffix_labels + 1),
                "suffix": _last_labels(F.col("host"), suffix_labels),
            }
        )
    )
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains = pin(hosts.groupBy("domain", "suffix").agg(*sums))
    suffixes = pin(domains.groupBy("suffix").agg(*sums))
    whole = suffixes.agg(*sums).first()
    mean = (whole["k"] + 1) / (whole["n"] + 2) if whole["n"] is not None else 0.5
    by_suffix = suffixes.select(
        "suffix", _shrunk("n", "k", F.lit(float(mean)), _strength(suffixes, "n", "k")).alias("suffix_mean")
    )
    by_domain = domains.join(copied(by_suffix), "suffix").select(
        "domain", _shrunk("n", "k", F.col("suffix_mean"), _strength(domains, "n", "k")).alias("domain_mean")
    )
    strength = _strength(hosts, "n", "k")
    prior = hosts.join(copied(by_domain), "domain")
    a = F.col("k") + strength * F.col("domain_mean")
    b = F.col("n") - F.col("k") + strength * (1 - F.col("domain_mean"))
    posterior = prior.select("host", "n", "k", a.alias("a"), b.alias("b"))
    total = F.col("a") + F.col("b")
    deviation = F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    return posterior.select(
        "host",
        F.col("n").alias("pages"),
        F.col("k").alias("blocked_pages"),
        (F.col("a") / total).alias("mean"),
        (F.col("a") / total - Z * deviation).alias("bound"),
    )


def judge_image_urls(
    pages: DataFrame, rules: Sequence[Rule], suffix_labels: int = 1, most_blocked: float = MOST_BLOCKED
) -> DataFrame:
    """Verdict on the `image_url` of each page: that of the longest rule that fits, else by its host's reputation.

    pages: `doc_id`, `image_url` (null, or without `://`: host and path empty); other columns are not looked at.
    rules: (verdict, host, path), a short stated list. Pages that a rule decides are the labelled outcomes; a page
    without a rule is blocked if the posterior bound of its host's blocked share is above `most_blocked`.
    Returns per page `doc_id`, `host`, `path`, `rule` (null if none fits), `verdict` (allow or block). Repeated rows give a
    row each; of two equally long rules the later by (host, path) wins; without rules or pages everything is allowed.
    """
    host, path = host_of(F.col("image_url")), path_of(F.col("image_url"))
    split = pages.select("doc_id", host.alias("host"), path.alias("path"))
    rule, decided = first_rule(rules, F.col("host"), F.col("path"))
    ruled = split.select("doc_id", "host", "path", rule.alias("rule"), decided.alias("decided"))
    blocked = F.when(F.col("decided") == "block", 1).when(F.col("decided") == "allow", 0)
    reputation = pin(host_reputation(ruled.select("host", blocked.alias("blocked")), suffix_labels))
    joined = ruled.join(copied(reputation.select("host", "bound")), "host")
    by_host = F.when(F.col("bound") > most_blocked, F.lit("block")).otherwise(F.lit("allow"))
    return joined.select("doc_id", "host", "path", "rule", F.coalesce("decided", by_host).alias("verdict"))
