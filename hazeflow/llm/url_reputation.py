"""URL filters: rules, and empirical-Bayes host reputation, in DataFrame functions.

Labelled page outcomes are counted per host. A host's good rate is a beta-binomial posterior whose prior
is its registered domain's posterior mean; the domain's prior is its suffix's, and the suffix's is the rate of all
labelled pages. How many pages a prior is worth is estimated at each level from all its groups by moments.
A page is blocked where even the upper posterior bound of its host is low.

Counts are aggregated map-side, so a host with a third of all pages is one row per task before the shuffle. The
reputations, one row per host, are joined to the pages by Spark's own choice of join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from hazeflow.llm.frames import col
from hazeflow.scratch import materialize

Z = 1.645  # one-sided 95 % bound
MIN_GOOD_RATE = 0.5
MIN_PRIOR, MAX_PRIOR = 2.0, 1000.0


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


RULES = [
    Rule("org", "/", True),
    Rule("example.org", "/es/", False),
    Rule("example.org", "/en/1", False),
    Rule("com", "/fr/", True),
    Rule("com", "/de/", False),
]


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, allow) of the longest rule that fits host and path, or null; equally long ones in text order."""
    found = F.lit(None).cast("struct<rule:string,allow:boolean>")
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name), reverse=True):
        fits = ((host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.allow).alias("allow"))).otherwise(found)
    return found


def domain_of(host: Column) -> Column:
    """The last two labels."""
    return F.regexp_extract(host, r"([^.]*\.)?[^.]*$", 0)


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, r"[^.]*$", 0)


def _strength(level: DataFrame) -> float:
    """How many pages a prior is worth: the beta-binomial moment estimate over all groups of a level (n, good, prior).

    The pooled deviation sum n (p - m)^2 is sum m (1 - m) without over-dispersion, and over-dispersion adds r times
    sum (n - 1) m (1 - m), with r the correlation inside groups; the strength is 1 / r - 1.
    """
    p, m, n = F.col("good") / F.col("n"), F.col("prior"), F.col("n")
    even = m * (1 - m)
    sums = level.filter("n > 0").agg(F.sum(n * (p - m) * (p - m)), F.sum(even), F.sum((n - 1) * even)).first()
    deviation, plain, extra = (x or 0.0 for x in sums)
    r = (deviation - plain) / extra if extra > 0 else 0.0
    return min(max(1 / r - 1, MIN_PRIOR), MAX_PRIOR) if r > 0 else MAX_PRIOR


def _shrunk(level: DataFrame) -> DataFrame:
    """Adds the posterior's parameters and mean as `a`, `b`, `rate` to (n, good, prior)."""
    worth = F.lit(_strength(level))
    good, bad = F.col("good") + worth * F.col("prior"), F.col("n") - F.col("good") + worth * (1 - F.col("prior"))
    return level.withColumns({"a": good, "b": bad, "rate": good / (good + bad)})


def _under(level: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """The level with its parent's rate as `prior`."""
    priors = parent.select(F.col(key).alias("parent"), F.col("rate").alias("prior"))
    return level.join(priors, F.col(key) == F.col("parent")).drop("parent")


def upper_bound(a: Column, b: Column, z: float = Z) -> Column:
    """Upper bound of a beta posterior's mean rate, by its standard deviation."""
    total = a + b
    return a / total + z * F.sqrt(a * b / (total * total * (total + 1)))


def host_reputation(outcomes: DataFrame, z: float = Z) -> DataFrame:
    """(host, n, good, rate, upper): a row per host of `outcomes` (host, n, good), which may repeat hosts.

    `n` counts labelled pages, `good` those with a good label. Hosts without any get their domain's rate.
    Null hosts go. Without any label every rate is 1/2.
    """
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    hosts = outcomes.filter("host is not null").groupBy("host").agg(*sums)
    hosts = materialize(hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}), "hosts")
    domains = materialize(hosts.groupBy("domain", "suffix").agg(*sums), "domains")
    n, good = domains.agg(F.sum("n"), F.sum("good")).first()
    suffixes = materialize(domains.groupBy("suffix").agg(*sums).withColumn("prior", F.lit(good / n if n else 0.5)), "suffixes")
    shrunk = _shrunk(_under(hosts, _shrunk(_under(domains, _shrunk(suffixes), "suffix")), "domain"))
    return shrunk.select("host", "n", "good", "rate", upper_bound(F.col("a"), F.col("b"), z).alias("upper"))


def page_outcomes(pages: DataFrame, labels: DataFrame, url_col: str = "url") -> DataFrame:
    """(host, n, good) from pages whose url path names a labelled document by its first number.

    An id with several labels counts with its lowest. Counted per host and document before the join.
    """
    url = col(url_col)
    named = F.regexp_extract(path_of(url), r"/([0-9]{1,18})", 1)
    seen = pages.select(host_of(url).alias("host"), F.when(named != "", named).cast("long").alias("doc"))
    seen = seen.groupBy("host", "doc").agg(F.count(F.lit(1)).alias("pages"))
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("labelled")).agg(F.min("quality").alias("quality"))
    joined = seen.join(known, F.col("doc") == F.col("labelled"), "left")
    labelled = F.when(F.col("quality").isNotNull(), F.col("pages")).otherwise(F.lit(0))
    good = F.when(F.col("quality") == 1, F.col("pages")).otherwise(F.lit(0))
    return joined.groupBy("host").agg(F.sum(labelled).alias("n"), F.sum(good).alias("good"))


def judged(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[Rule] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    min_good_rate: float = MIN_GOOD_RATE,
    z: float = Z,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, rate, upper): a row per page.

    The longest fitting rule decides; otherwise a page is blocked where its host's upper posterior bound is
    under `min_good_rate`. A null url, or one without `://`, has an empty host and path, and the empty host has a
    reputation like any other. Rows may repeat, ids may be null, an empty table gives none.
    """
    url = col(url_col)
    slim = pages.select(col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    known = host_reputation(outcomes, z).select(F.col("host").alias("known"), "rate", "upper")
    found = matched_rule(F.col("host"), F.col("path"), rules)
    rows = slim.withColumn("found", found).join(known, F.col("host") == F.col("known"), "left")
    allowed = F.when(F.col("found").isNotNull(), F.col("found.allow")).otherwise(~F.coalesce(F.col("upper") < min_good_rate, F.lit(False)))
    verdict = F.when(allowed, F.lit("allow")).otherwise(F.lit("block"))
    return rows.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "rate", "upper")
