import pytest
from pyspark.sql import functions as F

from hazeflow.llm import url_reputation as U

URLS = [
    (1, None, "", "", None),
    (None, "no scheme", "", "", None),
    (3, "http://A.Org", "a.org", "", None),
    (4, "ftp://EXAMPLE.org/es/x?y#z", "example.org", "/es/x", "example.org/es/"),
    (5, "x://a.example.org/en/1?u=http://b.com/", "a.example.org", "/en/1", "example.org/en/1"),
    (5, "x://a.example.org/en/1?u=http://b.com/", "a.example.org", "/en/1", "example.org/en/1"),
    (6, "http://b.com/fr/\n?q", "b.com", "/fr/\n", "com/fr/"),
    (7, "http://xcom/fr/", "xcom", "/fr/", None),
    (8, "://com/de/", "com", "/de/", "com/de/"),
    (9, "http://x.org/", "x.org", "/", "org/"),
    (10, "http://é.org/a#b?c", "é.org", "/a", "org/"),
    (11, "http://x.org:80/", "x.org:80", "/", None),
    (12, "http://" + "a" * 100_000 + ".org/", "a" * 100_000 + ".org", "/", "org/"),
]


def frames(spark):
    pages = spark.createDataFrame([(i, u, 1, "h") for i, u, *_ in URLS], "page_id long, url string, host int, found string")
    return pages, spark.createDataFrame([], "doc_id long, quality int")


def test_rules(spark):
    pages, labels = frames(spark)
    got = U.judged(pages, U.page_outcomes(pages, labels)).collect()
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=str) == sorted(((i, h, p, r) for i, _, h, p, r in URLS), key=str)
    allow = {r.name: r.allow for r in U.RULES}
    assert all(r.verdict == ("allow" if allow.get(r.rule, True) else "block") for r in got)
    assert U.judged(pages.limit(0), U.page_outcomes(pages.limit(0), labels)).count() == 0


def test_longest_rule_and_ties(spark):
    rules = [U.Rule("b.org", "/", True), U.Rule("org", "/x/", False), U.Rule("a.b.org", "/", False)]
    row = spark.createDataFrame([("a.b.org", "/x/y"), ("b.org", "/x/y"), ("c.org", "/x/y")], "host string, path string")
    found = row.select("host", U.matched_rule(F.col("host"), F.col("path"), rules)["rule"].alias("rule")).collect()
    assert {r.host: r.rule for r in found} == {"a.b.org": "a.b.org/", "b.org": "b.org/", "c.org": "org/x/"}


def test_bad_hosts_are_blocked_and_unknown_ones_follow_their_domain(spark):
    good = [(f"h{i}.good.com", 200, 195 - i % 3) for i in range(20)]
    bad = [(f"h{i}.bad.com", 200, 10 + i % 3) for i in range(20)]
    rare = [("new.bad.com", 0, 0), ("one.good.com", 1, 0), ("new.good.com", 0, 0), (None, 9, 0), ("h0.bad.com", 100, 5)]
    found = {r.host: r for r in U.host_reputation(spark.createDataFrame(good + bad + rare, "host string, n long, good long")).collect()}
    assert len(found) == 43 and found["h0.bad.com"].n == 300
    assert all(found[h].upper < 0.5 for h, *_ in bad) and all(found[h].rate > 0.9 for h, *_ in good)
    assert found["new.bad.com"].rate < 0.2 < 0.7 < found["one.good.com"].rate < found["new.good.com"].rate
    pages = spark.createDataFrame([(1, "http://h3.bad.com/x"), (2, "http://h3.good.com/x"), (3, "http://never.seen/")], "page_id long, url string")
    outcomes = spark.createDataFrame(good + bad, "host string, n long, good long")
    assert {r.page_id: r.verdict for r in U.judged(pages, outcomes).collect()} == {1: "block", 2: "allow", 3: "allow"}


def test_outcomes_count_pages(spark):
    pages = [(1, "http://a.com/en/7"), (2, "http://a.com/en/7?x"), (3, "http://a.com/en/8"), (4, "http://a.com/none"), (5, "http://b.com/9"), (6, None)]
    labels = [(7, 1), (8, 0), (8, 1), (9, None), (None, 1)]
    got = U.page_outcomes(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert sorted((r.host, r.n, r.good) for r in got) == [("", 0, 0), ("a.com", 3, 2), ("b.com", 0, 0)]


@pytest.mark.parametrize("host,domain,suffix", [("a.b.c", "b.c", "c"), ("c", "c", "c"), ("", "", ""), ("b.c.", "c.", "")])
def test_domains(spark, host, domain, suffix):
    row = spark.createDataFrame([(host,)], "h string").select(U.domain_of(F.col("h")), U.suffix_of(F.col("h"))).first()
    assert tuple(row) == (domain, suffix)
