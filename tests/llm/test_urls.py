"""URL parts, seed rules, wildcards and rejected templates."""

import pytest

from affectlake.llm import urls


def judged(spark, listed, **kw):
    rows = [(i, u, "x") for i, u in enumerate(listed)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, host string"), **kw).collect()
    assert len(got) == len(rows)
    return [r for r in sorted(got, key=lambda r: r.page_id)]


@pytest.mark.parametrize("url,host,path,rule", [
    ("http://A.Example.org/es/1?x#y", "a.example.org", "/es/1", "example.org/es/"),
    ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/"),
    ("http://notexample.org/es/1", "notexample.org", "/es/1", "org/"),
    ("ftp://x.com/fr/://a", "x.com", "/fr/://a", "com/fr/"),
    ("http://org", "org", "", None), ("http://x.net?q=/fr/", "x.net", "", None), ("x.org/a", "", "", None),
    (None, "", "", None), ("", "", "", None), ("http://", "", "", None), ("http://ÄB.org/é\n", "Äb.org", "/é\n", "org/"),
])
def test_parts_and_rules(spark, url, host, path, rule):
    one = judged(spark, [url, url])[0]
    assert (one.host, one.path, one.rule) == (host, path, rule)


def test_templates_of_bad_branches_are_rejected(spark):
    rules = [("h.net", "/bad/1", "block"), ("h.net", "/good/1", "allow"), ("o.net", "/", "allow")]
    listed = [f"http://h.net/bad/{i}" for i in range(100, 120)] + [f"http://h.net/good/{i}" for i in range(100, 140)]
    listed += ["http://o.net/a"] * 50 + ["http://h.net/bad/7", "http://h.net/good/7", "http://new.net/x"]
    got = judged(spark, listed, rules=rules)
    assert [r.verdict for r in got[-3:]] == ["block", "allow", "allow"]
    assert got[-3].template == "h.net/bad/{n}"


def test_many_values_become_a_wildcard(spark):
    listed = [f"http://h.net/u/{chr(97 + i % 26)}{chr(97 + i // 26)}/page" for i in range(60)]
    assert {r.template for r in judged(spark, listed)} == {"h.net/u/{*}/page"}


def test_long_and_empty(spark):
    assert judged(spark, ["http://h.net/" + "a/" * 2_000])[0].verdict == "allow"
    assert judged(spark, []) == []
