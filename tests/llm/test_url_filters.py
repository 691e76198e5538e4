from __future__ import annotations

import re

from calltide.llm import url_filters

ENTRIES = [("a.com", "block", 10), ("a.com", "remove", 20), ("x.a.com", "allow", 12), ("A.com/p", "block", 5), ("a.com", "block", 10), ("a.com", "allow", 10), (None, "block", 1), ("b.com", None, 1), ("c.com", "block", None)]


def test_as_of_decisions(spark):
    entries = spark.createDataFrame(ENTRIES, "target string, verdict string, listed_at long")
    cases = [
        ("http://a.com/", 9, None), ("http://a.com/", 10, "block"), ("http://A.COM:80/x", 19, "block"), ("http://a.com", 20, None), ("https://x.a.com/p/1", 12, "allow"),
        ("https://x.a.com/q", 11, "block"), ("https://u:p@y.a.com/p?q#r", 30, "block"), ("http://aa.com/p", 15, None), ("http://b.com/", 5, None), ("http://c.com/", 5, None), ("nonsense", 15, None),
        (None, 15, None), ("http://a.com/", None, None), ("", 15, None), ("http://a.com./p" + "x" * 100_000, 15, "block"), ("http://a.com/", 10, "block"),
    ]
    captures = spark.createDataFrame([(k, u, t, "own") for k, (u, t, _) in enumerate(cases)], "id int, url string, fetched_at long, verdict string").withColumns({c: url_filters.F.lit("clash") for c in ("__host", "__rules", "path", "rules", "at")})
    for most in (url_filters.BROADCAST_BYTES, -1):
        got = {r.id: r for r in url_filters.evaluate(captures, entries, broadcast_bytes=most).collect()}
        assert len(got) == len(cases)
        for k, (_, _, want) in enumerate(cases):
            assert got[k].verdict == want and got[k].keep == (want != "block"), (k, got[k])
    assert got[5].target == "a.com" and got[14].target == "a.com/p"


def test_empty_tables_and_plan(spark):
    entries = spark.createDataFrame(ENTRIES, "target string, verdict string, listed_at long")
    captures = spark.createDataFrame([("http://a.com/", 15)], "url string, fetched_at long")
    assert url_filters.evaluate(captures.limit(0), entries).count() == 0
    assert url_filters.evaluate(captures, entries.limit(0)).first().keep
    assert not re.search("Python|Arrow|Pandas", url_filters.evaluate(captures, entries)._jdf.queryExecution().executedPlan().toString())


def test_many_paths_under_one_domain(spark):
    """Both forms agree where a domain has many rules; the form by URL holds no row with all of them."""
    entries = spark.createDataFrame([(f"big.com/{k}", ("block", "allow")[k % 2], 10 + k % 7) for k in range(500)] + [("com", "block", 3), ("big.com/1", "remove", 15)], "target string, verdict string, listed_at long")
    captures = spark.createDataFrame([(k, f"http://www.big.com/{k}/x", 5 + k % 15) for k in range(300)] + [(1000, "http://other.org/", 50)], "id int, url string, fetched_at long")
    one, two = (sorted((r.id, r.verdict, r.target, r.listed_at) for r in url_filters.evaluate(captures, entries, broadcast_bytes=most).collect()) for most in (1 << 30, -1))
    assert one == two and len(one) == 301 and {v for _, v, *_ in one} == {"block", "allow", None}
    urls = captures.select(url_filters.host_of(url_filters.F.col("url")).alias("host"), url_filters.path_of(url_filters.F.col("url")).alias("path"))
    sizes = [len(r.rules) for r in url_filters.rules_by_url(urls, url_filters.intervals(entries)).collect()]
    assert max(sizes) <= 5
