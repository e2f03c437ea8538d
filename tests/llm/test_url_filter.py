from collections import Counter

import pytest

from stratabar.llm import url_filter
from stratabar.llm.url_filter import QUERY_RULES, judge_urls

URLS = [
    None, "", "no scheme", "http://", "://x.com/", "http://Example.COM/en/a?x#y", "http://www.example.com/en/a", "http://a.www.example.com/en/", "https://b.example.com/en",
    "http://example.com", "http://example.com?q=/en/", "http://notexample.com/en/", "ftp://x.net/es/1", "ftp://net/fr/", "ftp://x.net/de/", "http://x.com:80/en/", "a://b://c/es/",
    "http://X.Net/ES/", "http://example.com/en/" + "long/" * 5000, "http://" + "a." * 300 + "com/", "http://x.org/\n/é", "http://ÉX.com/",
]


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = []
    for verdict, rule in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((len(rule), len(h), verdict == "block", rule, verdict))
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else default


@pytest.mark.parametrize("most", [50_000, 0])
@pytest.mark.parametrize("rules", [QUERY_RULES, [], [("block", "com"), ("allow", "x.com:80/e"), ("block", "net/e"), ("allow", "x.net/es"), ("block", "x.net/es"), ("block", "b/c")]])
def test_against_brute_force(spark, monkeypatch, rules, most):
    monkeypatch.setattr(url_filter, "MAX_BROADCAST_RULES", most)
    rows = [(i, u, "old", 1) for i, u in enumerate(URLS)] + [(None, "http://a.com/", "x", 2), (3, None, "x", 2)] + [(7, "http://b.net/fr/x", "x", 3)] * 5
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, verdict int").repartition(3)
    got = Counter(tuple(r) for r in judge_urls(pages, rules).collect())
    assert got == Counter((i, *brute(u, rules)) for i, u, _, _ in rows)
    assert judge_urls(pages.limit(0), rules).count() == 0


def test_rules_as_a_table(spark, monkeypatch):
    """Thousands of rules of hundreds of shapes, with null and repeated ones; broadcast and joined by shuffle."""
    rules = [("block" if i % 3 else "allow", "a." * (i % 7) + f"h{i % 50}.com/" + "p" * (i % 90)) for i in range(3000)]
    urls = [f"http://x.{'a.' * (i % 9)}h{i % 50}.com/{'p' * (i % 97)}/q" for i in range(400)] + URLS
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    table = spark.createDataFrame([*rules, *rules[:5], ("block", None)], "verdict string, rule string")
    want = Counter((i, *brute(u, rules)) for i, u in enumerate(urls))
    for most in (50_000, 10):
        monkeypatch.setattr(url_filter, "MAX_BROADCAST_RULES", most)
        assert Counter(tuple(r) for r in judge_urls(pages, table).collect()) == want
    assert {r["verdict"] for r in judge_urls(pages, table.limit(0), default="block").collect()} == {"block"}


def test_plan_has_no_python_and_prunes(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = judge_urls(pages, QUERY_RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "html" not in plan and "BroadcastHashJoin" in plan
