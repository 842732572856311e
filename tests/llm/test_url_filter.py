"""The URL trie against a plain scan of all rules."""

import random

import pytest

from factloom.llm.url_filter import RULES, RuleTrie, judge_urls, split_url

URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/7?x#y", "https://a.example.com/en/712/z", "https://a.example.com/en/8", "http://com/en/", "http://xcom/en/", "http://example.net/de/8", "http://b.example.net/de/9/", "http://q.net/de", "http://q.org/es/1#t", "http://q.org?es/", "ftp://q.org#/es/", "x://y://z.com/en/", "http://É.com/en/é", "http://..com/en/"]


def plain(url, rules):
    host, path = split_url(url)
    fits = [(len(h.split(".")) if h else 0, len(p), v, h + p) for h, p, v in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_split():
    assert split_url("HTTP://WWW.Example.COM/en/7?x#y") == ("www.example.com", "/en/7")
    assert split_url("http://q.org?es/") == ("q.org", "")
    assert split_url("x://y://z.com") == ("y:", "//z.com")
    assert split_url("no scheme") == ("", "")


def test_rules_and_random_rules(spark):
    rng = random.Random(2)
    pick = lambda k: "/".join(rng.choice(["", "a", "ab", "abc", "b"]) for _ in range(k))
    rules = list({(h, p): (h, p, v) for h, p, v in [(".".join(rng.choice(["a", "b", "com"]) for _ in range(rng.randint(1, 3))), "/" + pick(rng.randint(1, 3)), rng.choice(["allow", "block"])) for _ in range(60)]}.values())
    urls = URLS + [f"http://{'.'.join(rng.choice(['a', 'b', 'com']) for _ in range(rng.randint(1, 4)))}/{pick(3)}" for _ in range(400)]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)] + [(0, None, None)], "page_id long, url string, host string")
    for own in (RULES, rules):
        want = sorted((k, *plain(u, own)) for k, u in enumerate(urls))
        for most in (10**6, 0):  # the trie, then the join beyond its bound
            got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, own, max_rules=most).collect())
            assert [x for k, x in enumerate(got) if k != 1] == want
    assert judge_urls(pages.limit(0)).count() == 0


def test_ties_prefer_block():
    assert RuleTrie([("com", "/", "block"), ("com", "/", "allow")]).find("com", "/x") == ("com/", "block")


def test_long_urls_and_null_rules(spark):
    long = "http://" + "a." * 5000 + "com/" + "en/" * 50_000
    pages = spark.createDataFrame([(1, long)], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in judge_urls(pages).collect()] == [("com/en/", "block")]
    with pytest.raises(ValueError):
        judge_urls(pages, [("com", None, "block")])
