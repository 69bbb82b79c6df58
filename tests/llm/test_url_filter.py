import random

import pytest

from millrace.llm import url_filter
from millrace.llm.queries import OP9_RULES


def plain(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:n])
        tail = rest[n:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(h.count("."), len(p), v == "block", h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def check(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()}
    assert got == {i: plain(u, rules) for i, u in enumerate(urls)}
    left = url_filter.allowed(pages, rules)
    assert left.columns == pages.columns
    assert {r.page_id for r in left.collect()} == {i for i, u in enumerate(urls) if plain(u, rules)[3] == "allow"}


def test_awkward_urls(spark):
    check(spark, [None, "", "no scheme", "http://", "://x", "HTTP://EXAMPLE.ORG/en/1", "http://example.org", "http://a.example.org/en/17?q#f", "http://xexample.org/en/1", "http://É.com/fr/", "http://a.com?x=/fr/", "ftp://b.com#/fr/", "http://a.com/fr/" + "x" * 100_000, "http://a.com//fr/", "http://a.com/fr", "a://b://c.com/fr/"] * 2, OP9_RULES)


def test_random_rules(spark):
    rng = random.Random(4)
    host = lambda: ".".join(rng.choices(["a", "b", "c"], k=rng.randint(1, 3)))
    path = lambda: "/" + "/".join(rng.choices(["x", "xy", "y", ""], k=rng.randint(1, 3)))
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h, p in ((host(), rng.choice(["", path()])) for _ in range(40))}.values())
    check(spark, [f"http://{host()}{path()}" for _ in range(400)], rules)


def test_limits(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(pages, OP9_RULES).count() == 0
    with pytest.raises(ValueError):
        url_filter.judge(pages, OP9_RULES, max_rules=2)
    with pytest.raises(ValueError):
        url_filter.judge(pages, [("maybe", "a", "/")])
