"""URL filters: the longest fitting rule, against a plain loop."""

import random

import pytest

from riskloom.llm import url_filter as U

ROWS = "page_id long, url string, host string, html string, tag string, digest string, best string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, after = rest[:cut], rest[cut:]
    end = min([after.find(c) for c in "?#" if c in after], default=len(after))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), after[:end]


def plain(url, rules, default="allow"):
    host, path = parts(url)
    fit = [
        (len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules
        if h is not None and (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fit, default=None)
    return (host, path, best[3] if best else None, best[4] if best else default)


def judged(spark, urls, rules, **more):
    pages = spark.createDataFrame([(k, u, "x", "y", "z", "q", "r") for k, u in urls], ROWS)
    return sorted((tuple(r) for r in U.judge(pages, U.rule_table(spark, rules), **more).collect()), key=repr)


def expected(urls, rules, **more):
    return sorted(((k, *plain(u, rules, **more)) for k, u in urls), key=repr)


URLS = [
    "http://example.com/en/1", "http://EXAMPLE.com/en/", "https://www.example.com/en/a?b=/x#c", "https://a.www.example.com/en/", "http://example.com/en",
    "http://example.net/es/", "http://net/fr/9", "http://xnet/fr/9", "http://a.b.net/FR/1", "http://example.com", "http://example.com?u=://net/fr/", "com/",
    None, "", "://", ":///en/", "http://example.com./en/", "http://example.com:80/en/", "mailto:x", "http://É.Com/ü", "x://y://net/es/", "http://com#/",
    "http://example.com/en/" + "a" * 50_000, "http://" + "l." * 20_000 + "net/es/1",
]


def test_the_rules_of_the_query(spark):
    urls = [(k % 9 or None, u) for k, u in enumerate(URLS * 2)]
    assert judged(spark, urls, U.RULES) == expected(urls, U.RULES)


@pytest.mark.parametrize("broadcast", [True, False])
def test_many_rules(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(U, "broadcast_if_small", lambda df: df)
    random.seed(4)
    labels, steps = ["a", "b", "com", "net", ""], ["/", "/x", "/x/", "", "/xy", "x"]
    host = lambda n: ".".join(random.choice(labels[:4]) for _ in range(n))
    rules = [(host(random.randint(0, 3)), "".join(random.choices(steps, k=2)), random.choice(["allow", "block"])) for _ in range(80)]
    rules += rules[:5] + [(None, "/", "block")]
    urls = [(k, f"h://{host(random.randint(0, 4))}{''.join(random.choices(steps, k=3))}{random.choice(['', '?q', '#/'])}") for k in range(300)]
    assert judged(spark, urls, rules, default="block") == expected(urls, rules, default="block")


def test_empty_tables(spark):
    assert judged(spark, [], U.RULES) == []
    assert judged(spark, [(1, "http://example.com/en/")], []) == [(1, "example.com", "/en/", None, "allow")]


def test_equal_short_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(U, "PREFIX_DIGITS", 1)
    urls = [(k, f"http://{chr(97 + k % 20)}.example.com/en/{k}") for k in range(60)]
    rules = [*U.RULES, *[(f"{chr(97 + k)}.example.com", "/en/", "block") for k in range(0, 20, 3)]]
    assert judged(spark, urls, rules) == expected(urls, rules)
