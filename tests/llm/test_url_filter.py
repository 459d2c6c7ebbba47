import random
import re

from chainloom.llm.url_filter import HOST_RULES, PATTERNS, Rule, filter_urls, literal_tokens, regular_expression, split_url

URLS = [
    "https://a.example.net/en/1", "http://EXAMPLE.net/en", "http://x.net", "http://x.net/", "http://net/p", "http://fooexample.net/en/", "https://b.example.com/de/x?y#z",
    "https://example.org/fr/", "https://example.org/frx", "https://spam-farm.example.org/en/", "https://my.spam-farm.org/fr/1", "https://notspam-farm.org/", "no scheme", "", None,
    "://", "http://", "http://h?q=/ads/", "http://h/p/login", "http://h/loginx", "http://h/login?x", "ftp://h/x.exe", "http://h/CASINO", "http://h/casino-x", "http://h.net:80/x",
    "http://a/b://c.net/", "http://é.net/é", "http://h/robots.txt", "http://h/robots.txt?x", "http://x.example.net/EN/", "http://u@x.net/",
]


def brute(rules, url, default="allow"):
    host, path, rest = split_url(url)
    text = host + path + rest
    fit = [r for r in rules if text and re.search(regular_expression(r.pattern), text, re.DOTALL)]
    best = min(fit, key=lambda r: (-r.rank, -len(r.pattern), r.name or r.pattern), default=None)
    return host, path, best.name if best else None, best.verdict if best else default


def test_matches_trying_every_rule(spark):
    rng = random.Random(8)
    words = ["ads", "net", "en", "shop", "x1", "é"]
    signs = ["/", ".", "*", "^", "-", "?"]
    rules = HOST_RULES + PATTERNS
    rules += [Rule(rng.choice(["", "|", "||"]) + "".join(rng.choice(words) + rng.choice(signs) for _ in range(rng.randrange(1, 4))) + rng.choice(["", "|", "en"]), rng.choice(["allow", "block"]), f"r{i}") for i in range(60)]
    urls = URLS + ["http://" + "".join(rng.choice(words) + rng.choice(["/", ".", "-", "?"]) for _ in range(rng.randrange(1, 6))) for _ in range(200)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    for size in (1 << 20, 40):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, rules, rule_bytes=size).collect()}
        assert got == {i: brute(rules, u) for i, u in enumerate(urls)}


def test_tokens_are_in_every_match():
    assert literal_tokens("||net/") == {"net"} and literal_tokens("/ads/*x") == {"ads"} and literal_tokens("casino") == set()
    assert literal_tokens("|http^en|") == {"http", "en"} and literal_tokens("*.exe|") == {"exe"}


def test_edges(spark):
    pages = spark.createDataFrame([(1, "http://x.net/", "mine"), (1, "http://x.net/", "mine")], "page_id bigint, url string, host string")
    out = filter_urls(pages, HOST_RULES)
    assert out.columns == ["page_id", "url", "host", "_host", "path", "rule", "verdict"]
    assert [tuple(r)[2:] for r in out.collect()] == [("mine", "x.net", "/", "net/", "block")] * 2
    assert filter_urls(pages.limit(0), HOST_RULES).count() == 0
    assert {r.verdict for r in filter_urls(pages, []).collect()} == {"allow"}
