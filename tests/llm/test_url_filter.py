import re

import pytest

from strandlake.llm import url_filter as U

URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Example.ORG", "http://example.org/es/1?x", "http://www.example.org/en/12", "http://example.org/en/2", "http://notexample.org/es/1",
    "https://m.casino.example.net/a", "https://a.example.net/x/casino/y/win/", "https://casinos.example.net/", "http://x.com/fr/1", "http://x.com/de/casino", "http://x.com", "http://x.com/pt/setup.exe?q",
    "http://a.net/track#http://b.org/", "http://h.net:80/p/free-bets.html", "http://free-bets.net/p", "http://u.net/?a&affid=3",
]


def brute(url):
    text = url or ""
    host = path = ""
    if "://" in text:
        rest = text.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h) + len(p), v, h + p) for v, h, p in U.SITE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        _, verdict, rule = max(fit)
        return host, path, rule, verdict
    return host, path, None, "block" if any(re.search(p, text.lower()) for p, _ in U.PATTERN_RULES) else "allow"


def test_against_every_rule(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(3, URLS[3])], "page_id long, url string").selectExpr("*", "1 AS host", "2 AS rule")
    got = U.judge_urls(pages).collect()
    assert sorted((r.page_id, r.host, r.path, str(r.rule), r.verdict) for r in got) == sorted((i, *map(str, brute(u))) for i, u in [*enumerate(URLS), (3, URLS[3])])
    assert U.judge_urls(pages.limit(0)).count() == 0


def test_matches_hold_their_literals():
    samples = [u for u in URLS if u] + [f"http://{a}{w}{b}/p/{w}/q.{w}.z?{w}=1" for w in {x for _, ls in U.PATTERN_RULES for x in ls} for a in ("", "a.", "a-") for b in (".net", "-x.net")]
    for pattern, literals in U.PATTERN_RULES:
        for u in samples:
            if re.search(pattern, u.lower()):
                assert set(literals) <= set(re.findall("[a-z0-9]+", u.lower())), (pattern, u)


def test_rules_are_filed_under_their_rarest_token(spark):
    pages = spark.createDataFrame([(1, "http://win.net/win/win")] + [(2, "http://win.org/casino")], "page_id long, url string")
    index = {r.rule_id: r.token for r in U.rarest_index(pages, "url", U.rule_table(spark, ((r"casino.*win", ("casino", "win")),))).collect()}
    assert index == {0: "casino"}
    with pytest.raises(ValueError):
        U.rule_table(spark, (("x", ()),))


def test_more_rules_than_may_be_broadcast(spark, monkeypatch):
    pages = spark.createDataFrame([*enumerate(URLS), (40, "http://a.net/" + "x/" * 40_000 + "casino/win/")], "page_id long, url string")
    whole = sorted(map(tuple, U.judge_urls(pages).collect()), key=str)
    monkeypatch.setattr(U, "BROADCAST_RULES", 3)
    assert sorted(map(tuple, U.judge_urls(pages).collect()), key=str) == whole
    assert sorted(map(tuple, U.judge_urls(pages, pattern_rules=U.rule_table(spark)).collect()), key=str) == whole
