"""URL filters against a plain evaluation of every rule on every URL."""

import re

from fileglade.llm import urlrules


def brute(url):
    """(host, path, rule, verdict) with every site and pattern rule tried on the URL."""
    if url is None or "://" not in url:
        host, path = "", ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [
        (len(h + p), h + p, v) for h, p, v in urlrules.SITE_RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    if fits:
        _, rule, verdict = max(fits)
        return host, path, rule, verdict
    low = (url or "").lower()
    hits = [(v, p) for v, p in urlrules.PATTERN_RULES if re.search(urlrules.pattern_regex(p), low)]
    verdict = "allow" if any(v == "allow" for v, _ in hits) or not hits else "block"
    return host, path, None, verdict


URLS = [
    None, "", "no scheme here", "HTTP://Sub.Example.NET/en/x?q=1", "https://example.net/de/", "https://anet/x",
    "http://a.b.example.com/de/page#frag", "http://example.com/DE/", "ftp://x.org/fr/file", "http://x.org/fr",
    "https://spam-farm.example.info/a", "https://www.cheap-pills.example.info/", "http://help.site.info/a/faq",
    "http://help.site.info/a/faq?utm_source=feed", "http://x.info/ads/1", "http://x.info/uploads/1",
    "http://x.info/get.exe", "http://x.info/banner.png", "http://ÄB.example.info/en/", "http://x.info/a://b.net/",
    "https://x.info/" + "a" * 20_000 + "?utm_source=feed", "http://a.info/go.php?u=1", "https://a.info/go.php?u=1",
]


def test_against_every_rule(spark):
    rows = [(i, u, "extra") for i, u in enumerate(URLS)] + [(1, URLS[1], "again")]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlrules.judged(pages).collect()}
    want = {(i, *brute(u)) for i, u in enumerate(URLS)}
    assert got == want
    assert urlrules.judged(pages).count() == len(rows)


def test_tokens_and_empty(spark):
    assert urlrules.whole_tokens("||spam-farm.*") == ["spam", "farm"]
    assert urlrules.whole_tokens("*ads*") == []
    assert urlrules.whole_tokens("/ads/*") == ["ads"]
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urlrules.judged(empty).count() == 0
    none = urlrules.judged(spark.createDataFrame([(1, "http://x.info/a.exe")], "page_id long, url string"), pattern_rules=[])
    assert none.first().verdict == "allow"
