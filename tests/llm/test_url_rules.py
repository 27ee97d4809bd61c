import re

from barspark.llm import url_rules
from pyspark.sql import functions as F

URLS = [
    "https://www.Example.NET/en/1", "http://example.net/EN/1", "http://example.net", "http://a.net/", "x.net/en/", None, "", "http://example.com/de/",
    "http://example.com/de", "http://m.example.com/de/?q=1", "http://notexample.com/de/1", "http://a.b.org/fr/x#y", "http://a.org/frx/", "http://org/fr/",
    "ftp://host:80/a/login/b", "http://cart.shop.com/x", "http://shop.com/cartoon", "http://q.org/a?u=http://x.net/", "://", "http://?x", "http://x.com#a/b",
    "http://x.com/wp-admin/", "http://ÄÖ.net/é", "http://a.net\n/b", "http://example.net/en/" + "a/" * 5000 + "zip", "http://b.com/ZIP",
    "http://b.com/page/2/page/3", "http://b.com/page/page", "http://b.com/a/tag/x.tag", "http://b.com/x;jsessionid=1A/y", "http://b.com/sid=9", "http://b.com/rss/1", "http://b.com/blog/feed/",
    "http://b.com/feeds", "http://b.com/a.tar.gz", "http://b.com/a.tar.gz/b", "http://b.com/a.pdf?x", "http://ad.b.com/", "http://ads7.b.com/x", "http://bad.com/", "http://ads", "http://x.banner1.com/",
    "http://x.com/banner.1", "http://b.com/index.php/index.php/x", "http://b.com/calendar/2020/01/calendar/2021", "http://tracker-x.com/", "http://b.com/wp-json/v2", "http://b.com/x.amp",
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [
        (len(h + p), h + p, v)
        for v, h, p in (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    place, parts = host + path, re.split(r"[./]", host + path)
    told = bool(set(parts) & set(url_rules.SEGMENTS) | set(re.split(r"[^A-Za-z0-9]", host)) & set(url_rules.HOST_WORDS))
    for word in ("page", "tag", "category", "calendar", "search"):  # twice, with something between
        at = [i for i, x in enumerate(parts) if x == word]
        told |= len(at) > 1 and at[-1] - at[0] > 1
    told |= ";jsessionid=" in place or any(x.startswith("sid=") for x in parts) or "wp-json" in parts
    told |= any(parts[i : i + 4] == ["index", "php"] * 2 for i in range(len(parts)))
    trimmed = place.removesuffix("/") if place.endswith(("feed/", "print/", "trackback/", "amp/")) else place
    last = re.split(r"[./]", trimmed)
    told |= last[-1] in ("feed", "rss", "print", "trackback", "amp") or last[-2:] == ["xmlrpc", "php"]
    told |= place.endswith((".pdf", ".tar.gz", ".mp3", ".apk", ".iso", ".webm"))
    told |= host.startswith("ad.") or host.startswith(("ads", "adserv", "track", "click", "pixel")) and "." in host
    told |= any(x.startswith(("banner", "affiliate")) and n < host.count(".") for n, x in enumerate(host.split(".")))
    return host, path, None, "block" if told else "allow"


def test_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(URLS + URLS[:3])] + [(None, URLS[0], "h", "p")], "page_id long, url string, host string, path string")
    rows = url_rules.judge(pages).collect()
    assert len(rows) == len(URLS) + 4
    for r in rows:
        u = (URLS + URLS[:3])[r.id] if r.id is not None else URLS[0]
        assert (r.host, r.path, r.rule, r.verdict) == brute(u), u
    assert url_rules.judge(pages.limit(0)).count() == 0


def test_rules_without_literal_are_tried(spark):
    pages = spark.createDataFrame([(1, "http://a.b/ü"), (2, "http://a.b/c"), (3, "http://a.b/xqx")], "page_id long, url string")
    rules = (url_rules.Rule("odd", "ü"), url_rules.Rule("q", "*q*"), url_rules.Rule("z", "^z^"))
    assert {r.id: r.verdict for r in url_rules.judge(pages, rules).collect()} == {1: "block", 2: "allow", 3: "block"}
    many = url_rules.table_of(spark, tuple(url_rules.Rule(str(i), f"*{'u' * i}ü*" if i else "*xq*") for i in range(2 * url_rules.WITHOUT_LITERAL + 5)))
    assert {r.id: r.verdict for r in url_rules.judge(pages, many).collect()} == {1: "allow", 2: "allow", 3: "block"}


def test_patterns(spark):
    rows = [
        ("||ex.org/a", ["ex", "org"], ["ex.org/a", "www.ex.org/ab"], ["nex.org/a", "a/ex.org/a"]), ("||ads-*.com^", ["ads", "com"], ["ads-1.com/x", "m.ads-1.b.com"], ["xads-1.com", "ads.com"]),
        ("|m.a*/b|", ["m", "b"], ["m.a/b", "m.abc/x/b"], ["x.m.a/b", "m.a/b/"]), ("^old^", ["old"], ["x.com/old", "old.com", "a/old/b"], ["x/older", "a/old-b"]),
        ("~old~", ["old"], ["x/old-b", "my-old.com"], ["x/older"]), ("a+(b)*", ["b"], ["xa+(b)y"], ["aab"]), ("/c*d/e?", ["e"], ["/cxd/e?"], ["/cd/e"]),
    ]
    for r in spark.createDataFrame([(i, x[0]) for i, x in enumerate(rows)], "i int, p string").select("i", url_rules.regex_of(F.col("p")).alias("r"), url_rules.literals_of(F.col("p")).alias("t")).collect():
        (_, tokens, good, bad), regex = rows[r.i], r.r.replace(r"\z", r"\Z")
        assert sorted(r.t) == sorted(tokens), rows[r.i]
        assert all(re.search(regex, x) for x in good) and not any(re.search(regex, x) for x in bad), (rows[r.i], regex)


def test_many_rules_run_few_expressions(spark):
    """Of a hundred thousand rules a URL meets those that are filed under its tokens only."""
    n = 100_000
    rules = spark.range(n).selectExpr("concat('r', id) AS rule", "concat('||h', id % 5000, '.example.com/s', id, '^') AS pattern", "'block' AS verdict", "'place' AS scope", "false AS site")
    pages = spark.range(2000).selectExpr("id AS page_id", "concat('http://www.h', id % 50, '.example.com/s', id, '/x') AS url")
    host, path = url_rules.host_and_path(F.col("url"))
    places = pages.groupBy(host.alias("host"), path.alias("path")).agg(F.count("*").alias("n"))
    assert url_rules.candidates(places, rules).count() <= 2 * 2000
    verdicts = {r.id: r.verdict for r in url_rules.judge(pages, rules).collect()}
    assert {i for i, v in verdicts.items() if v == "block"} == {i for i in range(2000) if i % 5000 == i % 50}
