import re

from syncproof.llm import url_filter as U

URLS = [None, "", "no scheme", "http://EXAMPLE.com/en/x?y#z", "https://www.example.com/en/", "https://sub.www.example.com/en/a", "http://example.com", "http://example.com?x", "http://notexample.com/en/", "ftp://a.net/es/b", "http://net/fr/", "http://net/frx", "http://a.net/ES/", "x://y://z.com/a", "http://com/", "http://a.example.com:80/en/", "http://b.example.com/en", "http://c.com#f/en/", "http://a.org/en/", "http://..com//", "http://é.example.com/en/ü", "http://example.com/en/" + "d/" * 300]


def brute(url, rules=U.RULES):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fit, default=(0, None, "allow"))
    return host, path, rule, verdict


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")


def test_brute_force(spark):
    rules = spark.createDataFrame(U.RULES, "host string, path string, verdict string")
    for most in (200_000, 0):  # broadcast, and joined by shuffle
        got = {r.page.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(pages(spark, URLS + URLS), rules, max_broadcast_rules=most).collect()}
        assert got == {i: brute(u) for i, u in enumerate(URLS + URLS)}


def test_rule_paths_of_any_form(spark):
    more = [("a.com", "/x", "block"), ("a.com", "/x/y.h", "allow"), ("com", "", "allow"), (None, "/", "block")]
    rules = spark.createDataFrame(more, "host string, path string, verdict string")
    urls = ["http://a.com/xyz", "http://a.com/x/y.html", "http://b.com", "http://a.com/w", "http://a.com/x/z"]
    got = {r.page.url: (r.rule, r.verdict) for r in U.judge(pages(spark, urls), rules).collect()}
    assert got == {u: brute(u, more[:3])[2:] for u in urls}


def test_urls_of_many_slashes_and_labels(spark):
    rules = spark.createDataFrame([*U.RULES, ("a.b.c.org", "/1/2/3/4", "block")], "host string, path string, verdict string")
    urls = ["http://" + "x." * 50_000 + "example.com/en/" + "d/" * 100_000, "http://" + "y." * 50_000 + "a.b.c.org/1/2/3/45" + "/" * 200_000, "http://b.c.org/1/2/3/4" + "/" * 200_000]
    got = [r.verdict for r in U.judge(pages(spark, urls), rules).orderBy("page.page_id").collect()]
    assert got == ["block", "block", "allow"]


def test_empty_tables(spark):
    rules = spark.createDataFrame(U.RULES, "host string, path string, verdict string")
    assert U.judge(pages(spark, URLS).limit(0), rules).count() == 0
    assert {r.verdict for r in U.judge(pages(spark, URLS), rules.limit(0), default="block").collect()} == {"block"}


def test_query(spark, sf):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.query(spark, sf).collect()} == {i: brute(u) for i, u in urls.items()}
