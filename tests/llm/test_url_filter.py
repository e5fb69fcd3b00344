import time

from corpusloom.llm import url_filter
from corpusloom.llm.url_filter import RULES, judge_urls

URLS = [
    "https://Example.COM/en/x?q#f", "http://www.example.com/en/", "http://a.www.example.com/en/b", "http://example.com/de/", "http://example.com", "http://example.com/en",
    "http://net/es/1", "http://a.b.net/fr/", "http://net/xx/", "http://notexample.com/en/", "http://example.com:80/en/", "http://u@h.com/", "no scheme/com/", "", None,
    "x://com/", "http:///p", "http://h.org/a#b?c", "http://h.org?x/y", "https://a.com/http://net/es/", "http://münchen.com/ß", "http://h.net/es/" + "a" * 50_000, "http://com./",
]


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]
    fits = [(len(h + p), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, verdict, rule = max(fits, default=(0, default, None))
    return host, path, rule, verdict


def test_verdicts(spark, monkeypatch):
    rows = [(i, u) for i, u in enumerate(URLS * 2)] + [(None, URLS[0])]
    df = spark.createDataFrame([(*r, "h", "r") for r in rows], "page_id long, url string, host string, rule string").repartition(3)
    want = sorted(((i, *brute(u, RULES)) for i, u in rows), key=str)
    assert sorted(map(tuple, judge_urls(df).collect()), key=str) == want
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    assert sorted(map(tuple, judge_urls(df).collect()), key=str) == want
    assert judge_urls(df.limit(0)).count() == 0
    assert {tuple(r)[3:] for r in judge_urls(df, []).collect()} == {(None, "allow")}


def test_ties_and_other_rules(spark):
    rules = [("a.com", "/", "allow"), ("a.com", "/", "block"), ("com", "", "block"), ("b.com", "/x", "allow")]
    urls = ["http://a.com/x", "http://b.com/x", "http://b.com/y", "http://c.com", "http://d.net/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert [tuple(r) for r in judge_urls(df, rules).orderBy("page_id").collect()] == [(i, *brute(u, rules)) for i, u in enumerate(urls)]


def test_rules_as_a_table(spark):
    rules = [("A.com", "/", "allow"), ("a.com", "/x/", "block"), (None, "/", "block"), ("b.com", None, "block"), ("b.com", "/", None)]
    urls = ["http://q.a.com/x/1", "http://a.com/y", "http://b.com/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = judge_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string"), "block")
    assert [r.verdict for r in got.orderBy("page_id").collect()] == ["block", "allow", "block"]
    assert [r.rule for r in got.orderBy("page_id").collect()] == ["a.com/x/", "a.com/", None]


def test_a_host_of_very_many_labels_is_judged_at_once(spark):
    host = "a." * 100_000 + "www.example.com"
    df = spark.createDataFrame([(1, f"http://{host}/en/x"), (2, f"http://{host}.net/fr/"), (3, f"http://{host}.org/")], "page_id long, url string")
    began = time.time()
    assert [r.verdict for r in judge_urls(df, default="block").orderBy("page_id").collect()] == ["allow", "block", "block"]
    assert time.time() - began < 30
