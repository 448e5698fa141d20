import random
import re

from pyspark.sql import functions as F

from mercato.llm import queries, url_filter

SCHEMA = "page_id long, url string"


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def urls():
    rng = random.Random(3)
    hosts = ["example.org", "a.example.org", "Example.ORG", "org", "x.com", "com", "notexample.org", "de", "", "a..com", "örg.org"]
    paths = ["", "/", "/es", "/es/", "/es/x", "/en/1", "/en/17?x=/es/", "/fr/#/de/", "/de/a", "?q=/", "#/fr/", "/en/\n1"]
    made = [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)]
    return [*made, None, "", "no scheme", "http:/x.com/", "a://b://c.com/fr/", "://org/"]


def test_verdicts_equal_brute_force(spark):
    found = urls()
    pages = spark.createDataFrame(list(enumerate(found)), SCHEMA).withColumn("rule", F.lit("clash"))
    for rules in (queries.URL_RULES, [("block", "com", "/"), ("allow", "x.com", ""), ("block", "x.com", "/fr")], []):
        rows = url_filter.judge(pages, rules).collect()
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows} == \
            {i: brute(u, rules) for i, u in enumerate(found)}


def test_repeated_rows_null_ids_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "http://a.org/"), (1, "http://a.org/"), (None, "http://a.com/de/")], SCHEMA)
    rows = url_filter.judge(pages, queries.URL_RULES).collect()
    assert sorted((r.page_id or 0, r.verdict) for r in rows) == [(0, "block"), (1, "allow"), (1, "allow")]
    assert url_filter.judge(pages.limit(0), queries.URL_RULES).count() == 0


def test_one_place_and_null_urls_in_two_thirds_of_all_rows_and_a_very_long_url(spark):
    urls = ["http://example.org/es/x"] * 300 + [None] * 300 + [f"http://h{i}.com/fr/{i}" for i in range(298)]
    urls += ["http://example.org/es/" + "a/" * 50000, "http://" + "a." * 5000 + "org/es/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rows = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, queries.URL_RULES).collect()}
    assert len(rows) == len(urls)
    assert {rows[i] for i in range(300)} == {("example.org/es/", "block")}
    assert {rows[i] for i in range(300, 600)} == {(None, "allow")}
    assert {rows[i] for i in range(600, 898)} == {("com/fr/", "allow")}
    assert rows[898] == ("example.org/es/", "block") and rows[899] == ("org/", "allow")
