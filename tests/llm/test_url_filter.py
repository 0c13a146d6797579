import re

import pytest

from assaykit.llm.url_filter import bloom_filter, filter_urls

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "", "block")]


def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, "allow")))


def test_matches_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "http://COM/en/1", "http://a.com/en/", "https://x.example.com/en/712?q#f", "http://example.com/en/6", "http://notexample.net/de/8", "http://b.example.net/de/88", "http://é.org", "http://org?x", "ftp://a..net/de/", "http://a.com/en/://b.net/de/", "http://" + "s." * 200 + "example.com/en/7" + "p" * 5000]
    rows = [(i % 12, u, "clash") for i, u in enumerate(urls * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    for limit, most in ((0, 0), (0, 1 << 20), (1000, 0), (1000, 1 << 20)):
        got = filter_urls(pages, rules, broadcast_rows=limit, filter_bytes=most)
        assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
        assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame([(p, u, *judge(u)) for p, u, _ in rows], got.schema).collect()))


def test_many_rules_pass_the_filter(spark):
    rules = spark.createDataFrame([(f"h{i}.test", f"/p{i}/", "block") for i in range(3000)], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, f"http://www.h{i}.test/p{i}/x" if i % 2 else f"http://h{i}.test/q{i}/") for i in range(400)], "page_id long, url string")
    got = filter_urls(pages, rules)
    assert got.where("verdict = 'block'").count() == 200 == got.where("page_id % 2 = 1 AND rule IS NOT NULL").count()


def test_a_list_of_100_000_labels_fills_several_rows_of_the_filter(spark):
    rules = spark.range(100_000).selectExpr("concat('h', id, '.test') AS host", "concat('/p', id, '/') AS path", "'block' AS verdict")
    pages = spark.createDataFrame([(i, f"http://www.h{i * 331}.test/p{i * 331}/x" if i % 2 else f"http://h{i * 331}.test/q/") for i in range(300)], "page_id long, url string")
    got = filter_urls(pages, rules)
    assert got.where("verdict = 'block'").count() == 150 == got.where("page_id % 2 = 1 AND rule IS NOT NULL").count()
    words = bloom_filter(spark.range(3000).selectExpr("concat('k', id) AS key"), 1100).collect()
    assert len(words) == 3 and all(len(r["words"]) == 512 * 8 for r in words)


def test_a_host_of_many_labels_is_cut_at_the_lists(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://" + "a." * 200_000 + "example.com/en/7"), (2, "http://" + "." * 100_000 + "com/en/")], "page_id long, url string")
    assert [r["rule"] for r in filter_urls(pages, rules).orderBy("page_id").collect()] == ["example.com/en/7", "com/en/"]


@pytest.mark.parametrize("name", ["best", "best_h", "h", "p", "host_of_url", "pack", "words", "key", "rule", "Verdict", "suffix", "n", "a.b"])
def test_clashing_names(spark, name):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/en/", 10)], f"page_id long, url string, `{name}` long")
    got = filter_urls(pages, rules).collect()
    assert [(r["host"], r["rule"], r["verdict"]) for r in got] == [("a.com", "com/en/", "block")]
    assert name.lower() in ("rule", "verdict") or got[0][name] == 10


def test_empty_tables(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/en/")], "page_id long, url string")
    assert filter_urls(pages.limit(0), rules).count() == 0
    assert [r["verdict"] for r in filter_urls(pages, rules.limit(0), default="block").collect()] == ["block"]


def test_python_stays_out_of_the_plan(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.range(5).selectExpr("id AS page_id", "concat('http://a.com/en/', id) AS url")
    assert "Python" not in filter_urls(pages, rules)._jdf.queryExecution().executedPlan().toString()
