from mvspark.llm import url_filter

SCHEMA = "page_id long, url string, _host string, rule string, token string, best string"


def verdicts(spark, urls, **more):
    pages = spark.createDataFrame([(k, u, "h", "r", "t", "b") for k, u in enumerate(urls)], SCHEMA)
    rows = url_filter.filter_urls(pages, url_filter.rule_frame(spark), **more).orderBy("page_id").collect()
    assert [r["rule"] for r in rows] == ["r"] * len(urls)
    return [(r["_host"], r["_path"], r["_rule"], r["_verdict"]) for r in rows]


CASES = [
    ("http://a.example.net/en/1?x", ("a.example.net", "/en/1", "example.net/en/", "allow")),
    ("http://example.NET/fr/1", ("example.net", "/fr/1", "net/", "block")),
    ("http://example.net", ("example.net", "", None, "allow")),
    ("http://notexample.com/de/", ("notexample.com", "/de/", None, "allow")),
    ("https://m.example.com/de/a#t", ("m.example.com", "/de/a", "example.com/de/", "block")),
    ("https://m.example.com/DE/a", ("m.example.com", "/DE/a", None, "allow")),
    ("ftp://x.org/fr/", ("x.org", "/fr/", "org/fr/", "allow")),
    ("x.org/fr/", ("", "", None, "allow")),
    (None, ("", "", None, "allow")),
    ("", ("", "", None, "allow")),
    ("http://best.com/Online-Casino/", ("best.com", "/Online-Casino/", None, "block")),
    ("http://best.com/online-casinos/", ("best.com", "/online-casinos/", None, "allow")),
    ("http://a.org/fr/free-porn/", ("a.org", "/fr/free-porn/", "org/fr/", "allow")),
    ("a?u=http://é.net/" + "y" * 50_000, ("é.net", "/" + "y" * 50_000, "net/", "block")),
    ("http://a.example.net/en/1?x", ("a.example.net", "/en/1", "example.net/en/", "allow")),
]


def test_verdicts(spark):
    assert verdicts(spark, [u for u, _ in CASES]) == [v for _, v in CASES]


def test_shuffled_index_gives_the_same(spark):
    assert verdicts(spark, [u for u, _ in CASES], broadcast_rules=0) == [v for _, v in CASES]


def test_a_rule_is_filed_under_its_rarest_token(spark):
    pages = spark.createDataFrame([(1, "http://example.com/x"), (2, "http://example.com/y"), (3, "http://z.com/de/")], "page_id long, url string")
    out = url_filter.filter_urls(pages, url_filter.rule_frame(spark)).where("_verdict = 'block'")
    assert out.count() == 0


def test_empty_table_and_rule_without_tokens(spark):
    assert verdicts(spark, []) == []
    rules = url_filter.rule_frame(spark, [], [("block", r"[^\x00-\x7F]", ())])
    pages = spark.createDataFrame([(1, "http://é.com/"), (2, "http://e.com/")], "page_id long, url string")
    got = {r["page_id"]: r["_verdict"] for r in url_filter.filter_urls(pages, rules).collect()}
    assert got == {1: "block", 2: "allow"}
