from scriptorium.llm import url_filter


def test_urls(spark):
    urls = [
        (1, "https://WWW.Example.com/en/7?x=1"), (2, "http://a.com/en/1"), (3, "https://example.net/de/8#t"), (4, "https://x.example.net/de/1"), (5, "http://b.org/es/"),
        (6, None), (7, "no scheme/en/"), (8, "ftp://bcom/en/"), (9, "https://free-casino.net/bet/slots/777?utm_source=pop"), (10, "http://c.com?/en/"), (11, "a://b://c.com/en/"), (12, "https://é.com/en/" + "x" * 20000), (4, "https://x.example.net/de/1"),
    ]
    df = spark.createDataFrame(urls, "page_id long, url string").selectExpr("*", "'clash' AS host", "1 AS rule")
    out = url_filter.filter_urls(df).collect()
    assert len(out) == len(urls)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out}
    assert got[1] == ("www.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[2] == ("a.com", "/en/1", "com/en/", "block") and got[3] == ("example.net", "/de/8", "example.net/de/8", "block")
    assert got[4] == ("x.example.net", "/de/1", "net/de/", "allow") and got[5] == ("b.org", "/es/", "org/es/", "block")
    assert got[6][:3] == got[7][:3] == ("", "", None)
    assert got[8][:3] == ("bcom", "/en/", None) and got[9][3] == "block" and got[10][:2] == ("c.com", "")
    assert got[11][:2] == ("b:", "//c.com/en/") and got[12][2] == "com/en/"
    p = url_filter.Params()
    assert all(got[i][:2] == url_filter.split_url(u) for i, u in urls)
    assert url_filter.filter_urls(df.limit(0)).count() == 0
    w, b = url_filter.fit(p)
    assert sum(abs(x) > 0 for x in w) > 100
