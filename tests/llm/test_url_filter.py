from ledgerlake.llm import url_filter as u


def pages(spark, urls):
    return spark.createDataFrame([(k, x, "h") for k, x in enumerate(urls)], "page_id long, url string, verdict string")


def outcomes(spark, rows):
    return spark.createDataFrame(rows, "page_id long, good boolean")


def test_rules(spark):
    urls = ["http://EXAMPLE.com/en/x", "https://www.example.com/en/y?q#f", "x://a.net/es/", "http://a.net/de/", "http://com", "http://notcom/", None, "no scheme", "http://wwww.example.com/en/"]
    found = {r.page_id: r for r in u.judge(pages(spark, urls), outcomes(spark, [])).collect()}
    assert [(found[k].host, found[k].path, found[k].rule) for k in range(9)] == [("example.com", "/en/x", "example.com/en/"), ("www.example.com", "/en/y", "www.example.com/en/"), ("a.net", "/es/", "net/es/"), ("a.net", "/de/", None), ("com", "", None), ("notcom", "/", None), ("", "", None), ("", "", None), ("wwww.example.com", "/en/", "example.com/en/")]
    assert [found[k].verdict for k in (0, 1, 2)] == ["block", "allow", "block"] and all(found[k].verdict in ("allow", "block") for k in found)


def test_reputation_shrinks_to_domain(spark):
    urls = [f"http://bad.one.org/{k}" for k in range(40)] + [f"http://good.two.org/{k}" for k in range(40)] + ["http://new.one.org/", "http://new.two.org/"]
    labels = [(k, False) for k in range(40)] + [(40 + k, True) for k in range(40)] + [(3, None), (None, True)]
    found = {r.url: r.verdict for r in u.judge(pages(spark, urls), outcomes(spark, labels)).collect()}
    assert (found["http://bad.one.org/1"], found["http://good.two.org/1"], found["http://new.one.org/"], found["http://new.two.org/"]) == ("block", "allow", "block", "allow")


def test_empty(spark):
    assert u.judge(pages(spark, ["a"]).limit(0), outcomes(spark, [])).count() == 0


def test_clashing_names_and_odd_urls(spark):
    urls = ["http://A.example.co.nz/x", "http://b.other.co.nz/x", None, "no scheme", "http://" + "h" * 50000 + "/" + "p" * 50000, "http://A.example.co.nz/x"]
    pages = spark.createDataFrame([(k, u, "r", "v", 1.0, "h", "p") for k, u in enumerate(urls)], "page_id long, url string, rule string, verdict string, host_lower_bound double, host string, path string")
    outcomes = spark.createDataFrame([(0, True), (0, False), (1, None), (9, True)], "page_id long, good boolean")
    found = {r.page_id: r for r in u.judge(pages, outcomes).collect()}
    assert len(found) == 6 and found[0].host == "a.example.co.nz" == found[5].host and found[0].verdict == found[5].verdict and found[2].host == found[3].path == ""
    domains = {r.host: r.domain for r in u.parsed(pages).withColumns(u._levels(u.LONG_SUFFIX)).collect()}
    assert domains["a.example.co.nz"] == "example.co.nz" and domains["b.other.co.nz"] == "other.co.nz"
    assert u.judge(pages.limit(0), outcomes.limit(0)).count() == 0
