from pathweave.llm import queries, urls


def judged(df):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in df.collect()}


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")


def test_hosts_paths_and_rules(spark):
    rows = ["https://WWW.Example.com/en/a?x=/en/", "http://a.example.com/en/b", "http://example.com/de/", "http://x.net/es/1", "http://net/fr/", "http://x.net/en/",
            "http://badexample.com/en/", "http://example.com", "http://example.com?x", "http://example.com#/en/", None, "no scheme", "a://b://c/d", "://", "http://É.COM/Ä", "http://x.net/es"]
    got = judged(urls.filter_urls(pages(spark, [(i, u, "clash", "clash") for i, u in enumerate(rows)])))
    assert [got[i][:3] for i in range(len(rows))] == [
        ("www.example.com", "/en/a", "www.example.com/en/"), ("a.example.com", "/en/b", "example.com/en/"), ("example.com", "/de/", "com/"),
        ("x.net", "/es/1", "net/es/"), ("net", "/fr/", "net/fr/"), ("x.net", "/en/", None), ("badexample.com", "/en/", "com/"), ("example.com", "", None),
        ("example.com", "", None), ("example.com", "", None), ("", "", None), ("", "", None), ("b:", "//c/d", None), ("", "", None), ("É.com", "/Ä", "com/"),
        ("x.net", "/es", None)]
    assert [got[i][3] for i in range(7)] == ["allow", "block", "allow", "block", "block", got[5][3], "allow"]


def test_reputation_passes_down_the_levels(spark):
    rows = [(f"http://bad{i % 30}.evil.net/es/{i}", 1) for i in range(600)] + [(f"http://good{i % 30}.com/x/{i}", 0) for i in range(600)]
    rows += [("http://bad3.evil.net/en/", 0), ("http://new.evil.net/en/", 0), ("http://fresh.org/", 0), ("http://good3.com", 0)]
    got = judged(urls.filter_urls(pages(spark, [(i, u, None, None) for i, (u, _) in enumerate(rows)])))
    assert [got[1200 + i][3] for i in range(4)] == ["block", "block", "allow", "allow"]


def test_empty_table_and_repeated_rows(spark):
    assert judged(urls.filter_urls(pages(spark, []))) == {}
    assert urls.filter_urls(pages(spark, [(1, "http://a.org/", None, None)] * 3)).count() == 3


def test_no_python_runs(spark, sf_dir):
    text = queries.op7_urls(spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(word in text for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))
