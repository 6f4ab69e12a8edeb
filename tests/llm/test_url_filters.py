from gradecube.llm import url_filters as U

PAGES = "page_id long, url string, host string"
LABELS = "doc_id long, quality int, toxic int"


def test_parts_and_rules(spark):
    urls = {
        "http://a.net/x": ("a.net", "/x", "net/", "block"),
        "http://net/x": ("net", "/x", "net/", "block"),
        "http://anet/x": ("anet", "/x", None, "allow"),
        "https://M.Example.NET/en/1?q=/a#b": ("m.example.net", "/en/1", "example.net/en/", "allow"),
        "https://example.net/en": ("example.net", "/en", "net/", "block"),
        "https://notexample.net/en/1": ("notexample.net", "/en/1", "net/", "block"),
        "ftp://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
        "http://x.org/fr/1#top": ("x.org", "/fr/1", "org/fr/", "allow"),
        "http://x.org?u=http://y.net/": ("x.org", "", None, "allow"),
        "http://É.net": ("É.net", "", None, "allow"),
        "//x.net/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http:///p": ("", "/p", None, "allow"),
    }
    rows = [(k, u, "clash") for k, u in enumerate(urls)] + [(0, "http://a.net/x", "again"), (None, None, None)]
    out = U.url_filter(spark.createDataFrame(rows, PAGES), spark.createDataFrame([], LABELS)).collect()
    assert len(out) == len(rows)
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}
    assert [by[k] for k in range(len(urls))] == list(urls.values())


def test_reputation(spark):
    pages, labels, k = [], [], 0
    for host, n, bad in (("bad.com", 60, 57), ("good.com", 60, 3), ("few.com", 1, 1), ("new.com", 0, 0), ("a.worse.org", 40, 40), ("b.worse.org", 0, 0)):
        for j in range(n + 2):
            pages.append((k, f"http://{host}/{j}", ""))
            if j < n:
                labels.append((k, 0 if j < bad else 1, 0))
            k += 1
    labels += [(None, 0, 1), (0, None, None), (10**6, 0, 0)]
    out = U.url_filter(spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, LABELS)).collect()
    verdict = {}
    bound = {}
    for r in out:
        verdict.setdefault(r.host, set()).add(r.verdict)
        bound[r.host] = r.bound
    assert verdict["bad.com"] == {"block"} == verdict["a.worse.org"] and verdict["good.com"] == {"allow"} == verdict["new.com"] == verdict["few.com"]
    assert bound["few.com"] < bound["bad.com"] and bound["b.worse.org"] > bound["new.com"]  # shrunk towards the registered domain
    assert U.url_filter(spark.createDataFrame([], PAGES), spark.createDataFrame([], LABELS)).count() == 0


def test_registered_domains(spark):
    hosts = {"a.b.example.co.uk": ("co.uk", "example.co.uk"), "example.com": ("com", "example.com"), "com": ("com", "com"), "u:p@h.example.org:8080": ("org", "example.org"), "10.0.0.1": ("", "10.0.0.1"), "": ("", "")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    sql = U.parts_sql()
    for name in ("site", "suffix", "domain"):
        df = df.selectExpr("*", f"{sql[name]} AS {name}")
    assert {r.host: (r.suffix, r.domain) for r in df.collect()} == hosts


def test_line_breaks_and_few_exchanges(spark, monkeypatch):
    import duckdb

    rows = [(1, "x\ny://a.net/x"), (2, "http://b\n.org/fr/x\ny?z"), (3, "a\rb://C.example.com/de/\n"), (4, None), (5, "none"), (6, "u://"), (6, "u://")]
    rows += [(k, f"http://h{k % 7}.example.org/p{k}") for k in range(10, 80)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(10, 40)], "doc_id long, quality int, toxic int")
    want = None
    for share in (U.HOT_SHARE, 0.05, 1.0):
        monkeypatch.setattr(U, "HOT_SHARE", share)
        out = U.url_filter(pages, labels)
        got = sorted(map(str, out.collect()))
        assert want is None or got == want
        want = got
    by = {r.page_id: r for r in out.collect()}
    assert (by[1].host, by[1].path, by[1].rule, by[1].verdict) == ("a.net", "/x", "net/", "block")
    assert by[3].host == "c.example.com" and by[3].rule == "example.com/de/"
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") < 40
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    con.register("labels", labels.toPandas())
    twin = con.sql(U.ORACLE).fetchall()
    assert sorted((a, b, c, d, e, round(f, 6)) for a, b, c, d, e, f in twin if d) == sorted(tuple(r) for r in out.collect() if r.rule)
    assert sorted((a, b, c, e, round(f, 6)) for a, b, c, d, e, f in twin) == sorted((r.page_id, r.host, r.path, r.verdict, r.bound) for r in out.collect())
