from pyspark.sql import functions as F

from panelspark.llm import urlfilter as u

URLS = ["http://a.NET/x", "https://example.net/en/1", "https://www.EXAMPLE.com/de/", "https://www.example.com/de", "ftp://x.org/fr/9?q#f", "http://org/fr/", "http://xorg/fr/", "http://net", "http://net?x/", "http://net/", "no scheme", "", None, "a://b://c.net/d", "http://x.com/wp-login.php", "http://x.com/xmlrpc.php", "http://x.com/Xmlrpc.php", "http://best.casino.com/", "http://x.com/casinos/", "http://ads-track.x.de/", "http://ÄB.net/é", "http://h\nx.net/a\nb"]


def brute(url):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    best = None
    for action, h, p in (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")):
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (action, h + p)
    return host, path, best


def test_rules(spark):
    df = spark.createDataFrame(list(enumerate(URLS)) + [(3, URLS[3]), (None, URLS[0])], "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("token", F.lit(1)).withColumn("rule", F.lit(0))
    rows = u.judge_urls(df).collect()
    assert len(rows) == len(URLS) + 2
    method = {14: "block", 15: "block", 16: "allow", 17: "block", 18: "allow", 19: "block"}
    for r in rows:
        if r.page_id is None:
            continue
        host, path, best = brute(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[1]), URLS[r.page_id]
        assert r.verdict == (best[0] if best else method.get(r.page_id, "allow")), URLS[r.page_id]
    assert u.judge_urls(df.limit(0)).count() == 0
    assert {r.verdict for r in u.judge_urls(df, rules=()).collect()} == {"allow"}


def test_rules_without_tokens_and_partial_paths(spark):
    df = spark.createDataFrame([(1, "http://a.com/english"), (2, "http://b.com/x"), (3, "http://a.com/en")], "page_id long, url string")
    rules = (u.host_rule("block", "a.com", "/en"), u.pattern_rule("any", "block", "b[.]"))
    assert [r.verdict for r in u.judge_urls(df, rules=rules).orderBy("page_id").collect()] == ["block", "block", "block"]


def test_query_equals_sql(spark, data, duck):
    from panelspark.llm.queries import ORACLES, QUERIES

    got = QUERIES["op7_url_filter"](spark, data)
    cols = sorted(got.columns)
    r = duck.execute(ORACLES["op7_url_filter"])
    at = {d[0]: i for i, d in enumerate(r.description)}
    assert sorted((tuple(x[c] for c in cols) for x in got.collect()), key=repr) == sorted((tuple(x[at[c]] for c in cols) for x in r.fetchall()), key=repr)


def test_no_python_on_the_main_path(spark, data):
    from panelspark.llm.queries import QUERIES

    plan = QUERIES["op7_url_filter"](spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
