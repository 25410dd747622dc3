import random

from siftline.llm import url_filter as uf


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        if rest[cut : cut + 1] == "/":
            path = rest[cut:].split("?")[0].split("#")[0]
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


RULES = [*uf.RULES, ("block", "a.b.example.org", ""), ("allow", "example.org", "/x"), ("block", "org", "/x/y/z?"), ("block", "xn--é.net", "/")]


def urls():
    rng = random.Random(0)
    out = [None, "", "nothing", "://", "http://", "http:///en/", "HTTP://WWW.Example.COM/en/1", "http://example.com", "http://example.com?x", "http://example.com#/en/", "http://badexample.com/en/", "x://a.b.example.org", "http://.net/es/", "http://example.com:80/en/", "http://xn--é.net/a b", "http://a..com/", "http://com/", "a://b://c.com/en/"]
    for _ in range(300):
        host = ".".join(rng.choices(["a", "b", "www", "example", "com", "net", "org", ""], k=rng.randint(1, 5)))
        out.append(f"http://{host}{rng.choice(['', '/', '/en/', '/en', '/es/1', '/fr/x/y', '/x/y/z', '/x?y', '/EN/'])}{rng.choice(['', '?q=/en/', '#f'])}")
    return out + out[:40]


def test_matches_brute_force(spark):
    rows = list(enumerate(urls()))
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' AS host", "1 AS rule", "2 AS prefix")
    for bound in (1000, 0):  # rules broadcast, and shuffled
        got = uf.filter_urls(df, uf.rules_table(spark, RULES), broadcast_rules=bound).collect()
        assert {r.row.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: brute(u, RULES) for i, u in rows}
        assert len(got) == len(rows)


def test_many_path_lengths(spark, monkeypatch):
    monkeypatch.setattr(uf, "MAX_LENGTHS", 2)
    rows = list(enumerate(urls()))
    got = uf.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), uf.rules_table(spark, RULES)).collect()
    assert {r.row.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: brute(u, RULES) for i, u in rows}


def test_empty_tables_and_odd_rules(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert uf.filter_urls(none, uf.rules_table(spark, RULES)).count() == 0
    one = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert uf.filter_urls(one, uf.rules_table(spark, [])).first().verdict == "allow"
    odd = [("allow", "a.com", "/"), ("block", "A.com", "/"), ("block", None, "/"), (None, "com", None)]
    r = uf.filter_urls(one, uf.rules_table(spark, odd)).first()
    assert (r.rule, r.verdict) == ("a.com/", "block")
