import random

from webtraj.llm import urls


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h) + len(p), len(h), a, h, p) for a, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3] + best[4], best[2] if best else default


def test_urls_against_brute_force(spark):
    rng = random.Random(1)
    labels, paths = ["net", "example", "com", "org", "a", "b", "EN", "é"], ["", "/", "/en/", "/en", "/de/x", "/en/a/b", "/é𝒳", "/\U0010ffffz"]
    hosts = [".".join(rng.choice(labels) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    rules = [(rng.choice(["allow", "block"]), rng.choice(hosts).lower(), rng.choice(paths)) for _ in range(60)] + list(urls.RULES)
    rules = list({(h, p): (a, h, p) for a, h, p in sorted(rules)}.values())
    pages = ["http://" + rng.choice(hosts) + rng.choice(paths) + rng.choice(["", "q", "/en/", "?x=1", "#t", "?/en/"]) for _ in range(1500)]
    pages += [None, "", "://", "no scheme/en/", "http://", "http:///en/", "https://A.NET/", "x://y://z/", "http://net./", "http://.net/", "http://" + "a." * 3000 + "net/", "http://net/" * 2]
    df = spark.createDataFrame([(i, u, "kept", "kept") for i, u in enumerate(pages)], "page_id int, url string, host string, other string")
    got = {r["page_id"]: r for r in urls.judge_urls(df, urls.rule_table(spark, rules)).collect()}
    assert len(got) == len(pages)
    for i, u in enumerate(pages):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == brute(u, rules), u
        assert got[i]["other"] == "kept"


def test_empty_tables_conflicts_and_repeats(spark):
    df = spark.createDataFrame([("http://a.net/x",), ("http://a.net/x",)], "url string")
    none = spark.createDataFrame([], urls.RULE_SCHEMA)
    assert [r["verdict"] for r in urls.judge_urls(df, none).collect()] == ["allow", "allow"]
    assert urls.judge_urls(df.limit(0), urls.rule_table(spark)).count() == 0
    both = spark.createDataFrame([("allow", "NET", "/"), ("block", "net", "/"), (None, "net", "/x"), ("block", None, "/"), ("block", "", "/"), ("allow", "net", None)], urls.RULE_SCHEMA)
    assert [(r["rule"], r["verdict"]) for r in urls.judge_urls(df, both).collect()] == [("net/", "block")] * 2
