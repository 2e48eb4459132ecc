from tidemark.llm import urlfilter

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"), ("com/de/", "allow"), (None, "block")]


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    best = None
    for rule, verdict in rules:
        if rule is None:
            continue
        h, _, p = rule.partition("/")
        p = "/" + p
        if host and (host == h or host.endswith("." + h)) and path.startswith(p):
            key = (len(h + p), len(h), h + p, verdict)
            best = max(best or key, key)
    return host, path, best and best[2], best[3] if best else "allow"


def test_against_brute_force(spark):
    hosts = ["example.org", "a.EXAMPLE.org", "x.com", "com", "org", "notorg", "b.c.d.example.org", "é.com"]
    paths = ["", "/", "/es/1", "/es", "/en/12", "/en/2", "/fr/", "/de/x?y=/fr/", "/de/#a", "?q=/es/", "#/es/"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no-scheme/de/", "http://", "x://y://z.com/de/"] + ["http://x.com/de/"] * 40 + ["http://x.com/de/" + "a" * 100_000]
    rows = [(i, u, "x", "y") for i, u in enumerate(urls)] + [(None, "http://x.com/fr/", "x", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string").repartition(3)
    out = urlfilter.judge(df, spark.createDataFrame(RULES, "rule string, verdict string")).collect()
    assert sorted(((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in out), key=str) == sorted(((i, u, *brute(u, RULES)) for i, u, *_ in rows), key=str)


def test_many_rules_pass_the_filter_exactly(spark):
    rules = [(f"h{i}.net/p{i % 7}/", "block") for i in range(3000)]
    rows = [(i, f"https://s.h{i}.net/p{i % 5}/q") for i in range(4000)]
    out = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(rules, "rule string, verdict string")).collect()
    assert {r.page_id for r in out if r.verdict == "block"} == {i for i in range(3000) if i % 7 == i % 5}


def test_no_rules_and_no_pages(spark):
    none = spark.createDataFrame([], "rule string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert [r.verdict for r in urlfilter.judge(pages, none, "block").collect()] == ["block"]
    assert urlfilter.judge(pages.limit(0), spark.createDataFrame(RULES, "rule string, verdict string")).collect() == []
