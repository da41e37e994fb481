from luminal.llm.urls import UrlRule, judge

RULES = [UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"), UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/")]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, path = rest[:cut], rest[cut:]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    path = path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.name)).name if fits else None


def test_rules_and_parts(spark):
    urls = [
        "http://A.Example.NET/en/1?x=1", "http://example.net/de/2", "http://net/x", "http://xnet/x", "http://b.net", "http://b.net?x", "http://c.example.com/de/5#top", "https://d.org/fr/", "https://É.org/fr/a/b/c/d/e/f",
        "no url", "", None, "a://b://c.net/d", "http://h.com:80/De/1", "http://x.net/\nline",
    ] * 2
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id int, url string, rule string")
    got = sorted(judge(df, RULES).collect(), key=lambda r: r.page_id)
    assert len(got) == len(urls)
    for r, u in zip(got, urls, strict=True):
        assert (r.host, r.path, r.rule) == brute(u)
        if r.rule:
            assert r.verdict == next(x.verdict for x in RULES if x.name == r.rule)
        else:
            assert r.verdict == "allow"
    assert judge(df.limit(0), RULES).count() == 0


def test_templates(spark):
    rules = [UrlRule("block", "a.com", f"/spam/{i}") for i in range(10, 60)] + [UrlRule("allow", "a.com", f"/news/{i}") for i in range(10, 60)]
    urls = [f"http://a.com/spam/{i}" for i in range(10, 60)] + [f"http://a.com/news/{i}/x" for i in range(10, 60)] + ["http://a.com/spam/7", "http://a.com/news/7/x", "http://a.com/", "http://b.com/spam/7"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = {r.page_id: r for r in judge(df, rules).collect()}
    assert (got[100].rule, got[100].template, got[100].verdict) == (None, "a.com/spam/*", "block")
    assert got[101].verdict == got[102].verdict == got[103].verdict == "allow"


def test_deep_paths_are_told_apart(spark):
    for deep in ("/a/b/c/d", "/a/b/c/d/e/f/g/h"):  # 6 and 10 segments with what follows
        rules = [UrlRule("block", "a.com", f"{deep}/spam/{i}") for i in range(10, 60)] + [UrlRule("allow", "a.com", f"{deep}/news/{i}") for i in range(10, 60)]
        urls = [f"http://a.com{deep}/{kind}/{i}" for kind in ("spam", "news") for i in [*range(10, 60), 7]] + ["http://a.com/a", "http://a.com/"]
        got = {r.path: r for r in judge(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), rules).collect()}
        assert len(got) == len(urls)
        assert got[f"{deep}/spam/7"].template.endswith("/spam/*") and got[f"{deep}/spam/7"].verdict == "block"
        assert got[f"{deep}/news/7"].template.endswith("/news/*") and got[f"{deep}/news/7"].verdict == "allow"


def test_many_rules_and_odd_rows(spark):
    rules = [UrlRule("block", f"h{i}.com", f"/p{i % 7}/") for i in range(3000)] + [UrlRule("allow", "h5.com", "/p5/ok"), UrlRule("allow", "com", "/p5/")]
    urls = ["http://h5.com/p5/x", "http://h5.com/p5/ok/1", "http://a.b.h12.com/p5/", "http://a.b.h12.com/p1/", "http://x.com/p5/1", "http://" + "a." * 50_000 + "h5.com/p5/" + "y/" * 3, "http://h5.com/p5/x", "http://h5.com/" + "z" * 300_000]
    df = spark.createDataFrame([(0, u, 1) for u in urls], "page_id int, url string, purity int")
    got = judge(df, rules).collect()
    assert len(got) == len(urls)
    said = {(r.host, r.path): r.rule for r in got}
    assert said["h5.com", "/p5/x"] == "h5.com/p5/" and said["h5.com", "/p5/ok/1"] == "h5.com/p5/ok" and said["a.b.h12.com", "/p5/"] == "h12.com/p5/"
    assert said["a.b.h12.com", "/p1/"] is None and said["x.com", "/p5/1"] == "com/p5/" and said["a." * 50_000 + "h5.com", "/p5/" + "y/" * 3] == "h5.com/p5/"
    assert judge(df, []).filter("rule is not null").count() == 0


def test_very_deep_paths_take_few_rounds(spark, monkeypatch):
    from luminal.llm import urls as module

    rounds = []
    real = module.cut
    monkeypatch.setattr(module, "cut", lambda df, label: rounds.append(label) or real(df, label))
    trap = "/".join(["loop", "", "x7", "**"] * 500)
    rows = [f"http://trap.org/{trap}", f"http://trap.org/{trap}/more", f"http://trap.org/{trap}", f"http://b.trap.org/{trap}"] + [f"http://shop.org/{a}/{b}/" for a in ("p", "q") for b in range(30)] + ["http://shop.org", "http://shop.org/", "http://shop.org//"]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id int, url string")
    got = {r.page_id: r.template for r in judge(df, RULES).collect()}
    deep = "/" + "/".join(["loop", "", "*", "*"] * 500)
    assert got[0] == got[2] == "trap.org" + deep and got[1] == "trap.org" + deep + "/*" and got[3] == "b.trap.org" + deep
    assert sum(x.startswith("url-branch") for x in rounds) <= 4
