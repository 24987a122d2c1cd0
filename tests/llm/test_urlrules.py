import random

from chainage.llm import urlrules as U

PAGES = "page_id long, url string, html string, host string, rule string, prefix string"


def plain(url, rules, default="allow"):
    at = (url or "").find("://")
    rest = (url or "")[at + 3 :] if at >= 0 else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(t, -len(h + p), -len(h), v != "block", h + p, v) for h, p, v, t in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, default
    tier, *_, rule, verdict = min(fits)
    return host, path, rule if tier == 0 else None, verdict


def run(spark, urls, **how):
    df = spark.createDataFrame([(i, u, "h", "x", "y", "z") for i, u in enumerate(urls)], PAGES)
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(df, **how).collect()}


FIXED = [
    None, "", "no scheme", "://", "http://", "HTTP://Sub.EXAMPLE.org/en/1?x", "http://example.org/en/12", "http://example.org/en/2", "http://example.org", "http://example.org?/es/",
    "http://notexample.org/es/x", "x://a.b.com/fr/", "x://com/fr/", "x://com./fr/", "a://b://c.com/de/x#y", "http://KELVİN.com/de/", "http://www.cheap-pills.example.com/fr/1", "http://www.cheap-pills.example.com/en/1",
    "http://\nexample.org/es/\n", "http://a..org//", "http://é.org/é",
]


def test_rules_of_the_contract(spark):
    rng = random.Random(5)
    hosts = ["example.org", "www.example.org", "a.com", "com", "org", "EXAMPLE.org", "net", "x.cheap-pills.example.com", ""]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/19/x", "/fr/1", "/de/1", "/DE/1"]
    urls = FIXED + [f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/es/', '#x'])}" for _ in range(200)]
    got = run(spark, urls)
    for i, u in enumerate(urls):
        assert got[i] == plain(u, U.RULES), u


def test_many_rules_in_slices(spark):
    rng = random.Random(6)
    names = ["a", "b", "c", "d", "ex", "org"]
    host = lambda: ".".join(rng.choice(names) for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "/".join(rng.choice(names) for _ in range(rng.randint(0, 3)))
    rules = list({(host(), rng.choice([path(), ""]), rng.choice(["allow", "block"]), rng.choice([0, 0, 1])) for _ in range(400)})
    urls = [f"http://{host()}{path()}/x" for _ in range(400)]
    table = spark.createDataFrame(rules + rules[:50], "host string, path string, verdict string, tier int")
    got, sliced = run(spark, urls, rules=table), run(spark, urls, rules=table, rows_of_slice=90)
    assert got == sliced
    for i, u in enumerate(urls):
        assert got[i] == plain(u, rules), u


def test_defined_edges(spark):
    rows = [(None, "http://a.org/", "", "", "", ""), (1, "http://a.org/", "", "", "", ""), (1, "http://a.org/", "", "", "", ""), (2, "http://" + "a." * 50_000 + "org/" + "p" * 100_000, "", "", "", ""), (None, None, "", "", "", "")]
    got = U.judge(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted((r.page_id or 0, r.verdict, r.rule or "") for r in got) == [(0, "allow", ""), (0, "allow", "org/"), (1, "allow", "org/"), (1, "allow", "org/"), (2, "allow", "org/")]
    assert U.judge(spark.createDataFrame([], PAGES)).count() == 0
    none = spark.createDataFrame([(None, "/", "block"), ("org", "x", "block"), ("org", "/", "maybe")], "host string, path string, verdict string")
    assert {r.verdict for r in U.judge(spark.createDataFrame(rows, PAGES), none, default="block").collect()} == {"block"}
    both = spark.createDataFrame([("ORG", "/", "allow"), ("org", "/", "block"), ("org", None, "allow")], "host string, path string, verdict string")
    assert run(spark, ["http://x.org/"], rules=both)[0][2:] == ("org/", "block")


def test_one_shuffle_and_no_python(spark):
    plan = U.judge(spark.createDataFrame([(1, "x", "", "", "", "")], PAGES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("Exchange hashpartitioning") <= 2 and "CartesianProduct" not in physical and "NestedLoop" not in physical
