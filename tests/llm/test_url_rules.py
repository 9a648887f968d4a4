import random

from docflow.llm.url_rules import judge, sweep

RULE_SCHEMA = "host string, path string, verdict string"


def plain(url, rules, default="allow"):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        n = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:]
        path = rest[: min((rest.index(c) for c in "?#" if c in rest), default=len(rest))]
    fits = [(len(h) + len(p), len(h), h, p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2] + best[3], best[4] if best else default


def test_random_rules_equal_brute_force(spark):
    rng = random.Random(6)
    label = lambda: rng.choice(["a", "b", "ab", "c-d", "\x01", "é", "", "z"])
    host = lambda n: ".".join(label() for _ in range(n))
    path = lambda: "/" * rng.randint(0, 1) + "".join(rng.choice("ab/\U0010ffff") for _ in range(rng.randint(0, 4)))
    rules = {(host(rng.randint(1, 3)), path()): rng.choice(["allow", "block"]) for _ in range(150)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice([host(rng.randint(1, 4)), host(2).upper()])}{path()}{rng.choice(['', '?q=/a', '#x?y', '?'])}" for _ in range(900)]
    urls += [None, "", "no scheme", "://", "http://", "x://y://z/a", "http://A.b\n/ab", urls[0], urls[0]]
    df = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id bigint, url string, rule_host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(df, spark.createDataFrame(rules, RULE_SCHEMA)).collect()}
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        assert got[k] == plain(u, rules), u


def test_odd_rules_and_empty_tables(spark):
    rules = spark.createDataFrame([("a", "/", "allow"), ("A", "/", "block"), (None, "/", "block"), ("b", None, "block"), ("b", "", None)], RULE_SCHEMA)
    df = spark.createDataFrame([(1, "http://x.a/q"), (1, "http://x.a/q"), (None, "http://b/"), (3, None)], "page_id bigint, url string")
    got = sorted(map(str, (tuple(r) for r in judge(df, rules, default="?").collect())))
    assert got == sorted(map(str, [(1, "x.a", "/q", "a/", "block")] * 2 + [(None, "b", "/", None, "?"), (3, "", "", None, "?")]))
    assert judge(df.limit(0), rules).collect() == [] and len(judge(df, rules.limit(0)).collect()) == 4


def test_sweep_carries_over_partitions(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        events = spark.createDataFrame([("m", 1, ["x"]), ("t", 0, [])], "key string, kind int, state array<string>")
        keys = spark.createDataFrame([(chr(97 + k % 26) + str(k),) for k in range(400)], "key string")
        got = {r.key: r.state for r in sweep(events, keys).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert all(state == (["x"] if "m" <= key < "t" else []) for key, state in got.items()) and len(got) == 400
