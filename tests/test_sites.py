import json
import random
from urllib.robotparser import RobotFileParser

from pyspark.sql import functions as F

from pagequarry.operators import joins, registry as sites, robots, tasks
from pagequarry.schemas import REGISTRY
from pagequarry.sources.registry import site_registry

AGENT = "QuarryBot/1.0 (+https://quarry.example/)"


def _registry(spark, rows):
    """(order, base_url, more)"""
    made = [
        {"site_order": order, "base_url": base, "name": base, "user_agent": "site agent", **more}
        for order, base, more in rows
    ]
    return spark.createDataFrame(made, REGISTRY)


def test_built_in_registry(spark):
    row = site_registry(spark).first()
    assert row["base_url"] == "https://novelfull.com/"
    seeds = tasks.seeds(site_registry(spark)).orderBy("page").collect()
    assert len(seeds) == 100
    assert seeds[1]["url"] == "https://novelfull.com/most-popular?page=2"
    assert (seeds[0]["priority"], seeds[0]["headers"]["User-Agent"]) == (1, row["user_agent"])


def test_allow_pattern(spark):
    df = spark.createDataFrame([("/a.html", [r"/[^/]+\.html$"]), ("/a/b.html", [r"/[^/]+\.html$"])], "p STRING, a ARRAY<STRING>")
    assert [r[0] for r in df.select(sites.path_allowed(F.col("p"), F.col("a"))).collect()] == [True, False]
    many = [rf"/{i}/x" for i in range(200)]
    df = spark.createDataFrame([("/150/x", many), ("/150/xy", many), ("/a", [None, "/a"]), ("/a", None)], "p STRING, a ARRAY<STRING>")
    assert [r[0] for r in df.select(sites.path_allowed(F.col("p"), F.col("a"))).collect()] == [True, False, True, False]


def test_pattern_sets(spark):
    three = [r"/n/\d+", r"(?i)/x(a|b)", "/end"]
    grouped = [r"(a|b)\1", r"(?<n>c)d", "/end"]
    rows = [("/n/7", three), ("/XB", three), ("/N/7", three), ("/end", three), ("/endless", three),
            ("aa", grouped), ("ab", grouped), ("cd", grouped), ("/end", grouped), ("", []), ("", [None]), (None, three)]
    df = spark.createDataFrame(rows, "p STRING, a ARRAY<STRING>").coalesce(1)
    found = [r[0] for r in df.select(sites.path_allowed(F.col("p"), F.col("a"))).collect()]
    assert found == [True, True, False, True, False, True, False, True, True, False, False, False]


def test_many_sites_of_one_host(spark):
    """A hundred thousand base URLs on a host, and one that names only the host."""
    many = spark.range(100_000).select(
        (F.col("id") + 1).cast("int").alias("site_order"), F.concat(F.lit("https://h/s"), "id", F.lit("/")).alias("base_url")
    )
    registry = many.unionByName(spark.createDataFrame([(0, "https://h/s7"), (200_000, "https://h/")], many.schema))
    urls = ["https://h/s99999/x", "https://h/s12/", "https://h/s12", "https://h/s7777/x", "https://h/", "https://h", None]
    df = spark.createDataFrame([(u, {"k": "v"}) for u in urls + urls[:2]], "url STRING, headers MAP<STRING, STRING>")
    rows = sites.resolve_site(df, registry).collect()
    found = {r["url"]: r["config"] and r["config"]["base_url"] for r in rows}
    assert len(rows) == 9 and found == {
        "https://h/s99999/x": "https://h/s99999/", "https://h/s12/": "https://h/s12/", "https://h/s12": "https://h/",
        "https://h/s7777/x": "https://h/s7", "https://h/": "https://h/", "https://h": None, None: None,
    }
    none = sites.resolve_site(df, registry.limit(0)).collect()
    assert len(none) == 9 and all(r["config"] is None for r in none)


def test_first_matching_prefix(spark):
    registry = _registry(
        spark,
        [(3, "https://h/", {}), (2, "https://h/a/", {}), (4, "https://h/b/", {}), (1, "https://x", {}), (5, "https://xy/", {})],
    )
    urls = ["https://h/a/1", "https://h/b/1", "https://h/c", "https://xy/1", "https://z/", "h/a/"]
    df = spark.createDataFrame([(u,) for u in urls], "url STRING")
    found = {r["url"]: r["config"] and r["config"]["base_url"] for r in sites.resolve_site(df, registry).collect()}
    expected = ["https://h/a/", "https://h/", "https://h/", "https://x", None, None]
    assert found == dict(zip(urls, expected))


def test_one_way_rule(spark):
    config = F.struct(F.lit(True).alias("unidirection"), F.col("s").alias("unidirection_url_struct"))
    df = spark.createDataFrame([("", "x?page=1"), ("?page", "x?page=1")], "s STRING, link STRING")
    no = F.lit(False)
    assert [r[0] for r in df.select(sites.follows(no, F.col("link"), no, config)).collect()] == [False, True]
    assert df.select(sites.follows(F.lit(True), F.col("link"), F.lit(True), config)).first()[0] is False


def test_large_lookup_is_salted_and_whole(spark):
    facts = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 90)).alias("key"), "id"
    )
    lookup = spark.range(90).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("v"))
    lookup = lookup.where("id <> 5").unionByName(spark.createDataFrame([("hot", -1)], "key STRING, v LONG"))
    for how in ("left", "inner"):
        salted = joins.lookup_join(facts, lookup, "key", ["id"], how, max_rows=10, task_rows=190)
        plain = facts.join(lookup, "key", how)
        assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))
    semi = joins.salted_join(facts, lookup.select("key"), "key", ["id"], "left_semi", task_rows=190)
    assert semi.count() == facts.join(lookup, "key", "left_semi").count()
    assert joins.is_small(lookup) and not joins.is_small(lookup, max_rows=89) and not joins.is_small(lookup, max_bytes=99)


SUBMISSIONS = [
    ("https://h/1", "task", None, "https://h/1"),
    (json.dumps({"url": "https://h/2", "headers": {"User-Agent": "", "A": "b"}}), "task", None, "https://h/2"),
    ('"https://h/3"', "dropped", None, '"https://h/3"'),
    ('{"link": "https://h/4"}', "dropped", None, '{"link": "https://h/4"}'),
    ("[1]", "dropped", None, "[1]"),
    ('{"url": null}', "quarantined", "url is not text", None),
    ('{"url": 5}', "quarantined", "url is not text", "5"),
    ('{"url": "https://h/6", "extra": 1}', "quarantined", "unknown field", "https://h/6"),
    ('{"url": "https://other/", "extra": 1}', "dropped", None, "https://other/"),
    ("", "dropped", None, ""),
    ('{"url": "https://h/7", "priority": 4, "rate_limit": 0.5, "retry_count": 2}', "task", None, "https://h/7"),
]


def test_submissions(spark):
    registry = _registry(spark, [(1, "https://h/", {"rate_limit": 9.0})])
    raw = spark.createDataFrame([(i, s[0]) for i, s in enumerate(SUBMISSIONS)], "seq LONG, raw STRING")
    rows = tasks.decode_submissions(raw, registry).orderBy("seq").collect()
    assert [(r["outcome"], r["reason"], r["url"]) for r in rows] == [s[1:] for s in SUBMISSIONS]
    assert rows[1]["headers"] == {"A": "b", "User-Agent": "site agent"}
    assert (rows[0]["rate_limit"], rows[0]["priority"], rows[0]["max_retries"]) == (1.0, 1, 3)
    assert (rows[10]["rate_limit"], rows[10]["priority"], rows[10]["retry_count"]) == (0.5, 4, 2)


ROBOTS = [
    "User-agent: *\nDisallow: /a\nAllow: /a/b",
    "User-agent: *\nAllow: /a/b\nDisallow: /a",
    "User-agent: *\nDisallow: /\n\nUser-agent: quarry\nDisallow: /x",
    "User-agent: quarry\nUser-agent: other\nCrawl-delay: 3\nDisallow: /x\nDisallow:",
    "Disallow: /a\nUser-agent: *\n\nDisallow: /b",
    "user-AGENT :  QUARRYbot # us\nDISALLOW: /a%20b # no\r\nAllow: *",
    "User-agent: *\nUser-agent: quarry\nDisallow: /x\n\nUser-agent: *\nDisallow: /",
    "User-agent: a\nDisallow: /a\nUser-agent: *\nCrawl-delay: 1.5\nDisallow: /b?c=1",
    "User-agent: *\n \nDisallow: /a",
    "Sitemap: https://h/s\nUser-agent: *\nSitemap: x\nDisallow: /b\nRequest-rate: 1/5",
    "",
    "\n\n# only\n",
]


def test_robots_like_python(spark):
    paths = ["", "/", "/a", "/a/b", "/a/b/c", "/x", "/a b", "/a%20b", "/b", "/b?c=1", "/b?c=12", "/bc", "/z#f"]
    rng = random.Random(2)
    lines = [line for text in ROBOTS for line in text.split("\n")]
    texts = ROBOTS + ["\n".join(rng.choices(lines + [""] * 10, k=9)) for _ in range(60)]
    domains = [(f"https://h{i}", 200, text) for i, text in enumerate(texts)]
    rules = robots.agent_rules(spark.createDataFrame(domains, "domain STRING, http_status INT, robots_txt STRING"), AGENT)
    urls = [(d + p,) for d, _, _ in domains for p in paths]
    got = {r["url"]: (r["can_fetch"], r["crawl_delay"]) for r in robots.with_robots(spark.createDataFrame(urls, "url STRING"), rules).collect()}
    wrong = []
    for domain, _, text in domains:
        parser = RobotFileParser()
        parser.parse(text.splitlines())
        for path in paths:
            expected = (parser.can_fetch(AGENT, domain + path), parser.crawl_delay(AGENT))
            if got[domain + path] != expected:
                wrong.append((text, path, got[domain + path], expected))
    assert wrong == []


def test_robots_status(spark):
    rows = [("https://a", 401), ("https://b", 403), ("https://c", 404), ("https://d", 500), ("https://e", None), ("https://f", 200)]
    table = spark.createDataFrame([(d, s, "User-agent: *\nDisallow: /") for d, s in rows], "domain STRING, http_status INT, robots_txt STRING")
    urls = spark.createDataFrame([(d + "/x",) for d, _ in rows] + [("https://unknown/x",)], "url STRING")
    got = robots.with_robots(urls, robots.agent_rules(table, AGENT)).orderBy("url").collect()
    assert [r["can_fetch"] for r in got] == [False, False, True, True, True, False, True]


def test_facts_without_a_key_are_no_single_tasks_work(spark):
    facts = spark.range(1000).select("id", F.when(F.col("id") < 10, F.col("id")).alias("site"))
    lookup = spark.createDataFrame([(1, "one"), (2, "two")], "site LONG, name STRING")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = joins.lookup_join(facts, lookup, "site", ["id"], max_rows=0)
        assert sorted((r["id"], r["name"]) for r in joined.collect()) == [
            (i, {1: "one", 2: "two"}.get(i)) for i in range(1000)
        ]
        tasks = joined.groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in tasks) < 500
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
