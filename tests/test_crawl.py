"""Crawl rounds, the submission queue and batch-numbered appends, when something dies half-way."""

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import crawl, stats, tasks
from pagequarry.schemas import REGISTRY, ROBOTS, TASK
from pagequarry.operators.robots import agent_rules
from pagequarry.sources.batches import BatchLog
from pagequarry.sources.queue import SubmissionQueue
from pagequarry.sources.tables import RAW, append_failures, read_submissions

A, B = "https://a.example/", "https://b.example/"


def day(text="2024-02-01"):
    return F.lit(text).cast("date")


def links(*urls):
    return "<html><h1>Title of a page</h1>" + "".join(f'<a href="{u}">x</a>' for u in urls) + "</html>"


WEB = [
    (A + "start", 200, links("/item-1", "/item-2/", "/item-2#top", "/bad/x", B + "other", "/start", "/gone")),
    (A + "item-1", 200, links("/item-3", "/item-1")),
    (A + "item-2/", 500, None),
    (A + "item-3", 200, links("/start")),
    (B + "start", 200, links("/item-1", "/item-1", "/secret")),
    (B + "item-1", 200, links("/start", "/item-9")),
]


@pytest.fixture()
def inputs(spark):
    selectors = {"title_selector": "h1", "description_selector": "h1", "image_selector": None, "image_attr": "src"}
    sites = [
        {"site_order": k, "base_url": base, "seed_url": "/start", "name": f"site {k}", "blocklist": ["/bad/"],
         "allowindb": [r"/item-\d+"], "unidirection": False, "rate_limit": 2.0, "user_agent": "agent", "selectors": selectors}
        for k, base in enumerate((A, B))
    ]
    robots = [(B[:-1], 200, "User-agent: *\nDisallow: /secret\n")]
    return {
        "registry": spark.createDataFrame(sites, REGISTRY),
        "robots_rules": agent_rules(spark.createDataFrame(robots, ROBOTS), "agent"),
        "day": day(),
        "now": F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"),
    }


def fetching(spark, asked):
    fetch = crawl.fetch_from(spark.createDataFrame(WEB, "url string, status int, html string"))

    def counted(wanted):
        asked.extend(r.url for r in wanted.collect())
        return fetch(wanted)

    return counted


def started(spark, folder, inputs):
    state = crawl.CrawlState(spark, str(folder), buckets=2)
    seeds = tasks.seeds(inputs["registry"])
    state.start(seeds.withColumn("seq", F.when(F.col("site") == A, 1).otherwise(2).cast("long")), day())
    return state


def tables(state):
    return {
        "frontier": sorted((r.seq, r.url, r.priority, r.retry_count) for r in state.frontier().collect()),
        "visited": sorted(tuple(r) for r in state.visited(day()).collect()),
        "dead": sorted((r.url, r.retry_count, r.batch) for r in state.dead_letters().collect()),
        "counters": {r.metric: r.total for r in state.counters().collect()},
        "documents": sorted((r.url, r.novel_name, r.source) for r in state.documents().collect()),
    }


def test_rounds_find_every_page(spark, tmp_path, inputs, monkeypatch):
    monkeypatch.setattr(tasks, "MAX_RETRIES", 1)
    state, asked = started(spark, tmp_path, inputs), []
    rounds = crawl.crawl(state, 9, fetch=fetching(spark, asked), **inputs)
    found = tables(state)
    # The failing page and the missing ones are tried twice each, then given up.
    assert rounds == 4 and found["frontier"] == []
    assert found["dead"] == [(A + "gone", 2, 3), (A + "item-2/", 2, 3), (B + "item-9", 2, 4)]
    assert [d[0] for d in found["documents"]] == [A + "item-1", A + "item-3", B + "item-1"]
    assert found["documents"][0][1:] == ("Title of a page", "site 0")
    assert found["counters"] == {
        "request_started": 11, "request_success": 5, "page_crawled": 5, "request_failed": 6, "url_discovered": 6,
    }
    # Nothing outside, blocked or kept out by robots was asked for; nothing answered was asked for twice.
    assert sorted(asked) == sorted(
        [A + "start", A + "item-1", A + "item-3", B + "start", B + "item-1"] + 2 * [A + "item-2/", A + "gone", B + "item-9"]
    )


def test_a_round_that_died_is_run_again(spark, tmp_path, inputs, monkeypatch):
    whole = started(spark, tmp_path / "whole", inputs)
    crawl.crawl(whole, 2, fetch=fetching(spark, []), **inputs)

    state, asked = started(spark, tmp_path / "died", inputs), []
    fetch = fetching(spark, asked)
    crawl.run_round(state, fetch=fetch, **inputs)
    before = tables(state)

    def dies(_):
        raise RuntimeError("killed")

    with monkeypatch.context() as broken:
        broken.setattr(stats, "counters", dies)
        with pytest.raises(RuntimeError):
            crawl.run_round(state, fetch=fetch, **inputs)
    assert tables(state) == before and state.last() == 1
    once = list(asked)
    assert crawl.run_round(state, fetch=fetch, **inputs) == 2
    assert asked == once
    assert tables(state) == tables(whole)


def test_round_of_some_tasks_leaves_the_others(spark, tmp_path, inputs):
    state, asked = started(spark, tmp_path, inputs), []
    crawl.run_round(state, fetch=fetching(spark, asked), size=1, **inputs)
    assert len(asked) == 1
    left = tables(state)["frontier"]
    assert {A + "start", B + "start"} - set(asked) <= {t[1] for t in left}
    assert len({t[0] for t in left}) == len(left)


def test_old_days_are_not_visited(spark, tmp_path, inputs):
    state = started(spark, tmp_path, inputs)
    later = day("2024-02-04")
    assert state.visited(later).count() == 0 and state.visited(day()).count() == 2


def submissions(spark, rows):
    return spark.createDataFrame(rows, "partition int, offset long, raw string")


def taken(rows):
    return [r.raw for r in rows.orderBy("position").collect()]


def test_queue_hands_out_the_oldest(spark, tmp_path):
    rows = [(p, 10 * p + k, f"{p}:{k}") for p in range(2) for k in range(4)]
    queue = SubmissionQueue(spark, str(tmp_path), submissions(spark, rows))
    assert taken(queue.take(0, 3)) == ["0:0", "0:1", "0:2"]
    # Taken again after more has arrived, a batch is the same.
    more = submissions(spark, [*rows, (2, 0, "2:0"), (0, 4, "0:4")])
    queue = SubmissionQueue(spark, str(tmp_path), more)
    assert taken(queue.take(0, 3)) == ["0:0", "0:1", "0:2"]
    with pytest.raises(ValueError):
        queue.take(1, 3)
    queue.done(0)
    assert taken(queue.take(1, 4)) == ["2:0", "0:3", "0:4", "1:0"]
    queue.done(1)
    assert taken(queue.take(2, 100)) == ["1:1", "1:2", "1:3"]
    queue.done(2)
    assert taken(queue.take(3, 5)) == [] and queue.pending().count() == 0


def test_submissions_of_a_folder_keep_their_order(spark, tmp_path):
    spark.createDataFrame([(f"u{k}",) for k in range(20)], "raw string").coalesce(1).write.parquet(str(tmp_path / "in"))
    queue = SubmissionQueue(spark, str(tmp_path / "q"), read_submissions(spark, str(tmp_path / "in")))
    assert taken(queue.take(0, 7)) == [f"u{k}" for k in range(7)]


def test_batches_show_once_committed(spark, tmp_path):
    log = BatchLog(spark, str(tmp_path), "note STRING")
    rows = spark.createDataFrame([("x",)], "raw string")
    assert log.read("t", rows.schema).collect() == [] and log.batches() == []
    for batch in (0, 2, 5):
        log.write("t", batch, rows)
        log.commit(batch, f"b{batch}")
    log.write("t", 3, rows)
    assert sorted(r.batch for r in log.read("t", rows.schema).collect()) == [0, 2, 5]
    assert [r.batch for r in log.read("t", rows.schema, [2, 3]).collect()] == [2]
    assert [r.note for r in log.commits()] == ["b0", "b2", "b5"]


def test_append_of_failures_is_replayed(spark, tmp_path):
    made = [{"url": f"u{k}", "site": A, "priority": 1, "retry_count": k, "max_retries": 2, "rate_limit": 1.0, "headers": {}} for k in range(4)]
    failed = spark.createDataFrame(made, TASK)
    log = BatchLog(spark, str(tmp_path))
    for _ in range(2):
        append_failures(log, 7, failed)
    assert log.read("retries", RAW).count() == 2 and log.read("dead_letters", RAW).count() == 2
    again = tasks.decoded(log.read("retries", RAW).select("raw"), "raw").orderBy("url").collect()
    assert [(r.url, r.retry_count) for r in again] == [("u0", 1), ("u1", 2)]
