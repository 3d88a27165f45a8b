import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from pagequarry.operators import frontier, tasks, visited
from pagequarry.operators.admission import recrawl_due
from pagequarry.operators.ordered import arrival_sequence, first_rows, global_rank, ranked

REQUEST = "site STRING, seq LONG, now_us LONG, rate_us LONG"
STATE = "site STRING, next_us LONG, last_us LONG"
HOUR = 3_600_000_000


def _loop(requests, state=None):
    """The rate limiter one request after the other."""
    free = {s: (n, last) for s, n, last in state or []}
    starts = {}
    for site, seq, now, rate in sorted(requests, key=lambda r: r[1]):
        known = free.get(site)
        start = now if known is None or now - known[1] >= HOUR else max(known[0], now)
        free[site] = (start + rate, now)
        starts[seq] = start
    return starts, free


def _slots(spark, requests, state=None, chunk=3):
    before = spark.createDataFrame(state, STATE) if state else None
    return frontier.rate_slots(spark.createDataFrame(requests, REQUEST), before, chunk_rows=chunk)


def test_slot_edges(spark):
    def starts(rows):
        requests = [("s", i + 1, int(now * 1e6), int(rate * 1e6)) for i, (now, rate) in enumerate(rows)]
        return [r["start_us"] / 1e6 for r in _slots(spark, requests).orderBy("seq").collect()]

    assert starts([(0, 1), (0, 1), (0.5, 1), (10, 1)]) == [0, 1, 2, 10]
    assert starts([(0, 0.15), (0, 1), (0, 5)]) == [0, 0.15, 1.15]


def test_slots_like_a_loop(spark):
    random.seed(3)
    for chunk in (1, 4, 50, 10_000):
        now, requests = 0, []
        for seq in range(1, 300):
            now += random.choice([0, 1_000_000, 600_000_000, HOUR - 1, HOUR, 2 * HOUR])
            # One site gets most of the requests.
            site = random.choice("aaaaab")
            requests.append((site, seq, now, random.choice([0, 500_000, 900_000_000, 3 * HOUR])))
        state = [("a", 5 * HOUR, -1), ("b", 10, -HOUR), ("c", 7, 7)]
        starts, free = _loop(requests, state)
        slots = _slots(spark, requests, state, chunk)
        assert {r["seq"]: r["start_us"] for r in slots.collect()} == starts
        after = {r["site"]: (r["next_us"], r["last_us"]) for r in frontier.slot_state(slots).collect()}
        assert after == {s: v for s, v in free.items() if s in "ab"}


def test_hot_site_is_many_tasks(spark):
    """A site with nearly all requests is cut into chunks by arrival number."""
    rows = spark.range(1, 5001).select(
        F.when(F.col("id") % 50 == 0, "cold").otherwise("hot").alias("site"),
        F.col("id").alias("seq"),
        (F.col("id") * 1000).alias("now_us"),
        F.lit(2000).alias("rate_us"),
    )
    slots = frontier.rate_slots(rows, chunk_rows=100)
    got = {r["seq"]: r["start_us"] for r in slots.collect()}
    assert got == _loop([tuple(r) for r in rows.collect()])[0]


def _tasks(spark, rows):
    """(site, url, priority, seq)"""
    df = spark.createDataFrame(rows, "site STRING, url STRING, priority INT, seq LONG")
    return df.withColumns(
        {
            "rate_limit": F.lit(1.0),
            "retry_count": F.lit(0),
            "max_retries": F.lit(3),
            "headers": F.create_map(F.lit("User-Agent"), F.lit("x")),
        }
    )


def test_same_task_keeps_latest_number(spark):
    added = frontier.add_tasks(_tasks(spark, [("s", "u", 1, 1), ("s", "u", 1, 7), ("s", "u", 0, 3)]))
    assert sorted((r["priority"], r["seq"]) for r in added.collect()) == [(0, 3), (1, 7)]


def test_lowest_score_first(spark):
    order = frontier.site_order(_tasks(spark, [("s", "a", 1, 1), ("s", "b", 0, 9)]))
    assert {r["url"]: r["rn"] for r in order.collect()} == {"b": 1, "a": 2}


def test_round_robin_like_turns(spark):
    random.seed(4)
    rows = [(s, f"{s}{i}", random.randint(0, 1), 0) for s in "abc" for i in range(5)]
    random.shuffle(rows)
    rows = [(s, u, p, i + 1) for i, (s, u, p, _) in enumerate(rows)]
    queues = {s: sorted((p * 10**9 + n, u) for t, u, p, n in rows if t == s) for s in "abc"}
    expected, rotation = [], 0
    for _ in rows:
        rotation += 1
        expected.append(queues["abc"[rotation % 3]].pop(0)[1])
    batch = frontier.next_batch(_tasks(spark, rows), len(rows), rotation=1)
    assert [r["url"] for r in batch.collect()] == expected
    whole = frontier.round_robin(_tasks(spark, rows), rotation=1, chunk_rows=4).orderBy("rn", "turn")
    assert [r["url"] for r in whole.collect()] == expected


def test_ranks_with_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 9 == 0, "b").otherwise("a").alias("k"), "id")
    got = {(r["k"], r["id"]): r["n"] for r in ranked(df, ["k"], "id", "n", chunk_rows=128).collect()}
    for key in "ab":
        ids = sorted(i for k, i in got if k == key)
        assert [got[key, i] for i in ids] == list(range(1, len(ids) + 1))


def test_global_rank(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"), "id")
    rows = global_rank(df, ["x", "id"], "n").orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(1, 1001))
    assert [r["x"] for r in rows] == sorted(r["x"] for r in rows)


def test_arrival_sequence_over_files(spark, tmp_path):
    spark.range(100).repartition(4).write.parquet(str(tmp_path / "t"))
    rows = arrival_sequence(spark.read.parquet(str(tmp_path / "t"))).collect()
    assert sorted(r["seq"] for r in rows) == list(range(1, 101))


def test_first_rows_limits_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    first = first_rows(df, ["k"], ["id"])
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert sorted(r["id"] for r in first.collect()) == [0, 1, 2]


def test_visited(spark):
    day, next_day = date(2024, 1, 1), date(2024, 1, 2)
    rows = [("n", day, "u#a", 1), ("n", day, "u/", 2), ("n", next_day, "u", 3), ("m", day, "u", 4)]
    df = visited.keyed(spark.createDataFrame(rows, "namespace STRING, day DATE, url STRING, seq LONG"))
    new = visited.newly_visited(df, None, ["seq"])
    assert sorted(r["seq"] for r in new.collect()) == [1, 3, 4]
    again = visited.newly_visited(df, visited.grown(new.limit(0), new), ["seq"])
    assert again.count() == 0
    kept = visited.unexpired(new, F.lit(date(2024, 1, 4)))
    assert {r["day"] for r in kept.collect()} == {next_day}


def test_retry_and_dead_letter(spark):
    failed = _tasks(spark, [("s", "a", 1, 1), ("s", "b", 1, 2)]).withColumn(
        "retry_count", F.when(F.col("url") == "a", 2).otherwise(3)
    )
    assert [(r["url"], r["retry_count"]) for r in tasks.retries(failed).collect()] == [("a", 3)]
    dead = tasks.decoded(tasks.dead_letters(failed).select("payload")).collect()
    assert [(r["url"], r["retry_count"], r["headers"]) for r in dead] == [("b", 4, {"User-Agent": "x"})]


def test_recrawl_due(spark):
    now = datetime(2024, 1, 10)
    late = timedelta(days=3, microseconds=1)
    df = spark.createDataFrame(
        [(None,), (now - timedelta(days=3),), (now - late,)], "last TIMESTAMP_NTZ"
    )
    due = df.select(recrawl_due(F.col("last"), F.lit(now).cast("timestamp_ntz"))).collect()
    assert [r[0] for r in due] == [True, False, True]


def test_order_holds_beyond_the_priority_step(spark):
    """Arrival numbers above a thousand million neither overtake nor tie with another priority."""
    from pagequarry.operators import frontier as ops

    tasks = [(1, 3), (0, 1_000_000_005), (1, 5), (0, 2)]
    rows = spark.createDataFrame([("a", p, s) for p, s in tasks], "site string, priority int, seq long")
    placed = {(r["priority"], r["seq"]): r["rn"] for r in ops.site_order(rows, chunk_rows=4).collect()}
    assert placed == {(0, 2): 1, (0, 1_000_000_005): 2, (1, 3): 3, (1, 5): 4}
    batch = [(r["priority"], r["seq"]) for r in ops.next_batch(rows, 3).collect()]
    assert batch == [(0, 2), (0, 1_000_000_005), (1, 3)]


def test_shared_folder_is_asked_for_on_a_cluster():
    """Without a shared folder only a local master may write intermediate tables."""
    from types import SimpleNamespace

    import pytest

    from pagequarry.session import shared_folder

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
    with pytest.raises(ValueError):
        shared_folder(session)
