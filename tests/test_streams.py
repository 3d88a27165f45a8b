from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import frontier
from pagequarry.plans import stream_plans
from pagequarry.sources.batches import BatchLog
from pagequarry.streaming import jobs
from pagequarry.streaming.runner import drain, read_batches

START = datetime(2024, 1, 1)


def _arrive(spark, root, schema, batches, run):
    """Each batch as files of its own, worked on before the next one comes."""
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{root}/input/part{number}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/input")
        drain(run(stream), f"{root}/checkpoint")


def test_silent_sites_leave_the_slot_state(spark, tmp_path):
    second, root = 1_000_000, str(tmp_path)
    first = [(f"s{i}", i + 1, i * second, 2 * second) for i in range(50)]
    second_batch = [("s1", 60, 1800 * second, second), ("s2", 61, 1800 * second, second)]
    third = [("s2", 62, 3700 * second, second), ("s9", 63, 3700 * second, second)]
    schema = "site STRING, seq LONG, now_us LONG, rate_us LONG"
    _arrive(
        spark, root, schema, [first, second_batch, third],
        lambda stream: jobs.reserve_slots(stream, f"{root}/slots", f"{root}/state"),
    )
    states = [{r["site"] for r in spark.read.parquet(f"{root}/state/batch={n}").collect()} for n in range(3)]
    assert [len(s) for s in states] == [50, 50, 3] and states[2] == {"s1", "s2", "s9"}
    whole = frontier.rate_slots(spark.createDataFrame(first + second_batch + third, schema))
    got = read_batches(spark, f"{root}/slots").select("seq", "start_us").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, whole.select("seq", "start_us").collect()))


def test_late_events_are_counted_aside(spark, tmp_path):
    root = str(tmp_path)

    def at(minutes, metric="m"):
        return (START + timedelta(minutes=minutes), metric)

    batches = [
        [at(1), at(2), at(61)],  # moves the mark to 0:51
        [at(3), at(55), at(300), (None, "m")],  # the first hour is still open at 0:51, then the mark is 4:50
        [at(4), at(5, "other"), at(299)],  # two windows closed long ago, one still open
    ]
    log = BatchLog(spark, f"{root}/log", jobs.LATE_FACTS)
    _arrive(
        spark, root, "ts TIMESTAMP, metric STRING", batches,
        lambda stream: jobs.counts_with_late(stream, log, "10 minutes", "1 hour"),
    )
    rows = {(r["started"].hour, r["metric"]): (r["events"], r["late"]) for r in jobs.counts_merged(log).collect()}
    assert rows == {(0, "m"): (5, 1), (0, "other"): (1, 1), (1, "m"): (1, 0), (4, "m"): (1, 0), (5, "m"): (1, 0)}
    # A batch that never committed does not count.
    log.write("counts", 9, spark.createDataFrame([(START, "ghost", 1)], jobs.COUNTS))
    assert jobs.counts_merged(log).where(F.col("metric") == "ghost").count() == 0


def test_copied_terms_are_read_from_storage(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(stream_plans, "copy_store", lambda tables, write, read_back: seen.update(tables) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        stream_plans.store_copy(spark, "/root/testdata/sf0.001")
    for name in ("inverted_index", "term_ngrams"):
        # Else the texts are cut into terms for the rows and again for their number.
        assert "regexp_extract_all" not in seen[name]._jdf.queryExecution().optimizedPlan().toString()
        assert seen[name].count() > 0
