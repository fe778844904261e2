"""The event source, stateful registers and maintained counts, as streams that are stopped and started again."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sluicebox.streaming import decisions, events, registers, source, views

T0 = datetime(2026, 1, 1)


@pytest.fixture(autouse=True)
def settings(spark):
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    yield
    spark.conf.unset("spark.sql.parquet.outputTimestampType")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(frame, top, name, mode="append"):
    out = f"file://{top}/{name}-out"
    q = frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{top}/{name}-cp").outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return frame.sparkSession.read.parquet(out)


def test_a_stopped_query_goes_on_at_its_bookmark(spark, tmp_path):
    spark.dataSource.register(source.ReviewEvents)
    path = f"file://{tmp_path}/log"
    schema = "id string, seq long, time timestamp, type string, batchId string, data string"
    made = lambda ids: spark.createDataFrame([(f"e{i}", i, T0 + timedelta(milliseconds=300 * i), "log", "b", "{}") for i in ids], schema)
    read = lambda: spark.readStream.format("review_events").option("pageRows", "7").load(path)
    made(range(40)).repartition(3).write.mode("append").parquet(path)
    assert read().schema.names == made([]).schema.names
    raw = run(read(), tmp_path, "raw")
    assert run(events.deduplicate(read(), "10 seconds"), tmp_path, "once").count() == raw.count() == 40
    # The log grows; the last three events of before are in the overlap, a late one is in it too.
    made([38, *range(40, 55)]).write.mode("append").parquet(path)
    spark.createDataFrame([("late", 99, T0 + timedelta(milliseconds=300 * 38 + 10), "log", "b", "{}"), ("too late", 98, T0, "log", "b", "{}")], schema).write.mode("append").parquet(path)
    again = run(read(), tmp_path, "raw")
    assert again.count() == 40 + 15 + 1 + 5 and again.where("id = 'too late'").isEmpty()
    once = run(events.deduplicate(read(), "10 seconds"), tmp_path, "once")
    assert sorted(r["id"] for r in once.collect()) == sorted([*(f"e{i}" for i in range(55)), "late"])


def test_drafts_on_a_stream_are_those_of_the_batch(spark, tmp_path):
    r = random.Random(3)
    rows = [(d, s, r.choice(["update"] * 9 + ["freeze"]), f"t{s}", r.randrange(6)) for d in range(12) for s in range(14)]
    schema = "draft_id long, seq long, kind string, text string, expected long"
    table = spark.createDataFrame(rows, schema)
    for part in range(2):  # two batches, the state between them is the store's
        table.where(F.col("seq").between(7 * part, 7 * part + 6)).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        got = run(registers.draft_updates(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")), tmp_path, "drafts")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, decisions.draft_updates(table).collect()))


def test_drafts_are_forgotten_after_their_time(spark, tmp_path):
    schema = "draft_id long, seq long, kind string, text string, expected long"
    spark.createDataFrame([(1, 1, "update", "a", 0), (2, 1, "freeze", "", 0)], schema).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    frame = registers.draft_updates(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"), ttl_ms=1500)
    q = frame.writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/cp").outputMode("append").trigger(processingTime="1 second").start()
    left = lambda: spark.read.format("statestore").option("stateVarName", "register").load(f"file://{tmp_path}/cp").count()
    try:
        until = time.time() + 90
        while time.time() < until and (q.lastProgress is None or q.lastProgress["batchId"] < 4):
            time.sleep(0.5)
    finally:
        q.stop()
    assert left() == 0


def test_the_grace_race_on_a_stream(spark, tmp_path):
    r = random.Random(5)
    rows = [(k, T0 + timedelta(milliseconds=r.randrange(0, 3000, 50)), e) for k in range(60) for e in r.choice([["decision"], ["poll"], ["decision", "poll"], ["poll", "decision", "decision"]])]
    schema = "scenario_id long, time timestamp, event string"
    table = spark.createDataFrame(rows, schema).withColumn("ms", F.unix_millis("time"))
    expected = {x["scenario_id"]: x["winner"] for x in decisions.grace(table.where("event = 'decision'"), table.where("event = 'poll'")).collect()}
    # A row of another race, later, moves the watermark past all timers; a decision after that comes too late to count again.
    end = [(1000, T0 + timedelta(seconds=60), "poll")]
    more = [(0, T0 + timedelta(seconds=61), "decision"), (1000, T0 + timedelta(hours=3), "poll")]
    for part in (rows, end, more, [(1001, T0 + timedelta(hours=4), "poll")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        got = run(registers.grace(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")), tmp_path, "race").collect()
    assert sorted((x["scenario_id"], x["winner"]) for x in got if x["scenario_id"] < 1000) == sorted(expected.items())
    assert set(expected.values()) == {"decision", "poll"}
    # Decided races are forgotten: what is left of state is the last races' alone.
    state = spark.read.format("statestore").option("stateVarName", "seen").load(f"file://{tmp_path}/race-cp")
    assert {x["key"]["scenario_id"] for x in state.collect()} <= {0, 1000, 1001}


def comment_rows(spark, ids):
    rows = [(f"e{i}", 0, f"f{i % 4}", "warning" if i % 3 else "info", "review") for i in ids]
    return spark.createDataFrame(rows, "id string, pos int, file_path string, severity string, category string")


def counts(view):
    return {(r["facet"], r["value"]): r["n"] for r in view.read().collect()}


def recount(comments):
    rows = views.facet_changes(comments).groupBy("facet", "value").agg(F.sum("change").alias("n"))
    return {(r["facet"], r["value"]): r["n"] for r in rows.collect()}


def test_counts_are_those_of_a_recount_whatever_runs_twice(spark, tmp_path):
    view = views.Counts(spark, f"file://{tmp_path}/view")
    assert counts(view) == {}
    for batch in (0, 1, 1, 2, 0):
        view.apply(views.facet_changes(comment_rows(spark, range(20 * batch, 20 * batch + 20))), batch)
    assert counts(view) == recount(comment_rows(spark, range(60)))
    # Comments that go are changes of -1, and a count of zero is no row.
    view.apply(views.facet_changes(comment_rows(spark, range(0, 60, 4)), F.lit(-1)), 3)
    left = recount(comment_rows(spark, [i for i in range(60) if i % 4]))
    assert counts(view) == left and ("file_path", "f0") not in left
    view.compact()
    view.apply(views.facet_changes(comment_rows(spark, range(0, 60, 4)), F.lit(-1)), 3)  # once more, after the snapshot that holds it
    assert counts(view) == left
    view.apply(views.facet_changes(comment_rows(spark, [100])), 4)
    view.replace(views.facet_changes(comment_rows(spark, range(7))), 5)
    assert counts(view) == recount(comment_rows(spark, range(7)))


def test_counts_follow_a_stream(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    comment_rows(spark, range(30)).repartition(3).write.parquet(path)
    view = views.Counts(spark, f"file://{tmp_path}/view")
    stream = spark.readStream.schema(comment_rows(spark, [0]).schema).option("maxFilesPerTrigger", 1).parquet(path)
    for more in ([], range(30, 45)):
        if more:
            comment_rows(spark, more).write.mode("append").parquet(path)
        assert view.follow(stream, views.facet_changes, f"file://{tmp_path}/cp").awaitTermination(120)
    assert counts(view) == recount(comment_rows(spark, range(45)))
