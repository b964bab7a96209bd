"""The streaming forms give the batch results on in-order data."""

from __future__ import annotations

import datetime as dt

from tessella.operators import ledger
from tessella.streaming import jobs

START = dt.datetime(2024, 1, 1, 22)
SPEND = "user_id string, call_id long, ts timestamp, nano_usd long"


def run(spark, frame, make, tmp_path, name, mode="append"):
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    # State that expires by the clock asks for empty batches for ever.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    query = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    query.option("checkpointLocation", str(tmp_path / "checkpoint")).start().awaitTermination(120)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    return spark.table(name)


def test_daily_spend(spark, tmp_path):
    rows = [(f"u{i % 3}", i, START + dt.timedelta(minutes=20 * i), 10 * i) for i in range(40)]
    frame = spark.createDataFrame(rows, SPEND)
    got = run(spark, frame, jobs.daily_spend, tmp_path, "daily", "complete").collect()
    batch = ledger.daily_spend(frame).collect()
    key = lambda r: (r["user_id"], r["day"], r["nano_usd"])
    assert sorted(map(key, got)) == sorted(map(key, batch))


def test_budget_gate(spark, tmp_path):
    rows = [(f"u{i % 2}", i, START + dt.timedelta(minutes=20 * i), 40) for i in range(20)]
    frame = spark.createDataFrame(rows, SPEND)
    got = {r["call_id"]: r["allowed"] for r in run(spark, frame, lambda s: jobs.budget_gate(s, 100), tmp_path, "gate").collect()}
    assert got == {r["call_id"]: r["allowed"] for r in ledger.allowed_calls(frame, 100, "call_id").collect()}


def test_sessions(spark, tmp_path):
    ts = [START + dt.timedelta(seconds=s) for s in (0, 5, 10, 60, 65)]
    frame = spark.createDataFrame([("s", t) for t in ts], "stream_id string, ts timestamp")
    got = run(spark, frame, jobs.sessions, tmp_path, "sessions", "complete").orderBy("began").collect()
    assert [r["tokens"] for r in got] == [3, 2]


def test_frames_across_chunks(spark, tmp_path):
    body = "data: a\n\ndata: bc\n\ndata: open"
    rows = [("s", i, body[i : i + 4]) for i in range(0, len(body), 4)]
    got = run(spark, spark.createDataFrame(rows, "stream_id string, seq int, chunk string"), jobs.frames, tmp_path, "frames").collect()
    assert [r["frame"] for r in got] == ["data: a", "data: bc"]
