"""Streams with timers and bounded state give the batch results."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import cache
from tessella.plans.operations import idle_gaps
from tessella.sources.files import table
from tessella.streaming import jobs, stateful

START = dt.datetime(2024, 1, 1, 22)


def run(spark, batches, make, tmp_path, name):
    """The rows that a stream emits, one input file a batch, and again from the checkpoint for further files."""
    source = tmp_path / "in"
    # State that expires by the clock asks for empty batches for ever, so a stream that should end must not run them.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(name not in ("cache", "gate")).lower())
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(batches[0].schema).parquet(str(source))
        out = make(stream).writeStream.outputMode("update" if name in ("history", "cache") else "append")
        out = out.foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(str(tmp_path / "out")))
        query = out.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
        assert query.awaitTermination(200)
        if query.exception():
            raise query.exception()
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    return spark.read.parquet(str(tmp_path / "out"))


def test_watchdog_speaks_up_while_a_stream_is_silent(spark, tmp_path):
    at = lambda *of: [START + dt.timedelta(seconds=s) for s in of]
    rows = [("a", t) for t in at(0, 5, 30, 31)] + [("b", t) for t in at(0, 10)]
    first = spark.createDataFrame(rows, "stream_id string, ts timestamp")
    later = spark.createDataFrame([("c", t) for t in at(200, 205)], "stream_id string, ts timestamp")
    got = run(spark, [first, later], lambda s: stateful.watchdog(s, 20), tmp_path, "watchdog").collect()
    found = sorted((r.stream_id, (r.last_token - START).total_seconds(), r.gap_ms, r.tokens, r.partial) for r in got)
    assert found == [("a", 5.0, 25_000, 2, True), ("a", 31.0, None, 4, True), ("b", 10.0, None, 2, True)]


def test_watchdog_equals_the_batch_gaps(spark, sf_dir, tmp_path):
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("stream_id"), F.date_trunc("millisecond", "ts").alias("ts"))
    got = run(spark, [events], lambda s: stateful.watchdog(s, 3_600), tmp_path, "watchdog")
    gaps = events.withColumn("before", F.expr("lag(ts) over (partition by stream_id order by ts)"))
    want = gaps.where("unix_millis(ts) - unix_millis(before) > 3600000")
    pairs = lambda df, a, b: sorted((r[0], r[1]) for r in df.select(a, b).collect())
    assert pairs(got.where("gap_ms is not null"), "stream_id", "last_token") == pairs(want, "stream_id", "before")
    assert idle_gaps(spark, sf_dir).count() >= 0


def test_history_is_bounded_and_totals_are_not(spark, sf_dir, tmp_path):
    calls = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 7).cast("string").alias("user_id"), F.date_trunc("millisecond", "ts").alias("ts"), F.col("event_id").alias("call_id"),
        (F.col("value") * 1000).cast("long").alias("nano_usd"),
    )
    batches = [calls.where(f"call_id % 3 = {i}") for i in range(3)]
    got = run(spark, batches, lambda s: stateful.history(s, 20), tmp_path, "history")
    last = {r.user_id: (r.newest, r.calls, r.nano_usd) for r in got.orderBy("batch").collect()}
    want = {}
    rows = calls.orderBy("ts", "call_id").collect()
    for user in {r.user_id for r in rows}:
        own = [r for r in rows if r.user_id == user]
        want[user] = [r.call_id for r in own[::-1][:20]], len(own), sum(r.nano_usd for r in own)
    assert last == want


def plain_cache(requests, threshold, ttl, capacity):
    out, held = {}, {}
    for tenant, number, ts, v, ids, cacheable in requests:
        own = held.setdefault(tenant, {})
        for k in [k for k, (at, _, _) in own.items() if (ts - at).total_seconds() >= ttl]:
            del own[k]
        near = sorted((-round(sum(a * b for a, b in zip(v, w, strict=True)), 9), k, set(i) == set(ids)) for k, (_, w, i) in own.items())
        above = [n for n in near if -n[0] >= threshold]
        hit = next((n for n in above if n[2]), None)
        veto = next(iter(above), None)
        best = hit or veto
        reason = "hit" if hit else "empty" if not own else "identifier guard" if veto else "below threshold"
        out[number] = reason, best[1] if best else None
        if not hit and cacheable:
            own[number] = ts, v, ids
            if len(own) > capacity:
                del own[min(own, key=lambda k: (own[k][0], k))]
    return out


@pytest.mark.parametrize(("ttl", "capacity"), [(10_000, 500), (300, 500), (10_000, 5)])
def test_live_cache_equals_one_request_after_another(spark, sf_dir, tmp_path, ttl, capacity):
    n = F.col("vec_id")
    ids = T.identifiers(F.concat(F.lit("order A-"), (1000 + n % 3).cast("string"), F.lit(" please")))
    requests = table(spark, sf_dir, "embeddings").where("vec_id < 240").select(
        F.col("label").cast("string").alias("tenant"), n.alias("request_id"), F.timestamp_seconds(1_700_000_000 + 5 * n).alias("ts"),
        F.col("embedding").cast("array<double>").alias("v"), ids.alias("ids"), (n % 10 != 3).alias("cacheable"),
    )
    batches = [requests.where("request_id < 100"), requests.where("request_id >= 100")]
    got = run(spark, batches, lambda s: stateful.live_cache(s, 0.2, ttl, capacity), tmp_path, "cache")
    want = plain_cache([tuple(r) for r in requests.orderBy("request_id").collect()], 0.2, ttl, capacity)
    assert {r.request_id: (r.reason, r.entry_id) for r in got.collect()} == want
    assert len({reason for reason, _ in want.values()}) >= 3
    assert got.agg(F.max("entries")).first()[0] <= capacity
    assert cache.TTL_SECONDS > 0


def test_budget_of_two_days_in_any_order(spark, tmp_path):
    day = lambda d, h: dt.datetime(2024, 1, d, h)
    schema = "user_id string, call_id long, ts timestamp, nano_usd long"
    parts = [[("u", 1, day(1, 23), 80)], [("u", 2, day(2, 0), 80)], [("u", 3, day(1, 23), 80), ("u", 4, day(2, 1), 80)], [("u", 5, day(1, 23), 1), ("u", 6, day(2, 2), 1)]]
    got = run(spark, [spark.createDataFrame(p, schema) for p in parts], lambda s: jobs.budget_gate(s, 100), tmp_path, "gate").collect()
    assert {r.call_id: (r.nano_before, r.allowed) for r in got} == {
        1: (0, True), 2: (0, True), 3: (80, True), 4: (80, True), 5: (160, False), 6: (160, False),
    }
