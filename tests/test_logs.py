"""Event logs read live and in batch, cut anywhere; spans through OTLP files."""

from __future__ import annotations

import io
import random

from pyspark.sql import functions as F

from tessella.sources import logs


def plain(body: bytes) -> list[tuple[str, str]]:
    """(event, data) of a whole body, by splitting it."""
    parts = body.decode().replace("\r\n", "\n").split("\n\n")[:-1]
    return [(e, d) for e, d in (logs.fields(p.encode()) for p in parts) if d is not None]


def body(n: int) -> bytes:
    ends = ("\n\n", "\n\n\n", "\r\n\r\n")
    made = (": note\n" * (i % 3) + f"event: e{i % 2}\ndata: é€{i}" + "\ndata: zwei 🙂" * (i % 4) + ends[i % 3] for i in range(n))
    return "".join(made).encode() + b"data: open"


def test_any_cut_gives_each_frame_once(monkeypatch):
    monkeypatch.setattr(logs, "STEP_BYTES", 3)
    whole = body(20)
    for seed in range(60):
        cuts = sorted(random.Random(seed).sample(range(1, len(whole)), 7))
        log, got = io.BytesIO(whole), []
        for low, high in zip([0, *cuts], [*cuts, len(whole)], strict=True):
            got += [logs.fields(f) for _, f in logs.frames(log, low, high)]
        assert [(e, d) for e, d in got if d is not None] == plain(whole), cuts


def test_batch_and_restarted_stream(spark, tmp_path):
    logs.register(spark)
    root, whole = tmp_path / "logs", body(40)
    root.mkdir()
    cuts = [0, 7, 8, 300, 301, len(whole) // 2, len(whole)]
    for low, high in zip(cuts, cuts[1:], strict=False):
        for name in ("a", "b"):
            with open(root / f"{name}.sse", "ab") as log:
                log.write(whole[low:high])
        source = spark.readStream.format("event_logs").option("blockBytes", "50").load(str(root))
        query = source.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True)
        query.start(str(tmp_path / "out")).awaitTermination(120)
    for rows in (spark.read.parquet(str(tmp_path / "out")), spark.read.format("event_logs").load(str(root))):
        for name in ("a", "b"):
            got = rows.where(F.col("stream_id") == name).orderBy("at").select("event", "data").collect()
            assert [tuple(r) for r in got] == plain(whole)


def test_end_mark_and_empty_folder(spark, tmp_path):
    logs.register(spark)
    assert spark.read.format("event_logs").load(str(tmp_path)).count() == 0
    (tmp_path / "s.sse").write_bytes(b"data: 1\n\ndata: [DONE]\n\ndata: 2\n\n")
    (tmp_path / "t.sse").write_bytes(b"data: 1\n\n")
    rows = logs.until_done(spark.read.format("event_logs").load(str(tmp_path)))
    assert sorted((r["stream_id"], r["data"]) for r in rows.collect()) == [("s", "1"), ("t", "1")]


def test_spans_survive_files(spark):
    schema = "trace_id string, span_id string, parent_span_id string, name string, start_ns long, end_ns long, note string, extra int"
    rows = [("t", "a", None, 'n "1"\n', 1, 2**62, "ü\n", 1), ("t", "b", "a", "", 0, 0, None, 2), (None, None, None, None, None, None, "", 3)]
    back = logs.exported(spark.createDataFrame(rows, schema), "svc", F.create_map(F.lit("note"), F.col("note"))).collect()
    want = [("svc", *r[:6], {"note": r[6]} if r[6] is not None else {}) for r in rows]
    assert sorted(map(repr, (tuple(r) for r in back))) == sorted(map(repr, want))
