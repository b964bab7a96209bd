"""Frames of streams that are cut anywhere, over chunks and over ranges of chunks, against a plain split of the whole."""

from __future__ import annotations

import random

import pytest

from tessella.sources import sse


def plain_frames(body, joined):
    found = []
    for position, raw in enumerate(body.replace("\r\n", "\n").split("\n\n")):
        lines = raw.split("\n")
        data = [x[5:].removeprefix(" ") for x in lines if x.startswith("data:")]
        events = [x[6:].removeprefix(" ") for x in lines if x.startswith("event:")]
        if not data:
            continue
        if joined.join(data) == "[DONE]":
            break
        found.append((position, events[-1] if events else "message", joined.join(data)))
    return found


def body(rng, frames):
    end = rng.choice(["\n", "\r\n"])
    parts = []
    for _ in range(frames):
        lines = [f"data: {rng.choice(['', 'a', 'é b', 'x' * 30])}" for _ in range(rng.randint(0, 2))]
        lines += [rng.choice([": note", "event: token", "event:end", "id: 3"])] if rng.random() < 0.7 else []
        lines += ["data: [DONE]"] if rng.random() < 0.01 else []
        parts.append(end.join(lines) + end * rng.choice([2, 2, 2, 2, 1, 3, 4, 5]))
    return "".join(parts) + rng.choice(["", "data: open", end, "\r"])


@pytest.mark.parametrize(("seed", "ranges"), [(1, 2), (2, 7), (3, 23), (4, 60)])
def test_frames_over_ranges(spark, seed, ranges):
    rng = random.Random(seed)
    streams = {"hot": body(rng, 150), "mid": body(rng, 40), None: body(rng, 20), "blank": "\n" * 50, "none": "", "one": "data: " + "y" * 200}
    streams |= {f"s{i}": body(rng, rng.randint(0, 6)) for i in range(12)}
    rows = []
    for stream, text in streams.items():
        at = seq = 0
        while at < len(text) or not seq:
            size = rng.choice([0, 1, 1, 2, 5, 17])
            rows.append((stream, seq, text[at : at + size] if size else rng.choice(["", None]), "extra"))
            at, seq = at + size, seq + 1
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "stream_id string, seq int, chunk string, data string")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for joined in ("\n", ""):
            got = sorted(((str(r["stream_id"]), r["position"], r["event"], r["data"]) for r in sse.parse(frame, joined).collect()))
            assert got == sorted((str(s), *f) for s, text in streams.items() for f in plain_frames(text, joined))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sse.parse(frame.limit(0)).count() == 0
