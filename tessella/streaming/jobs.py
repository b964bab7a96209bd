"""Structured Streaming forms of the time-bound operators. Event-time watermarks extend the batch semantics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.session import ship


def daily_spend(spend: DataFrame, late: str = "48 hours") -> DataFrame:
    """(user_id, day, nano_usd) from a stream of (user_id, ts, nano_usd); a day closes 48 hours after its end."""
    day = F.window("ts", "1 day")
    summed = spend.withWatermark("ts", late).groupBy("user_id", day.alias("w")).agg(F.sum("nano_usd").alias("nano_usd"))
    return summed.select("user_id", F.to_date("w.start").alias("day"), "nano_usd")


def sessions(tokens: DataFrame, gap: str = "20 seconds", late: str = "1 minute") -> DataFrame:
    """Runs of a stream's rows without a gap of ``gap``: (stream_id, began, ended, tokens); each end but the last is a stall."""
    w = F.session_window("ts", gap)
    summed = tokens.withWatermark("ts", late).groupBy("stream_id", w.alias("w")).agg(F.count("*").alias("tokens"))
    return summed.select("stream_id", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "tokens")


def budget_gate(calls: DataFrame, limit_nano: int) -> DataFrame:
    """Whether each call of a stream (user_id, call_id, ts, nano_usd) is let through, in order of arrival.

    State is one sum by user and day, so calls of two days may come in any order; a denied call adds nothing. The state of
    a day goes 48 hours after its last call.
    """
    ship(calls.sparkSession)
    out = "user_id string, call_id long, day date, nano_before long, allowed boolean"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        spent = state.get[0] if state.exists else 0
        rows = []
        for frame in frames:
            for call in frame.sort_values(["ts", "call_id"]).itertuples():
                allowed = spent < limit_nano
                rows.append((key[0], call.call_id, key[1], spent, allowed))
                spent += call.nano_usd if allowed else 0
        state.update((spent,))
        state.setTimeoutDuration(48 * 3600 * 1000)
        yield pd.DataFrame(rows, columns=["user_id", "call_id", "day", "nano_before", "allowed"])

    by_day = calls.withColumn("day", F.to_date("ts")).groupBy("user_id", "day")
    return by_day.applyInPandasWithState(step, out, "spent long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def frames(chunks: DataFrame, forget_seconds: int = 600) -> DataFrame:
    """Complete frames of streams whose chunks (stream_id, seq, chunk) arrive over time; an open rest is kept as state.

    A stream that has sent nothing for ``forget_seconds`` is over: its rest, which no blank line ended, is no frame.
    """
    ship(chunks.sparkSession)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rest = state.get[0] if state.exists else ""
        for part in parts:
            rest += "".join(part.sort_values("seq")["chunk"])
        *complete, rest = rest.split("\n\n")
        state.update((rest,))
        state.setTimeoutDuration(forget_seconds * 1000)
        yield pd.DataFrame({"stream_id": [key[0]] * len(complete), "frame": complete})

    return chunks.groupBy("stream_id").applyInPandasWithState(
        step, "stream_id string, frame string", "rest string", "append", GroupStateTimeout.ProcessingTimeTimeout
    )
