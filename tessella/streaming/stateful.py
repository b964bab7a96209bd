"""Streams with timers, bounded state and state that expires: a stall watchdog, a call history, and a live answer cache.

They need the RocksDB state store, which ``session.build`` sets; each key's state is bounded by a parameter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessella.session import ship


def _ms(at: pd.Timestamp) -> int:
    return int(at.timestamp() * 1000)


class _Watchdog(StatefulProcessor):
    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long, tokens long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, tokens = self.last.get() if self.last.exists() else (None, 0)
        armed, stalls = last, []
        for at in sorted(_ms(t) for frame in rows for t in frame["ts"]):
            if last is not None and at - last > self.idle_ms:
                stalls.append((key[0], last, at - last, tokens))
            tokens += 1
            last = at if last is None else max(last, at)
        if armed is not None:
            self.handle.deleteTimer(armed + self.idle_ms)
        self.last.update((last, tokens))
        self.handle.registerTimer(last + self.idle_ms)
        yield self._rows(stalls)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # No token came until the watermark passed the limit. What comes later begins a stream of its own.
        last, tokens = self.last.get()
        self.last.clear()
        yield self._rows([(key[0], last, None, tokens)])

    def _rows(self, stalls: list[tuple]) -> pd.DataFrame:
        rows = [(s[0], pd.Timestamp(s[1], unit="ms"), s[2], s[3], s[3] > 0) for s in stalls]
        return pd.DataFrame(rows, columns=["stream_id", "last_token", "gap_ms", "tokens", "partial"], dtype=object)

    def close(self) -> None:
        pass


def watchdog(tokens: DataFrame, idle_seconds: float = 20, late: str = "0 seconds") -> DataFrame:
    """Stalls of streams (stream_id, ts): a row as soon as a stream has had no token for over ``idle_seconds``.

    (stream_id, last_token, gap_ms, tokens, partial): the last token before the stall, the gap to the next one, or null
    where none had come when the watermark passed the limit, the tokens until then, and whether there were any. An
    error is thus emitted while the stream is still silent, which no window over its rows can do.
    """
    ship(tokens.sparkSession)
    out = "stream_id string, last_token timestamp, gap_ms long, tokens long, partial boolean"
    grouped = tokens.withWatermark("ts", late).select("stream_id", "ts").groupBy("stream_id")
    return grouped.transformWithStateInPandas(_Watchdog(round(idle_seconds * 1000)), out, "Append", "EventTime")


class _History(StatefulProcessor):
    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "ms long, call_id long, nano_usd long")
        self.totals = handle.getValueState("totals", "calls long, nano_usd long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        calls, spent = self.totals.get() if self.totals.exists() else (0, 0)
        kept = [tuple(r) for r in self.kept.get()] if self.kept.exists() else []
        for frame in rows:
            kept += zip((_ms(t) for t in frame["ts"]), frame["call_id"].tolist(), frame["nano_usd"].tolist(), strict=True)
            calls += len(frame)
            spent += int(frame["nano_usd"].sum())
            kept = sorted(kept)[-self.most :]
        self.kept.put(kept)
        self.totals.update((calls, spent))
        newest = [r[1] for r in reversed(kept)]
        yield pd.DataFrame({"user_id": [key[0]], "newest": [newest], "calls": [calls], "nano_usd": [spent]}, dtype=object)

    def close(self) -> None:
        pass


def history(calls: DataFrame, most: int = 500) -> DataFrame:
    """The newest ``most`` calls of each user of a stream (user_id, ts, call_id, nano_usd), and totals over all of them.

    After each batch with calls of a user: (user_id, newest, calls, nano_usd): ids of the calls kept, newest first, and
    number and cost of all calls, also of those that have left the list.
    """
    ship(calls.sparkSession)
    out = "user_id string, newest array<bigint>, calls long, nano_usd long"
    grouped = calls.select("user_id", "ts", "call_id", "nano_usd").groupBy("user_id")
    return grouped.transformWithStateInPandas(_History(most), out, "Update", "None")


class _Cache(StatefulProcessor):
    def __init__(self, threshold: float, ttl_ms: int, capacity: int, state_ttl_ms: int):
        self.threshold, self.ttl_ms, self.capacity, self.state_ttl_ms = threshold, ttl_ms, capacity, state_ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        row = "entry_id long, created long, v array<double>, ids array<string>"
        self.entries = handle.getListState("entries", row, ttlDurationMs=self.state_ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = list(self.entries.get()) if self.entries.exists() else []
        held = {k: (created, np.array(v), frozenset(ids)) for k, created, v, ids in known}
        out = []
        for frame in rows:
            for r in frame.sort_values(["ts", "request_id"]).itertuples():
                now, asked, ids = _ms(r.ts), np.asarray(r.v, dtype=np.float64), frozenset(r.ids)
                held = {k: entry for k, entry in held.items() if entry[0] + self.ttl_ms > now}
                out.append((key[0], r.request_id, *self._outcome(held, asked, ids)))
                if out[-1][2] != "hit" and r.cacheable:
                    held[r.request_id] = now, asked, ids
                    if len(held) > self.capacity:
                        del held[min(held, key=lambda k: (held[k][0], k))]
        if held:
            self.entries.put([(k, created, v.tolist(), sorted(own)) for k, (created, v, own) in held.items()])
        else:
            self.entries.clear()
        names = ["tenant", "request_id", "reason", "entry_id", "score", "entries"]
        yield pd.DataFrame([(*row, len(held)) for row in out], columns=names, dtype=object)

    def _outcome(self, held: dict, asked: np.ndarray, ids: frozenset) -> tuple[str, int | None, float | None]:
        if not held:
            return "empty", None, None
        near = [(round(float(v @ asked), 9), -k, own == ids) for k, (_, v, own) in held.items() if len(v) == len(asked)]
        above = [n for n in near if n[0] >= self.threshold]
        for same, reason in ((True, "hit"), (False, "identifier guard")):
            if best := max((n for n in above if n[2] == same), default=None):
                return reason, -best[1], best[0]
        return "below threshold", None, None

    def close(self) -> None:
        pass


def live_cache(
    requests: DataFrame, threshold: float, ttl_seconds: int = 3600, capacity: int = 500, state_ttl_seconds: int | None = None
) -> DataFrame:
    """Outcomes of a stream of requests (tenant, request_id, ts, v, ids, cacheable) against the entries stored before.

    A request is a hit if an entry of its tenant, no older than ``ttl_seconds``, has a similarity of ``threshold`` or more
    and the same identifiers; a cacheable request without a hit becomes an entry, and beyond ``capacity`` the oldest one
    of the tenant goes. (tenant, request_id, reason, entry_id, score, entries): entries is their number after the batch.
    Entries whose time is over leave the state with the tenant's next request, else after ``state_ttl_seconds`` of
    processing time (twice the time to live unless given). Ties go to the lowest entry.
    """
    ship(requests.sparkSession)
    out = "tenant string, request_id long, reason string, entry_id long, score double, entries long"
    keep = 1000 * (2 * ttl_seconds if state_ttl_seconds is None else state_ttl_seconds)
    grouped = requests.select("tenant", "request_id", "ts", "v", "ids", "cacheable").groupBy("tenant")
    return grouped.transformWithStateInPandas(_Cache(threshold, 1000 * ttl_seconds, capacity, keep), out, "Update", "ProcessingTime")
