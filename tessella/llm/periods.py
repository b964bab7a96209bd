"""Runs: stretches of consecutive words that repeat with a period, at least four times over.

A run of period q and length l holds l - q matches in a row (word i equals word i + q), so at least ``need(q)`` of
them, and one lies on a grid of that step. All (period, grid point) pairs of many texts laid end to end are looked at
together: those whose words differ go at once, the others grow to both sides by a search over prefix hashes, doubling
and then halving the step for all pairs simultaneously. The grids are harmonic, so n words have about n ln(n) / 3 pairs.
Every run that remains is verified word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.session import ship

#: A run has this many words at least, and this many periods.
LEAST = 6
TIMES = 4
#: Words that are searched at once, unless one text has more, and pairs that are held at once.
CHUNK_WORDS = 100_000
CHUNK_PAIRS = 1_000_000

_PRIME = 2**31 - 1
_BASES = (1_103_515_245, 69_069_069, 1_664_525_013)

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def need(period: np.ndarray) -> np.ndarray:
    """Matches in a row that a run of this period has at least."""
    return np.maximum(LEAST - period, (TIMES - 1) * period)


class Prefixes:
    """Polynomial prefix hashes of a word sequence; equal stretches have equal hashes, others nearly never."""

    def __init__(self, ids: np.ndarray, base: int):
        n = len(ids)
        self.powers = np.ones(n + 1, dtype=np.int64)
        known, factor = 1, base
        while known <= n:
            end = min(n + 1, 2 * known)
            self.powers[known:end] = self.powers[: end - known] * factor % _PRIME
            known, factor = end, factor * factor % _PRIME
        self.sums = np.concatenate([[0], np.cumsum((ids + 1) * self.powers[:n] % _PRIME)])

    def same(self, at: np.ndarray, period: np.ndarray, size: int) -> np.ndarray:
        """Whether the ``size`` words from ``at`` on are those a period later."""
        own = (self.sums[at + size] - self.sums[at]) % _PRIME * self.powers[period] % _PRIME
        later = at + period
        return own == (self.sums[later + size] - self.sums[later]) % _PRIME

    def extend(self, at: np.ndarray, period: np.ndarray, room: np.ndarray, back: bool) -> np.ndarray:
        """Matches in a row from ``at`` on, or before it, at most ``room``: for all pairs at once."""
        grown = np.zeros(len(at), dtype=np.int64)
        stop = np.zeros(len(at), dtype=np.int64)
        open_, level = np.arange(len(at)), 0

        def matches(who: np.ndarray, size: int) -> np.ndarray:
            fits = np.flatnonzero(grown[who] + size <= room[who])
            some = who[fits]
            from_ = at[some] - grown[some] - size if back else at[some] + grown[some]
            return fits[self.same(from_, period[some], size)]

        while len(open_):  # steps of 1, 2, 4, ... as long as they match
            stop[open_] = level
            open_ = open_[matches(open_, 1 << level)]
            grown[open_] += 1 << level
            level += 1
        for level in range(int(stop.max(initial=0)) - 1, -1, -1):  # then halved
            who = np.flatnonzero(stop > level)
            grown[who[matches(who, 1 << level)]] += 1 << level
        return grown


def _pairs(n: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(period, grid point) of all periods that a text of ``longest`` words can have, in bounded parts."""
    periods = np.arange(1, longest // TIMES + 1, dtype=np.int64)
    steps = need(periods)
    counts = -(-(n - periods) // steps)
    part = np.cumsum(counts) // CHUNK_PAIRS
    for cut in np.split(np.arange(len(periods)), np.flatnonzero(np.diff(part)) + 1) if len(periods) else ():
        size = counts[cut]
        point = np.arange(size.sum(), dtype=np.int64) - np.repeat(np.cumsum(size) - size, size)
        yield np.repeat(periods[cut], size), point * np.repeat(steps[cut], size)


def _search(ids: np.ndarray, longest: int, base: int) -> Runs | None:
    """Starts, ends and periods of all runs by start; None where a hash has deceived."""
    n, hashes, found = len(ids), Prefixes(ids, base), []
    for period, point in _pairs(n, longest):
        hit = np.flatnonzero(ids[point] == ids[point + period])
        period, point = period[hit], point[hit]
        after = hashes.extend(point, period, n - period - point, back=False)
        before = hashes.extend(point, period, point, back=True)
        long = np.flatnonzero(after + before >= need(period))
        start, period = (point - before)[long], period[long]
        # Several grid points lie in one run.
        found.append(np.unique(np.stack([start, start + period + (after + before)[long], period]), axis=1))
    start, end, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), dtype=np.int64)
    # A stretch of several periods is a run of the smallest, which divides the others.
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])])[: len(start)]
    least = period[np.maximum.accumulate(np.where(first, np.arange(len(start)), 0))]
    if np.any(period % least):
        return None
    start, end, period = start[first], end[first], period[first]
    for s, e, q in zip(start.tolist(), end.tolist(), period.tolist(), strict=True):
        if not np.array_equal(ids[s : e - q], ids[s + q : e]):
            return None
    return start, end, period


def _plain(ids: np.ndarray, longest: int) -> Runs:
    """The same without hashes, a pass for each period: for the case that every base has deceived."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, longest // TIMES + 1):
        match = np.concatenate([[0], ids[:-q] == ids[q:], [0]]).astype(np.int8)
        edge = np.diff(match)
        for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            if e - s >= max(LEAST - q, (TIMES - 1) * q):
                found.setdefault((s, e + q), q)
    rows = sorted((s, e, q) for (s, e), q in found.items())
    start, end, period = np.array(rows, dtype=np.int64).reshape(-1, 3).T
    return start, end, period


def runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of every text, by start and period.

    The texts are laid end to end with a mark of its own after each, which no run crosses.
    """
    sizes = np.array([len(words) for words in texts], dtype=np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    longest = int(sizes.max(initial=0))
    if longest < LEAST:
        return out
    known: dict[bytes, int] = {}
    flat: list[int] = []
    for no, words in enumerate(texts):
        flat.extend(known.setdefault(w, len(known)) for w in words)
        flat.append(-1 - no)
    ids = np.array(flat, dtype=np.int64)
    ids[ids < 0] = len(known) - 1 - ids[ids < 0]
    starts = np.cumsum(sizes + 1) - sizes - 1
    found = next((f for f in (_search(ids, longest, base) for base in _BASES) if f is not None), None)
    start, end, period = _plain(ids, longest) if found is None else found
    text_no = np.searchsorted(starts, start, side="right") - 1
    for no, s, length, q in zip(text_no.tolist(), (start - starts[text_no]).tolist(), (end - start).tolist(), period.tolist(), strict=True):
        out[no].append((s, length, q))
    for one in out:
        one.sort(key=lambda run: (run[0], run[2]))
    return out


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact length / period; of equal ones the first in order."""
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


_COLUMNS = {
    "n_words": pa.int64(), "n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(),
    "exponent_milli": pa.int64(), "runs": pa.list_(pa.list_(pa.int64())), "runs_sha256": pa.string(), "collapsed": pa.string(),
}
_SCHEMA = (
    "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs array<array<bigint>>, "
    "runs_sha256 string, collapsed string"
)


def _rows(texts: list[list[bytes]]) -> dict[str, list]:
    out: dict[str, list] = {name: [] for name in _COLUMNS}
    for words, found in zip(texts, runs(texts), strict=True):
        start, length, period = strongest(found) or (None, None, None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        row = (
            len(words), len(found), start, length, period, 1000 * length // period if period else None,
            [list(run) for run in found], hashlib.sha256(listed.encode()).hexdigest(), b" ".join(collapsed(words, found)).decode(),
        )
        for name, value in zip(_COLUMNS, row, strict=True):
            out[name].append(value)
    return out


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", edit: Callable | None = None) -> DataFrame:
    """The periodic runs of every whole text, and the text without their repetitions.

    Returns key, n_words, n_runs; start, length, period and exponent_milli of the strongest run (null without runs);
    runs (start, length, period of each, by start), runs_sha256 (of lines ``start,length,period``), collapsed (the
    words outside repetitions, joined by one space). ``edit``, if given, is applied to (key, words) of each row before
    the search. A null, empty or blank text has no words and no runs. Repeated rows fare alike, null keys too; other
    columns are not read; an empty table gives no rows. Every text is searched inside its scan, so nothing is shuffled;
    texts are taken in groups of bounded size, and one text is never split.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, held, size, start = batch.column(0).to_pylist(), [], 0, 0
            for no, value in enumerate(batch.column(1)):
                words = (value.as_py() or "").encode().split()
                held.append(edit(keys[no], words) if edit else words)
                size += len(words)
                if size >= CHUNK_WORDS or no == batch.num_rows - 1:
                    columns = [pa.array(v, type=_COLUMNS[name]) for name, v in _rows(held).items()]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(held)), *columns], names=[key, *_COLUMNS])
                    held, size, start = [], 0, no + 1

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {_SCHEMA}")
