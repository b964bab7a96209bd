"""Quality rules on repetition inside a text, from a suffix array over its words.

The suffixes of many texts are ranked at once by prefix doubling (a rank never mixes texts). Neighbours in
the order give the longest common prefixes; suffix i then lies in an LCP interval of depth L(i), the length of
the longest substring at i that occurs elsewhere in the text. The maximal repeated substrings of at least
``least`` words cover the union of [i, i + L(i)) over L(i) >= least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.session import ship

#: Words that a repeated substring has at least.
LEAST = 5
#: Base rules: fewer words than this, or more than this percentage of words in repeats, fail.
LEAST_WORDS = 10
MOST_REPEATED = 20
#: The method's rules: percentage of word characters in repeats, and words of the longest repeat.
MOST_COVERED = 25
LONGEST = 50
#: Words that are ranked at once, unless one text has more.
CHUNK_WORDS = 150_000

_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"


def longest_repeats(words: list[list[bytes]], least: int = LEAST) -> np.ndarray:
    """L(i) for every word of every text, laid end to end; 0 where it is under ``least``."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    total = int(sizes.sum())
    out = np.zeros(total, dtype=np.int64)
    if not total:
        return out
    ids: dict[bytes, int] = {}
    flat = np.fromiter((ids.setdefault(w, len(ids)) for text in words for w in text), dtype=np.int64, count=total)
    ends = np.repeat(np.cumsum(sizes), sizes)
    text_no = np.repeat(np.arange(len(sizes)), sizes)
    key = text_no * len(ids) + flat
    order = np.argsort(key, kind="stable")
    rank = np.empty(total, dtype=np.int64)
    ordered = key[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    starts = np.maximum.accumulate(np.where(first, np.arange(total), 0))
    rank[order] = starts
    ranks = [rank]
    # Only suffixes that still share a rank are sorted again.
    group = np.diff(np.append(np.flatnonzero(first), total))
    open_ = order[np.repeat(group, group) > 1]
    width = 1
    while len(open_):
        after = open_ + width
        inside = after < ends[open_]
        follow = np.where(inside, rank[np.minimum(after, total - 1)] + 1, 0)
        own = rank[open_]
        sort = np.lexsort((follow, own))
        open_, own, follow = open_[sort], own[sort], follow[sort]
        new_own = np.concatenate([[True], own[1:] != own[:-1]])
        new = new_own | np.concatenate([[True], follow[1:] != follow[:-1]])
        at = np.arange(len(open_))
        own_start = np.maximum.accumulate(np.where(new_own, at, 0))
        start = np.maximum.accumulate(np.where(new, at, 0))
        rank = rank.copy()
        rank[open_] = own + start - own_start
        ranks.append(rank)
        group = np.diff(np.append(np.flatnonzero(new), len(open_)))
        open_ = open_[np.repeat(group, group) > 1]
        width *= 2
    suffixes = np.empty(total, dtype=np.int64)
    suffixes[rank] = np.arange(total)
    left, right = suffixes[:-1], suffixes[1:]
    same = ranks[min(least.bit_length() - 1, len(ranks) - 1)]
    near = same[left] == same[right]
    left, right = left[near], right[near]
    common = np.zeros(len(left), dtype=np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        a, b = left + common, right + common
        inside = (a < ends[left]) & (b < ends[right])
        equal = inside & (ranks[level][np.minimum(a, total - 1)] == ranks[level][np.minimum(b, total - 1)])
        common += np.where(equal, 1 << level, 0)
    long = common >= least
    np.maximum.at(out, left[long], common[long])
    np.maximum.at(out, right[long], common[long])
    return out


def _chunks(texts: list[str | None]) -> Iterator[list[bytes]]:
    """Texts in UTF-8, in runs of about CHUNK_WORDS words."""
    held, size = [], 0
    for text in texts:
        data = (text or "").encode()
        held.append(data)
        size += data.count(b" ") + data.count(b"\n") + 1
        if size >= CHUNK_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


def measure(texts: list[bytes], least: int = LEAST) -> dict[str, list[int]]:
    """Counts of each text (UTF-8): words, word characters, symbols, repeated lines, words and characters in
    repeats, words of the longest repeat."""
    words = [t.split() for t in texts]
    repeats = longest_repeats(words, least)
    out: dict[str, list[int]] = {
        k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_repeat_chars", "longest_repeat")
    }
    at = 0
    for text, split in zip(texts, words, strict=True):
        n = len(split)
        depth = repeats[at : at + n]
        at += n
        bare = text.translate(None, _SPACES)
        chars = len(bare.decode())
        repeated = repeated_chars = longest = 0
        if n and (longest := int(depth.max())):
            from_ = np.flatnonzero(depth)
            edge = np.zeros(n + 1, dtype=np.int64)
            np.add.at(edge, from_, 1)
            np.add.at(edge, from_ + depth[from_], -1)
            covered = np.flatnonzero(np.cumsum(edge[:n]))
            repeated = len(covered)
            repeated_chars = sum(len(split[i].decode()) for i in covered.tolist())
        lines = [x for x in text.split(b"\n") if x.strip()]
        out["n_words"].append(n)
        out["word_chars"].append(chars)
        out["n_symbols"].append(len(text) - len(text.translate(None, _SYMBOLS)))
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
        out["n_repeat_words"].append(repeated)
        out["n_repeat_chars"].append(repeated_chars)
        out["longest_repeat"].append(longest)
    return out


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_repeat_chars", "longest_repeat")


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """Counts and verdict of every text: key, the counts of ``measure``, base_failed, kept.

    base_failed: under 10 words, or over 20 % of words in repeats. kept: not base_failed, at most 25 % of word
    characters in repeats and no repeat of over 50 words. A null text has no words and fails. Repeated rows are
    judged alike; other columns are not read. Texts are ranked in runs of bounded size; one text is never split.
    """
    ship(docs.sparkSession)
    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for chunk in _chunks(batch.column(1).to_pylist()):
                counts = measure(chunk, least)
                columns = [pa.array(counts[c], type=pa.int64()) for c in _COUNTS]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(chunk)), *columns], names=[key, *_COUNTS])
                start += len(chunk)

    kind = docs.schema[key].dataType.simpleString()
    counted = docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{c} long" for c in _COUNTS))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    sound = (100 * F.col("n_repeat_chars") <= MOST_COVERED * F.col("word_chars")) & (F.col("longest_repeat") <= LONGEST)
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & sound)
