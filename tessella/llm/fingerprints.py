"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs are its lines, cut further after sentence ends and, in long runs of words, after words
picked by their hash, so that an edit moves no cut far from it. Each paragraph's digest (with its number among
equal ones) goes to three cells of count, key sum and check sum. The difference of two sketches holds only
the digests that differ; peeling cells of one digest recovers them. Where peeling stalls, both texts are
sketched again at twice the size. With the recovered digests the likeness is the exact Jaccard index of the
two paragraph sets.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import ship

#: Cells of the stored fingerprint; retries take GROWTH times as many.
CELLS = 32
GROWTH = 4
HASHES = 3
#: A run of more words than this without a sentence end is cut after words whose hash is 0 modulo CUT.
LONG = 24
CUT = 8
#: Documents follow each other in order in blocks, which are ranges of the order column. A block has about so many
#: rows, but there are at most MOST_BLOCKS; a block is sorted with spilling and streamed, so any size will do.
BLOCK_ROWS = 4_000
MOST_BLOCKS = 2_000

_ENDS = re.compile(rb"\n|(?<=[.!?])[ \t]+")
_MASK = (1 << 64) - 1


def paragraphs(text: bytes) -> list[bytes]:
    """Paragraphs of a text in UTF-8; blank ones go."""
    out = []
    for part in _ENDS.split(text):
        words = part.split()
        if len(words) <= LONG:
            if words:
                out.append(part)
            continue
        start = 0
        for i, word in enumerate(words, 1):
            if xxhash.xxh3_64_intdigest(word) % CUT == 0 or i == len(words):
                out.append(b" ".join(words[start:i]))
                start = i
        if start < len(words):
            out.append(b" ".join(words[start:]))
    return out


def digests(text: str | None) -> list[int]:
    """Distinct 64-bit digests of the paragraphs; the n-th equal paragraph has a digest of its own."""
    seen: dict[int, int] = {}
    out = []
    for p in paragraphs((text or "").encode()):
        d = xxhash.xxh3_64_intdigest(p)
        n = seen.get(d, 0)
        seen[d] = n + 1
        out.append(d if not n else xxhash.xxh3_64_intdigest(d.to_bytes(8, "little") + n.to_bytes(4, "little")))
    return list(dict.fromkeys(out))


def _places(keys: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three cells of each key, one in each of three parts of the table."""
    third = np.uint64(cells // HASHES)
    mixed = (keys ^ keys >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    first = mixed % third
    second = third + (mixed >> np.uint64(21)) % third
    return first, second, third * np.uint64(2) + (mixed >> np.uint64(42)) % (np.uint64(cells) - third * np.uint64(2))


def _checks(keys: np.ndarray) -> np.ndarray:
    return keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)


class Sketches:
    """A text's paragraph digests and its sketches by number of cells."""

    def __init__(self, keys: list[int]):
        self.keys = np.array(keys, dtype=np.uint64)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def table(self, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts, key sums and check sums (by exclusive or) of the cells."""
        if cells not in self.tables:
            counts = np.zeros(cells, dtype=np.int64)
            sums = np.zeros(cells, dtype=np.uint64)
            checks = np.zeros(cells, dtype=np.uint64)
            check = _checks(self.keys)
            for places in _places(self.keys, cells):
                at = places.astype(np.int64)
                np.add.at(counts, at, 1)
                np.bitwise_xor.at(sums, at, self.keys)
                np.bitwise_xor.at(checks, at, check)
            self.tables[cells] = counts, sums, checks
        return self.tables[cells]

    def fingerprint(self) -> str:
        """Hexadecimal sketch of CELLS cells: counts (2 bytes each), key sums (8), check sums (4)."""
        counts, sums, checks = self.table(CELLS)
        return (counts.astype(">u2").tobytes() + sums.astype(">u8").tobytes() + checks.astype(">u4").tobytes()).hex()


def peel(a: Sketches, b: Sketches, cells: int) -> tuple[set[int], set[int]] | None:
    """Digests of a only and of b only, from the difference of their sketches; None where peeling stalls."""
    (ca, sa, ka), (cb, sb, kb) = a.table(cells), b.table(cells)
    # What both hold cancels out; a Python loop then takes cells of one digest off until none is left.
    counts, sums, checks = (ca - cb).tolist(), (sa ^ sb).tolist(), (ka ^ kb).tolist()
    third = cells // HASHES
    rest = cells - 2 * third
    only: dict[int, set[int]] = {1: set(), -1: set()}
    pure = [i for i, n in enumerate(counts) if n == 1 or n == -1]
    while pure:
        i = pure.pop()
        sign = counts[i]
        if sign != 1 and sign != -1:
            continue
        key = sums[i]
        check = (key * 0x9E3779B97F4A7C15 & _MASK) >> 32
        if checks[i] != check:
            continue
        mixed = (key ^ key >> 29) * 0xBF58476D1CE4E5B9 & _MASK
        places = (mixed % third, third + (mixed >> 21) % third, 2 * third + (mixed >> 42) % rest)
        if i not in places:
            continue
        only[sign].add(key)
        for place in places:
            counts[place] = n = counts[place] - sign
            sums[place] ^= key
            checks[place] ^= check
            if n == 1 or n == -1:
                pure.append(place)
    if any(counts) or any(sums) or any(checks):
        return None
    return only[1], only[-1]


def difference(a: Sketches, b: Sketches) -> tuple[set[int], set[int]]:
    """Digests of a only and of b only: sketches of CELLS cells first, then of GROWTH times as many on failure.

    A table hardly peels more digests than it has cells, so sizes below the difference in number are passed over.
    Much larger than both texts' digests, a table could stall only if two keys met in all cells at every size.
    """
    cells = CELLS
    while cells < abs(len(a.keys) - len(b.keys)):
        cells *= GROWTH
    while True:
        found = peel(a, b, cells)
        if found is not None:
            return found
        cells *= GROWTH


def likeness(a: Sketches, b: Sketches) -> float:
    """Jaccard index of the two digest sets, from what peeling recovers; 1 for two empty sets."""
    first, second = difference(a, b)
    shared = len(a.keys) - len(first)
    union = shared + len(first) + len(second)
    return shared / union if union else 1.0


def edited(text: str, following: str) -> str:
    """The text with its last floor(n / 2) code points replaced by the first as many (or all) of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (block, key, look, text): each block in order of key, then text, and last the row that follows it.

    Blocks are ranges of the key, cut at approximate quantiles, so no task sees the whole order; the row after the
    last block is the first of all. Null keys come first. Only the first row of each block is gathered by itself,
    so that table has at most MOST_BLOCKS + 1 rows. A key that repeats very often is one block.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    parts = min(MOST_BLOCKS, max(1, -(-rows.count() // BLOCK_ROWS)))
    points = [(i + 1) / parts for i in range(parts - 1)]
    cuts = sorted(set(rows.approxQuantile("key", points, 0.2 / parts))) if points else []
    bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>")
    block = F.size(F.filter(bounds, lambda b: b <= F.col("key").cast("double")))
    blocked = rows.select(F.when(F.col("key").isNull(), F.lit(-1)).otherwise(block).alias("block"), "key", "text")
    first = blocked.groupBy("block").agg(F.min("key").alias("first"))
    starts = blocked.join(F.broadcast(first.withColumnRenamed("block", "at")), (F.col("block") == F.col("at")) & F.col("key").eqNullSafe(F.col("first")))
    heads = starts.groupBy("block").agg(F.min(F.struct("key", "text")).alias("head"))
    # The window orders the heads only, one row a block.
    order = Window.orderBy("block")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = heads.select("block", F.coalesce(F.lead("head").over(order), F.first("head").over(every)).alias("next"))
    looks = ahead.select("block", F.col("next.key").alias("key"), F.lit(True).alias("look"), F.col("next.text").alias("text"))
    every_row = blocked.select("block", "key", F.lit(False).alias("look"), "text").unionByName(looks)
    return every_row.repartition("block").sortWithinPartitions("block", "look", F.col("key").asc_nulls_first(), "text")


def _stream(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Pairs each row with the next of its block, the last with the block's look-ahead row."""
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held: tuple | None = None
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for block, doc, look, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            keys = Sketches(digests(text))
            if held is not None and held[0] == block:
                _, doc_id, before, own = held
                new = edited(before, text)
                new_keys = Sketches(digests(new))
                row = (
                    doc_id,
                    len(before),
                    hashlib.sha256(new.encode()).hexdigest(),
                    own.fingerprint(),
                    new_keys.fingerprint(),
                    likeness(own, new_keys),
                    likeness(own, keys),
                )
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            held = None if look else (block, doc, text, keys)
        if out[0]:
            types[0] = batch.schema.field(1).type
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, types, strict=True)], names=names)


def compare(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and the likeness of both and of the next document.

    Returns key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The next document
    is the one of the next key (then text); after the last comes the first, so a single row follows itself. A
    null text counts as empty; two texts without paragraphs are alike (1). Rows of equal key and text follow
    each other in any order, with equal results. Other columns are not read; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    schema = (
        f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return in_blocks(docs, key, text).mapInArrow(lambda batches: _stream(batches, key), schema)
