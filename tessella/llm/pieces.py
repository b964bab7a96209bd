"""SentencePiece encoding and decoding: Viterbi over a double-array trie of pieces with log scores.

The vocabulary is a public piece file, whose path is a parameter. Its file gives merge ranks, not
probabilities, so a piece of rank r gets the log probability of Zipf's law over the ranks. A text is encoded
as SentencePiece's unigram model does: spaces become the marker U+2581, one marker goes in front, and the
segmentation of highest total score is taken; a character that no piece covers becomes its UTF-8 bytes' pieces.
No piece has a marker after another character (checked on loading), so no segmentation crosses the start of a
run of markers: runs with what follows them are encoded one by one, and frequent ones are remembered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tessella.session import ship

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Score of an uncovered character below the lowest piece score, as SentencePiece has it.
UNKNOWN_PENALTY = 10.0
#: Units of a generation of a worker's memory.
REMEMBERED = 60_000
#: Characters of one Arrow output batch, about.
BATCH_CHARS = 1_000_000
#: Units that a lattice holds at once, and their bytes at most; longer ones go one by one.
LATTICE_UNITS = 8_192
LATTICE_BYTES = 64

_UNIT = re.compile(MARK + "+[^" + MARK + "]*|[^" + MARK + "]+")


@dataclass
class Vocabulary:
    """Double array (base, check), piece at each node (-1: none), scores by id, bytes of each id, byte ids."""

    base: list[int]
    check: list[int]
    piece: list[int]
    score: list[float]
    surface: list[bytes]
    byte_ids: list[int]
    unknown: float

    @cached_property
    def lattice(self) -> Lattice:
        return Lattice(self)


def double_array(keys: dict[bytes, int]) -> tuple[list[int], list[int], list[int]]:
    """base, check and value of a double-array trie: child c of node s is t = base[s] + c with check[t] = s."""
    ordered = sorted(keys.items())
    base, check, value = [0], [-2], [-1]
    free = wide = 257
    todo = [(0, 0, len(ordered), 0)]
    while todo:
        node, low, high, depth = todo.pop()
        if len(ordered[low][0]) == depth:
            value[node] = ordered[low][1]
            low += 1
        children = []
        at = low
        while at < high:
            letter = ordered[at][0][depth]
            end = at
            while end < high and ordered[end][0][depth] == letter:
                end += 1
            children.append((letter, at, end))
            at = end
        if not children:
            continue
        # Nodes of one child fill the first hole; others search from a point that only moves on.
        while free < len(check) and check[free] != -1:
            free += 1
        offset = free - children[0][0] if len(children) == 1 else wide
        while any(offset + c < len(check) and check[offset + c] != -1 for c, _, _ in children):
            offset += 1
        if len(children) > 1:
            wide = max(wide, offset - 128)
        grow = offset + 256 - len(check)
        if grow > 0:
            base += [0] * grow
            check += [-1] * grow
            value += [-1] * grow
        base[node] = offset
        for c, start, end in children:
            check[offset + c] = node
            todo.append((offset + c, start, end, depth + 1))
    return base, check, value


@lru_cache(maxsize=1)
def load(path: str = MODEL_PATH) -> Vocabulary:
    """Read a piece file on the driver, once; the result travels to the tasks (its size is the vocabulary's)."""
    import sentencepiece

    source = sentencepiece.SentencePieceProcessor(model_file=path)
    size = source.get_piece_size()
    normal = [i for i in range(size) if not (source.is_control(i) or source.is_unknown(i) or source.is_byte(i))]
    surface = [b""] * size
    byte_ids = [-1] * 256
    keys: dict[bytes, int] = {}
    score = [0.0] * size
    harmonic = float(np.log(np.sum(1.0 / np.arange(1, len(normal) + 1))))
    for rank, i in enumerate(normal):
        text = source.id_to_piece(i)
        if MARK in text.lstrip(MARK):
            raise ValueError(f"piece {i} has a marker inside; units cannot be encoded one by one")
        keys[text.encode()] = i
        # Steps of 1/256 make sums exact, so that ties are ties in any order of summing.
        score[i] = round(float(-np.log(rank + 1.0) - harmonic) * 256) / 256
        surface[i] = text.replace(MARK, " ").encode()
    for i in range(size):
        if source.is_byte(i):
            value = int(source.id_to_piece(i)[1:-1], 16)
            byte_ids[value] = i
            surface[i] = bytes([value])
    if min(byte_ids) < 0:
        raise ValueError("the vocabulary has no byte pieces")
    base, check, piece = double_array(keys)
    return Vocabulary(base, check, piece, score, surface, byte_ids, min(score[i] for i in normal) - UNKNOWN_PENALTY)


def viterbi(unit: bytes, v: Vocabulary) -> list[int]:
    """Ids of the best segmentation of one unit in UTF-8; of equal ones, that whose last pieces start first."""
    n = len(unit)
    base, check, piece, score = v.base, v.check, v.piece, v.score
    limit = len(check)
    best: list[float | None] = [None] * (n + 1)
    best[0] = 0.0
    came: list[tuple[int, int]] = [(-1, -1)] * (n + 1)
    for i in range(n):
        here = best[i]
        if here is None:
            continue
        first = unit[i]
        width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        node, single = 0, False
        for j in range(i, n):
            child = base[node] + unit[j]
            if child >= limit or check[child] != node:
                break
            node = child
            found = piece[node]
            if found >= 0:
                total = here + score[found]
                old = best[j + 1]
                if old is None or total > old:
                    best[j + 1] = total
                    came[j + 1] = (i, found)
                single = single or j + 1 - i == width
        if not single:
            end = min(i + width, n)
            total = here + v.unknown
            old = best[end]
            if old is None or total > old:
                best[end] = total
                came[end] = (i, -1)
    out: list[int] = []
    at = n
    while at > 0:
        start, found = came[at]
        if found >= 0:
            out.append(found)
        else:
            out.extend(v.byte_ids[b] for b in reversed(unit[start:at]))
        at = start
    out.reverse()
    return out


class Lattice:
    """Viterbi over many units at once: position by position, the trie is walked for all units that still match."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.base = np.array(vocabulary.base, dtype=np.int64)
        self.check = np.array(vocabulary.check, dtype=np.int64)
        self.piece = np.array(vocabulary.piece, dtype=np.int64)
        self.score = np.array(vocabulary.score)
        self.byte_ids = np.array(vocabulary.byte_ids, dtype=np.int32)

    def encode(self, units: list[bytes]) -> list[bytes]:
        """Packed int32 ids of each unit, equal to those of ``viterbi``; long units go one by one."""
        out = [b""] * len(units)
        order = sorted(range(len(units)), key=lambda k: len(units[k]))
        at = 0
        while at < len(order) and len(units[order[at]]) <= LATTICE_BYTES:
            part = [k for k in order[at : at + LATTICE_UNITS] if len(units[k]) <= LATTICE_BYTES]
            for k, packed in zip(part, self._many([units[k] for k in part])):
                out[k] = packed
            at += len(part)
        for k in order[at:]:
            out[k] = np.array(viterbi(units[k], self.vocabulary), dtype=np.int32).tobytes()
        return out

    def _many(self, units: list[bytes]) -> list[bytes]:
        n, longest = len(units), max(map(len, units))
        size = np.fromiter(map(len, units), dtype=np.int64, count=n)
        # A zero column at the end lets walks look one byte ahead; no piece continues past the size of its unit.
        letters = np.frombuffer(b"".join(u.ljust(longest + 1, b"\0") for u in units), dtype=np.uint8).reshape(n, longest + 1)
        width = np.where(letters < 0x80, 1, np.where(letters < 0xE0, 2, np.where(letters < 0xF0, 3, 4)))
        best = np.full((n, longest + 1), -np.inf)
        best[:, 0] = 0.0
        start = np.zeros((n, longest + 1), dtype=np.int64)
        chosen = np.full((n, longest + 1), -1, dtype=np.int64)
        for i in range(longest):
            begun = np.flatnonzero((size > i) & (best[:, i] > -np.inf))
            single = np.zeros(n, dtype=bool)
            rows, node, j = begun, np.zeros(len(begun), dtype=np.int64), i
            while len(rows):
                child = self.base[node] + letters[rows, j]
                fits = child < len(self.check)
                fits[fits] = self.check[child[fits]] == node[fits]
                rows, node, j = rows[fits], child[fits], j + 1
                found = self.piece[node]
                ends = found >= 0
                r, f = rows[ends], found[ends]
                total = best[r, i] + self.score[f]
                better = total > best[r, j]
                r_better = r[better]
                best[r_better, j], start[r_better, j], chosen[r_better, j] = total[better], i, f[better]
                single[r[width[r, i] == j - i]] = True
                goes = size[rows] > j
                rows, node = rows[goes], node[goes]
            rows = begun[~single[begun]]
            end = np.minimum(i + width[rows, i], size[rows])
            total = best[rows, i] + self.vocabulary.unknown
            better = total > best[rows, end]
            rows, end = rows[better], end[better]
            best[rows, end], start[rows, end], chosen[rows, end] = total[better], i, -1
        return self._paths(letters, size, start, chosen)

    def _paths(self, letters: np.ndarray, size: np.ndarray, start: np.ndarray, chosen: np.ndarray) -> list[bytes]:
        rows, at = np.arange(len(size)), size.copy()
        steps = []
        while len(rows):
            begin = start[rows, at]
            steps.append((rows, begin, at, chosen[rows, at]))
            left = begin > 0
            rows, at = rows[left], begin[left]
        row, begin, end, ids = (np.concatenate(c[::-1]) for c in zip(*steps))
        # Steps were gathered from the ends on; a stable sort by unit leaves each unit's pieces in order.
        order = np.argsort(row, kind="stable")
        row, begin, end, ids = row[order], begin[order], end[order], ids[order]
        number = np.where(ids >= 0, 1, end - begin)
        first = np.cumsum(number) - number
        offset = np.arange(number.sum()) - np.repeat(first, number)
        whole, of, letter = np.repeat(ids, number), np.repeat(row, number), np.repeat(begin, number) + offset
        packed = np.where(whole >= 0, whole, self.byte_ids[letters[of, letter]]).astype(np.int32).tobytes()
        bounds = 4 * np.searchsorted(of, np.arange(len(size) + 1))
        return [packed[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


class Encoder:
    """Memory of packed ids by unit. A unit is a run of markers and what follows; a single marker is left out of its key.

    The memory has two generations: a full one replaces the one before, and what is met again moves on.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.lattice = vocabulary.lattice
        self.recent: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def packed(self, keys: list[str]) -> list[bytes]:
        """Packed int32 ids of distinct units."""
        recent, before = self.recent, self.before
        found = [recent.get(k) or before.get(k) for k in keys]
        lost = [i for i, f in enumerate(found) if f is None]
        units = [(keys[i] if keys[i][0] == MARK else MARK + keys[i]).encode() for i in lost]
        for i, ids in zip(lost, self.lattice.encode(units)):
            found[i] = ids
        recent.update(zip(keys, found))
        if len(recent) > REMEMBERED:
            self.recent, self.before = {}, recent if len(recent) < 3 * REMEMBERED else {}
        return found

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has; none for a null or empty one."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
        counts = np.zeros(len(texts), dtype=np.int64)
        full = pc.not_equal(texts, "")
        texts = texts.filter(full)
        odd = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
        if pc.any(odd).as_py():
            split = [_UNIT.findall(MARK + t.replace(" ", MARK)) for t in texts.to_pylist()]
            units = pa.array([[u[1:] if len(u) > 1 and u[1] != MARK else u for u in s] for s in split], pa.list_(pa.string()))
        else:
            units = pc.split_pattern(texts, " ")
        coded = units.flatten().dictionary_encode()
        packed = self.packed(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 4
        ids, place = spread(np.frombuffer(b"".join(packed), dtype=np.int32), size, coded.indices.to_numpy())
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(units).to_numpy())])
        counts[full.to_numpy(zero_copy_only=False)] = np.diff(np.concatenate([[0], place])[bounds])
        return ids, counts

    def encode(self, text: str | None) -> bytes:
        return self.encode_column(pa.array([text], pa.string()))[0].tobytes()


def spread(flat: np.ndarray, size: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of consecutive runs of ``size`` values in ``flat``, the chosen ones one after another, and where each ends."""
    number = size[chosen]
    stops = np.cumsum(number)
    first = (np.cumsum(size) - size)[chosen] - (stops - number)
    return flat[np.arange(number.sum()) + np.repeat(first, number)], stops


class Decoder:
    """Bytes of ids, looked up for many ids at once."""

    def __init__(self, surface: list[bytes]):
        self.flat = np.frombuffer(b"".join(surface), dtype=np.uint8)
        self.size = np.array([len(s) for s in surface], dtype=np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Bytes of consecutive runs of ``counts`` ids, without the space that encoding puts in front."""
        letters, stops = spread(self.flat, self.size, ids)
        data = letters.tobytes()
        bounds = np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [data[a + data.startswith(b" ", a, b) : b] for a, b in zip(bounds[:-1], bounds[1:])]


def decode_ids(ids: list[int], surface: list[bytes]) -> str:
    """Text of ids: byte pieces join to UTF-8 (replaced where invalid), markers become spaces, the first goes."""
    return Decoder(surface).decode(np.array(ids, dtype=np.int64), np.array([len(ids)]))[0].decode("utf-8", "replace")


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = MODEL_PATH, hashed: bool = False) -> DataFrame:
    """Encode whole texts and decode the ids again: (key, ids, n_pieces, n_bytes, decoded).

    ``decoded`` equals the text but for literal markers, which read as spaces; with ``hashed`` its SHA-256 in
    lowercase hex, decoded_sha256, takes its place. Null and empty texts have no ids and decode to "". Repeated rows
    give equal rows; other columns are not read.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = held.value
        encoder, decoder = Encoder(vocabulary), Decoder(vocabulary.surface)
        is_byte = np.zeros(len(vocabulary.surface), dtype=bool)
        is_byte[vocabulary.byte_ids] = True
        for batch in batches:
            chars = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
            start = 0
            while start < batch.num_rows:
                before = chars[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(chars, before + BATCH_CHARS, side="right")))
                ids, sizes = encoder.encode_column(batch.column(1).slice(start, stop - start))
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                decoded = decoder.decode(ids, sizes)
                if hashed:
                    back = pa.array([hashlib.sha256(d).hexdigest() for d in decoded], type=pa.string())
                else:
                    back = pa.array([d.decode() for d in decoded], type=pa.string())
                n_bytes = np.diff(np.concatenate([[0], np.cumsum(is_byte[ids])])[offsets])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, stop - start),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
                        pa.array(sizes),
                        pa.array(n_bytes, type=pa.int64()),
                        back,
                    ],
                    names=[key, "ids", "n_pieces", "n_bytes", "decoded_sha256" if hashed else "decoded"],
                )
                start = stop

    kind = docs.schema[key].dataType.simpleString()
    last = "decoded_sha256" if hashed else "decoded"
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>, n_pieces long, n_bytes long, {last} string")
