"""Repair of the turn structure of conversations, by the cheapest edits.

A repaired conversation has role initials ``(s?(ua)+)?``. A row may be kept, given another role, or deleted, and empty
turns may be inserted. The grammar has four states; the cost to go from each state before each row is found backward,
and a forward walk then takes, among the transitions that are tight with it, the one whose initial is ASCII-least.

Rows are range-partitioned by conversation and turn, so a conversation is one stretch of a partition, or several. One
that lies whole in a stretch of bounded size is repaired where it is. The others are cut into pieces of bounded size:
each piece's costs are a min-plus matrix between the states at its two ends, so the pieces of one conversation, however
long, are worked on by many tasks, and only their matrices and states are put in a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Scratch
from tessella.session import ship

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3
#: States of the grammar: nothing yet, after s, after u, after a. Nothing and a may end.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or reroled turn, and the role that such a turn gets.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: The state after a kept row, by state and initial.
KEPT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LEGAL = ("su", "ua", "au")
#: Rows and characters of a piece.
PIECE_ROWS = 2_000
PIECE_CHARS = 4_000_000

INFINITE = 1 << 60
END = (0, 2 * INSERT, INSERT, 0)
_BLANK = " \t\n\x0b\x0c\r"

BLANK, DUPLICATE, CUT, SOUND = "b", "d", "t", "."


def _relaxed(costs: list[int]) -> list[int]:
    """Costs with inserted turns before whatever comes."""
    nothing, system, user, assistant = costs
    user, assistant = min(user, INSERT + assistant), min(assistant, INSERT + user)
    return [min(nothing, INSERT + user), min(system, INSERT + user), user, assistant]


def costs_to_go(initials: list[str], faults: str, end: Iterable[int] = END) -> list[list[int]]:
    """For each position, the cheapest cost from each state to the end; ``end`` holds the costs from there on."""
    costs = [_relaxed(list(end))]
    for initial, fault in zip(reversed(initials), reversed(faults), strict=True):
        ahead = costs[-1]
        own = [DELETE + c for c in ahead]
        if fault not in (BLANK, DUPLICATE):
            more = TRUNCATED if fault == CUT else 0
            for state in range(4):
                own[state] = min(own[state], REROLE + more + ahead[NEXT[state]])
                if (kept := KEPT.get((state, initial))) is not None:
                    own[state] = min(own[state], KEEP + more + ahead[kept])
        costs.append(_relaxed(own))
    costs.reverse()
    return costs


def walk(initials: list[str], faults: str, costs: list[list[int]], state: int, last: bool = True) -> tuple[list[tuple[str, int, int]], int]:
    """The edits (initial, row or -1, state after it) from ``state`` on, the ASCII-least of the cheapest, and the end state.

    Turns are inserted at the end only if it is the conversation's ``last``; those between two pieces are the next one's.
    """
    edits: list[tuple[str, int, int]] = []
    at, n = 0, len(initials)
    while at < n:
        cost, fault = costs[at][state], faults[at]
        more = TRUNCATED if fault == CUT else 0
        after = NEXT[state]
        if cost == DELETE + costs[at + 1][state]:
            edits.append(("D", at, state))
            at += 1
        elif cost == INSERT + costs[at][after]:
            edits.append(("I", -1, after))
            state = after
        else:
            kept = KEPT.get((state, initials[at]))
            name = "K" if kept is not None and cost == KEEP + more + costs[at + 1][kept] else "R"
            state = kept if name == "K" else after
            edits.append((name, at, state))
            at += 1
    while last and state in (SYSTEM, USER):
        state = NEXT[state]
        edits.append(("I", -1, state))
    return edits, state


def turns(edits: list[tuple[str, int, int]], roles: list[str], texts: list[str]) -> list[str]:
    """The repaired turns as ``role:text``."""
    out = []
    for name, at, state in edits:
        if name == "K":
            out.append(f"{roles[at]}:{texts[at]}")
        elif name != "D":
            out.append(f"{ROLE[state]}:{texts[at] if at >= 0 else ''}")
    return out


def fault(text: str) -> str:
    bare = text.rstrip(_BLANK)
    if not bare:
        return BLANK
    return SOUND if bare[-1] in ".!?" else CUT


def illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


class Piece:
    """Rows of one conversation that follow each other, and what they show by themselves."""

    def __init__(self, key, order: int, rows: int, chars: int):
        self.key, self.order, self.rows, self.chars = key, order, rows, chars
        self.turns: list[int | None] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.size = 0

    def add(self, turn: int | None, role: str, text: str, times: int) -> None:
        for _ in range(times):
            self.turns.append(turn)
            self.roles.append(role)
            self.texts.append(text)
            self.size += len(role) + len(text)

    def full(self) -> bool:
        return len(self.turns) >= self.rows or self.size >= self.chars

    def faults(self) -> str:
        seen: set[tuple[str, str]] = set()
        out = []
        for row in zip(self.roles, self.texts, strict=True):
            own = fault(row[1])
            if own != BLANK:
                own = DUPLICATE if row in seen else own
                seen.add(row)
            out.append(own)
        return "".join(out)

    def fact(self) -> dict:
        """Numbers of the rows; turns are in order, so those of several pieces add up but for a shared border."""
        known = [t for t in self.turns if t is not None]
        return {"low": known[0] if known else None, "high": known[-1] if known else None, "n_turns": len(set(known))}

    def repaired(self, with_turns: bool) -> dict:
        """The result of a conversation that is this piece alone."""
        initials, faults, fact = [r[:1] for r in self.roles], self.faults(), self.fact()
        costs = costs_to_go(initials, faults)
        edits, _ = walk(initials, faults, costs, NOTHING)
        said = turns(edits, self.roles, self.texts)
        return {
            "gaps": fact["high"] - fact["low"] + 1 - fact["n_turns"] if fact["n_turns"] else 0,
            "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT),
            "illegal": illegal(initials), "cost": costs[0][NOTHING], "audit": "".join(e[0] for e in edits),
            "turns": said if with_turns else None,
            "repaired_sha256": hashlib.sha256("\n".join(said).encode()).hexdigest(),
        }

    def cut(self) -> dict:
        """The piece itself, to be joined with the others of its conversation."""
        hashes = [hashlib.blake2b(f"{len(r)}:{r}:{t}".encode(), digest_size=16).digest() for r, t in zip(self.roles, self.texts, strict=True)]
        return {"initials": [r[:1] for r in self.roles], "faults": self.faults(), "hashes": hashes, "roles": self.roles, "texts": self.texts, **self.fact()}


_RESULT = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, turns array<string>, repaired_sha256 string"
)
_PIECE = (
    "initials array<string>, faults string, hashes array<binary>, roles array<string>, texts array<string>, low long, high long, n_turns long"
)
_RESULT_TYPE = pa.struct([
    *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
    ("audit", pa.string()), ("turns", pa.list_(pa.string())), ("repaired_sha256", pa.string()),
])
_PIECE_TYPE = pa.struct([
    ("initials", pa.list_(pa.string())), ("faults", pa.string()), ("hashes", pa.list_(pa.binary())), ("roles", pa.list_(pa.string())),
    ("texts", pa.list_(pa.string())), ("low", pa.int64()), ("high", pa.int64()), ("n_turns", pa.int64()),
])


def _cut(batches: Iterator[pa.RecordBatch], rows: int, chars: int, with_turns: bool) -> Iterator[pa.RecordBatch]:
    """A sorted partition's conversations: repaired if they are whole and small, else in pieces.

    The first and the last one of a partition may go on in another, so they are always given as pieces.
    """
    order = TaskContext.get().partitionId() << 32
    kind, held, size = None, [], 0

    def flush() -> pa.RecordBatch:
        columns = [pa.array([h[0] for h in held], type=kind), pa.array([h[1] for h in held], type=pa.int64())]
        columns += [pa.array([h[2] for h in held], type=_RESULT_TYPE), pa.array([h[3] for h in held], type=_PIECE_TYPE)]
        return pa.RecordBatch.from_arrays(columns, names=["key", "piece", "result", "part"])

    piece, open_ = None, True
    for batch in batches:
        kind = batch.schema.field(0).type
        for key, turn, role, text, times in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if piece is None or piece.key != key or piece.full():
                if piece is not None:
                    done = piece.key != key
                    whole = done and not open_
                    held.append((piece.key, piece.order, piece.repaired(with_turns) if whole else None, None if whole else piece.cut()))
                    size += piece.size
                    open_ = not done
                order += 1
                piece = Piece(key, order, rows, chars)
            piece.add(turn, role, text, times)
            if len(held) >= 1_000 or size >= 1_000_000:
                yield flush()
                held, size = [], 0
    if piece is not None:
        held.append((piece.key, piece.order, None, piece.cut()))
        yield flush()


def _with_duplicates(faults: str, again: list[int] | None) -> str:
    if not again:
        return faults
    out = list(faults)
    for at in again:
        out[at] = DUPLICATE
    return "".join(out)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, piece, matrix): the cost from each state before a piece to each one after it."""
    for batch in batches:
        out = []
        for initials, faults, again in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
            faults = _with_duplicates(faults, again)
            ends = [[0 if s == e else INFINITE for s in range(4)] for e in range(4)]
            found = [costs_to_go(initials, faults, end)[0] for end in ends]
            out.append([found[e][s] for s in range(4) for e in range(4)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, type=pa.list_(pa.int64()))], names=["key", "piece", "matrix"])


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece, after, cost, last) of pieces in falling order: the costs to go after each, and from nothing before it."""
    key, ahead, begun = None, list(END), False
    for batch in batches:
        out: list[tuple] = []
        for own, piece, matrix in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            last = not begun or own != key
            if last:
                key, ahead, begun = own, list(END), True
            after = ahead
            ahead = [min(min(matrix[4 * s + e] + after[e] for e in range(4)), INFINITE) for s in range(4)]
            out.append((piece, after, ahead[NOTHING], last))
        types = (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.bool_())
        columns = [pa.array([r[i] for r in out], type=t) for i, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays(columns, names=["piece", "after", "cost", "last"])


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, piece, to): the state after a piece, by the state before it."""
    for batch in batches:
        out = []
        for initials, faults, again, after, last in zip(*(batch.column(i).to_pylist() for i in range(2, 7)), strict=True):
            faults = _with_duplicates(faults, again)
            costs = costs_to_go(initials, faults, after)
            out.append([walk(initials, faults, costs, s, last)[1] if costs[0][s] < INFINITE else s for s in range(4)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, type=pa.list_(pa.int64()))], names=["key", "piece", "to"])


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece, state) of pieces in order: the state before each."""
    key, state, begun = None, NOTHING, False
    for batch in batches:
        out = []
        for own, piece, to in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if not begun or own != key:
                key, state, begun = own, NOTHING, True
            out.append((piece, state))
            state = to[state]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=pa.int64()) for i in range(2)], names=["piece", "state"])


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece's own share of the result."""
    for batch in batches:
        names = ("initials", "faults", "roles", "texts", "again", "after", "last", "state")
        out = []
        for row in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True):
            initials, faults, roles, texts, again, after, last, state = row
            faults = _with_duplicates(faults, again)
            edits, _ = walk(initials, faults, costs_to_go(initials, faults, after), state, last)
            counts = [faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), illegal(initials)]
            ends = [initials[0], initials[-1]] if initials else [None, None]
            out.append((*counts, *ends, "".join(e[0] for e in edits), turns(edits, roles, texts)))
        types = (*(pa.int64(),) * 4, *(pa.string(),) * 3, pa.list_(pa.string()))
        added = [pa.array([r[i] for r in out], type=t) for i, t in enumerate(types)]
        kept = [batch.column(batch.schema.get_field_index(n)) for n in ("key", "piece", "low", "high", "n_turns", "cost")]
        yield pa.RecordBatch.from_arrays([*kept, *added], names=[*_SHARE_NAMES])


_SHARE_NAMES = ("key", "piece", "low", "high", "n_turns", "cost", "blank", "duplicate", "truncated", "illegal", "first", "final", "audit", "turns")
_SHARE = (
    "piece long, low long, high long, n_turns long, cost long, blank long, duplicate long, truncated long, illegal long, first string, "
    "final string, audit string, turns array<string>"
)


class _Whole:
    """A conversation that is put together from its pieces, one after the other."""

    def __init__(self, key, cost: int):
        self.key, self.cost = key, cost
        self.low = self.high = self.final = None
        self.n_turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.audit: list[str] = []
        self.said: list[str] = []
        self.hash, self.any = hashlib.sha256(), False

    def add(self, low, high, n_turns, blank, duplicate, truncated, illegal_, first, final, audit, said) -> None:
        if low is not None:
            self.n_turns += n_turns - (self.high == low)
            self.low = low if self.low is None else self.low
            self.high = high
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        self.illegal += illegal_
        if first is not None:
            self.illegal += self.final is not None and self.final + first not in LEGAL
            self.final = final
        self.audit.append(audit)
        for turn in said:
            self.hash.update((("\n" if self.any else "") + turn).encode())
            self.any = True
        self.said += said

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.n_turns if self.n_turns else 0
        numbers = (gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost)
        result = dict(zip(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), numbers, strict=True))
        return self.key, result | {"audit": "".join(self.audit), "turns": self.said, "repaired_sha256": self.hash.hexdigest()}


def _together(batches: Iterator[pa.RecordBatch], with_turns: bool) -> Iterator[pa.RecordBatch]:
    """Pieces in order to whole conversations; the hash is fed piece by piece."""
    whole, kind = None, None

    def given(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], type=kind), pa.array([r[1] for r in rows], type=_RESULT_TYPE)], names=["key", "result"])

    for batch in batches:
        kind, done = batch.schema.field(0).type, []
        for row in zip(*(batch.column(i).to_pylist() for i in range(len(_SHARE_NAMES))), strict=True):
            key, _, low, high, n_turns, cost, *rest = row
            if whole is None or whole.key != key:
                if whole is not None:
                    done.append(whole.row())
                whole = _Whole(key, cost)
            whole.add(low, high, n_turns, *rest)
            if not with_turns:
                whole.said = []
        if done:
            yield given(done)
    if whole is not None:
        yield given([whole.row()])


def repair(
    said: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", times: str | None = None,
    with_turns: bool = True, piece_rows: int = PIECE_ROWS, piece_chars: int = PIECE_CHARS,
) -> DataFrame:
    """Faults of every conversation, and its cheapest repair.

    Returns key, gaps, blank, duplicate, truncated, illegal, cost, audit, turns (the repaired ``role:text`` in order;
    null unless ``with_turns``) and repaired_sha256 (of the turns, joined by newlines). Rows are taken by turn, null
    first; of one turn by the first 64 characters of role and text, then by their hash. A null role or text counts as
    one space, an empty role has no initial that fits; null keys are one conversation. ``times`` names a column of how often a row occurs: a conversation of
    rows that occur 0 times has zeros, an empty audit and the hash of nothing. Repeated rows are duplicates of the
    first. Other columns are not read; an empty table gives no rows.

    Texts are shuffled once, by ranges of the order, so that one very long conversation is dealt out too; equal rows
    are spread by their number. Pieces have ``piece_rows`` rows and ``piece_chars`` characters at most, but for one row that is
    longer. What is put in a row for one conversation is a matrix and a state a piece, and for the hash, which no two
    tasks can share, its text, streamed.
    """
    spark = said.sparkSession
    ship(spark)
    kind = said.schema[key].dataType.simpleString()
    often = F.lit(1) if times is None else F.col(f"`{times}`")
    rows = said.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{turn}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"), often.cast("int").alias("times"),
    )
    # Long texts would make range bounds that the driver holds long.
    heads = [F.substring("role", 1, 64).alias("r"), F.substring("text", 1, 64).alias("t"), F.xxhash64("role", "text").alias("h")]
    rows = rows.select("*", *heads, F.monotonically_increasing_id().alias("no"))
    order = [F.col(c).asc_nulls_first() for c in ("key", "turn", "r", "t", "h", "no")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "turn", "role", "text", "times")
    scratch = Scratch(spark)
    first = dealt.mapInArrow(lambda b: _cut(b, piece_rows, piece_chars, with_turns), f"key {kind}, piece long, result struct<{_struct(_RESULT)}>, part struct<{_struct(_PIECE)}>")
    table = scratch.keep(first, "first")
    whole = table.where("result IS NOT NULL").select("key", "result")
    pieces = table.where("result IS NULL").select("key", "piece", "part.*")

    # A row is a duplicate too if an earlier piece has it.
    listed = F.arrays_zip("hashes", F.split("faults", "").alias("fault"))
    shown = pieces.select("key", "piece", F.posexplode(listed).alias("at", "row")).select("key", "piece", "at", "row.hashes", "row.fault")
    shown = shown.where(F.col("fault").isin(CUT, SOUND)).drop("fault")
    earliest = shown.groupBy("key", "hashes").agg(F.min("piece").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    earliest = scratch.keep(earliest.select(F.col("key").alias("k"), F.col("hashes").alias("h"), "first"), "earliest")
    met = shown.join(earliest, F.col("key").eqNullSafe(F.col("k")) & (F.col("hashes") == F.col("h")))
    again = met.where("piece > first").groupBy("piece").agg(F.collect_list("at").alias("again"))
    again = scratch.keep(again, "again")

    marked = pieces.select("key", "piece", "initials", "faults").join(again, "piece", "left").select("key", "piece", "initials", "faults", "again")
    matrices = marked.mapInArrow(_matrices, f"key {kind}, piece long, matrix array<bigint>")
    fall = matrices.repartition("key").sortWithinPartitions(F.col("key").asc_nulls_first(), F.desc("piece"))
    ends = scratch.keep(fall.mapInArrow(_backward, "piece long, after array<bigint>, cost long, last boolean"), "ends")
    given = marked.join(ends, "piece").select("key", "piece", "initials", "faults", "again", "after", "last")
    passages = given.mapInArrow(_passages, f"key {kind}, piece long, to array<bigint>")
    rise = passages.repartition("key").sortWithinPartitions(F.col("key").asc_nulls_first(), "piece")
    states = scratch.keep(rise.mapInArrow(_forward, "piece long, state long"), "states")
    full = pieces.drop("hashes").join(again, "piece", "left").join(ends, "piece").join(states, "piece")
    shares = full.mapInArrow(_repairs, f"key {kind}, {_SHARE}")
    in_order = shares.repartition("key").sortWithinPartitions(F.col("key").asc_nulls_first(), "piece")
    joined = in_order.mapInArrow(lambda b: _together(b, with_turns), f"key {kind}, result struct<{_struct(_RESULT)}>")
    out = whole.unionByName(joined).select(F.col("key").alias(key), "result.*")
    return out if with_turns else out.withColumn("turns", F.lit(None).cast("array<string>"))


def _struct(ddl: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (part.split(" ") for part in ddl.replace("long", "bigint").split(", ")))
