"""Line deduplication, turn repair and periodic runs against plain forms."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from tessella.llm import linededup, periods, queries, turns
from tessella.llm.common import read
from tests.llm.helpers import DOCS, docs_of

BLANKS = " \t\n\x0b\x0c\r"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- line deduplication


def plain_lines(rows, chars=20, docs=3):
    """(key, n_lines, n_dropped, kept) of each (key, text)."""
    split = [(k, (t or "").split("\n")) for k, t in rows]
    key_of = lambda line: line.strip(BLANKS).translate(UPPER)
    rank = lambda k: -float("inf") if k is None else k
    held = defaultdict(list)
    for k, lines in split:
        for line in {key_of(x) for x in lines}:
            held[line].append(rank(k))
    lost = {line: max(ks) for line, ks in held.items() if len(line) >= chars and len(ks) >= docs}
    out = []
    for k, lines in split:
        kept = [x for x in lines if rank(k) >= lost.get(key_of(x), -float("inf"))]
        out.append((k, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def dropped(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in df.collect()), key=repr)


LONG = "This line is certainly long enough"


def test_common_lines_stay_in_the_largest_document(spark):
    rows = [
        (1, f"{LONG}\nonly one here"), (2, f"a\n  {LONG.upper()}\t\nb"), (3, f"{LONG}\n{LONG}\nc"), (4, None), (5, ""), (6, "\n"),
        (7, "in two documents only, twice\nin two documents only, twice"), (8, "in two documents only, twice"),
        (9, "short"), (10, "short"), (11, "short"), (None, f"x\n{LONG}"), (-3, f"{LONG}\r\nInside\r\n"),
    ]
    assert dropped(linededup.drop_common_lines(docs_of(spark, rows))) == plain_lines(rows)


def test_repeated_rows_and_null_keys_all_count(spark):
    rows = [(1, LONG)] * 3 + [(2, LONG + "!")] * 2 + [(None, LONG + "?")] * 3 + [(5, f"{LONG}\n{LONG}?")] * 2
    assert dropped(linededup.drop_common_lines(docs_of(spark, rows))) == plain_lines(rows)


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (5, 2), (7, 3)])
def test_batches_and_merges_do_not_matter(spark, batches, fanout):
    rng = random.Random(batches)
    lines = [f"line number {i} of a shared passage" for i in range(25)] + ["brief", "", "  "]
    rows = [(rng.randrange(60), "\n".join(rng.choices(lines, k=rng.randrange(12)))) for _ in range(90)]
    got = linededup.drop_common_lines(docs_of(spark, rows), batches=batches, fanout=fanout)
    assert dropped(got) == plain_lines(rows)


def test_runs_are_levelled_and_hold_each_hash_once(spark):
    store = linededup.LineRuns(spark, fanout=2)
    for batch in range(5):
        lines = spark.range(batch * 40, batch * 40 + 60).select(F.lit(batch).alias("key"), F.explode(F.array("id", "id")).alias("id")).distinct()
        hits = store.add(lines.select("key", F.xxhash64("id").alias("h1"), F.col("id").alias("h2")))
        assert hits.where("NOT fresh").count() == (20 if batch else 0)
    assert [len(level) for level in store.levels] == [1, 0, 1]
    held = [r.h2 for name in store.runs() for r in store._content(name).collect()]
    assert sorted(held) == list(range(220))
    plan = store.spark.table(store.runs()[0]).join(store.spark.table(store.runs()[1]), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    store.close()


def test_string_keys_clashing_columns_and_empty_tables(spark):
    schema = "doc_id string, text string, row string, lost string, lines int, n_lines int, `odd.name` int"
    docs = spark.createDataFrame([(c, LONG, "r", "l", 1, 9, 7) for c in "abcd"], schema)
    got = linededup.drop_common_lines(docs)
    assert got.columns == ["doc_id", "text", "row", "lost", "lines", "odd.name", "n_lines", "n_dropped", "kept_text"]
    assert {r.doc_id: (r.n_dropped, r.row, r["odd.name"]) for r in got.collect()} == {"a": (1, "r", 7), "b": (1, "r", 7), "c": (1, "r", 7), "d": (0, "r", 7)}
    assert linededup.drop_common_lines(docs.where("false")).count() == 0


def test_a_very_long_text_and_a_very_frequent_line(spark):
    long = "\n".join(f"{LONG} {i % 5000}" for i in range(30_000))
    rows = [(i, LONG + " 7") for i in range(500)] + [(1000, long), (1001, long + "\nx"), (1002, long)]
    assert dropped(linededup.drop_common_lines(docs_of(spark, rows))) == plain_lines(rows)


# --- turn repair


def plain_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of one conversation's (turn, role, text)."""
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    faults, seen = [], []
    for _, role, text in rows:
        bare = text.strip(BLANKS)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.append((role, text))
    roles = [r[:1] for _, r, _ in rows]
    bad = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))

    def fits(so_far, initial):
        return initial != "" and (so_far + initial in ("s", "u") or initial == ("u" if so_far[-1:] in ("s", "a") else "a" if so_far[-1:] == "u" else ""))

    @lru_cache(None)
    def best(i, last, inserted):
        """(cost, audit, turns) from row i on, after a turn with this initial."""
        found = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        if inserted < 3:
            for role in ("user", "assistant"):
                if fits(last, role[0]):
                    c, a, t = best(i, role[0], inserted + 1)
                    found.append((c + 3, "I" + a, (role + ":", *t)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, t = best(i + 1, last, 0)
            found.append((c + 4, "D" + a, t))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                for name, cost, new in (("K", 0, role), ("R", 3, "user"), ("R", 3, "assistant")):
                    if fits(last, new[:1]):
                        c, a, t = best(i + 1, new[:1], 0)
                        found.append((c + cost + more, name + a, (f"{new}:{text}", *t)))
        return min(found, default=(10**9, "", ()))

    for i in range(len(rows), 0, -1):  # so that the recursion stays flat
        for last in ("", "s", "u", "a"):
            best(i, last, 0)
    cost, audit, said = best(0, "", 0)
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), bad, cost, audit, sha("\n".join(said)))


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def plain_conversations(rows):
    """Results by conversation of (conv, turn, role, text, times)."""
    by = defaultdict(list)
    for conv, turn, role, text, times in rows:
        by[conv] += [(turn, role if role is not None else " ", text if text is not None else " ")] * times
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    return {conv: plain_repair(tuple(sorted(said, key=order))) for conv, said in by.items()}


def given(df, key="conv_id"):
    return {r[key]: tuple(r[n] for n in NAMES) for r in df.collect()}


SAID = "conv_id long, turn long, role string, text string, times int"


def some_rows(rng, convs, most):
    texts = ["Yes.", "No!", "Why?", "It stops", "  ", "", None, "One. Two", "End. \n", "Ünd ß?"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User", "support"]
    return [
        (conv, turn, rng.choice(roles), f"{rng.choice(texts)}" if rng.random() < 0.3 else f"T{turn} {rng.choice(texts)}", rng.choice([0, 1, 1, 1, 2]))
        for conv in convs
        for turn in sorted(rng.sample([None, *range(3 * most)], rng.randrange(1, most)), key=lambda t: (t is not None, t or 0))
    ]


@pytest.mark.parametrize("piece_rows", [2_000, 3, 1])
def test_repair_equals_plain_search(spark, piece_rows):
    rng = random.Random(piece_rows)
    rows = some_rows(rng, [None, *range(60)], 14)
    got = turns.repair(spark.createDataFrame(rows, SAID).repartition(3), times="times", piece_rows=piece_rows)
    assert given(got) == plain_conversations(rows)
    for r in got.collect():
        assert sha("\n".join(r.turns)) == r.repaired_sha256


def test_query_equals_plain_search(spark, sf_dir):
    rows = []
    original = read(spark, sf_dir, "conversations").collect()
    for r in original:
        code = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        role, text = "user" if code == 4 else r.role, "" if code == 1 else re.sub("[.!?]", "", r.text) if code == 2 else r.text
        rows.append((r.conv_id, r.turn, role, text, {0: 0, 3: 2}.get(code, 1)))
    got = given(queries.op12_turn_repair(spark, sf_dir))
    assert got == plain_conversations(rows)
    assert set(got) == {r.conv_id for r in original}


def test_one_long_conversation_is_dealt_out(spark):
    rng = random.Random(1)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"{rng.randrange(900)} said{rng.choice('.,')}", 1) for t in range(700)]
    rows += [(8, 1, "user", "Same.", 1)] * 400 + [(9, 1, "user", "x" * 200_000 + ".", 1), (9, 2, "assistant", "y" * 300_000, 1)]
    got = turns.repair(spark.createDataFrame(rows, SAID).repartition(4), times="times", piece_rows=100, piece_chars=50_000)
    assert given(got) == plain_conversations(rows)


def test_odd_conversations(spark):
    schema = "conv_id string, turn int, role string, text string, audit string, key int, piece int"
    rows = [("a", 1, "user", "Hi.", "x", 1, 1), ("a", 2, "assistant", "Ho.", "x", 1, 1), ("b", None, None, None, "x", 1, 1)]
    got = given(turns.repair(spark.createDataFrame(rows, schema)))
    assert got["a"] == (0, 0, 0, 0, 0, 0, "KK", sha("user:Hi.\nassistant:Ho."))
    assert got["b"] == (0, 1, 0, 0, 0, 4, "D", sha(""))
    assert turns.repair(spark.createDataFrame([], schema)).count() == 0
    gone = turns.repair(spark.createDataFrame([(1, 1, "user", "Hi.", 0)], SAID), times="times")
    assert given(gone) == {1: (0, 0, 0, 0, 0, 0, "", sha(""))}


# --- periodic runs


def plain_runs(words):
    """(start, length, period) of every run, from the definition."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_row(words):
    found = plain_runs(words)
    lost = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    return (
        len(found), *best, 1000 * best[1] // best[2] if found else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in lost)),
    )


def shown(r):
    return (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)


def test_periods_query_equals_the_definition(spark, sf_dir):
    want = {}
    for r in read(spark, sf_dir, "documents").collect():
        words = WORDS.findall(r.text or "")
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n < 1_500:
            want[r.doc_id] = plain_row(words)
    got = {r.doc_id: shown(r) for r in queries.op13_periodic_runs(spark, sf_dir).collect()}
    assert {k: got[k] for k in want} == want
    assert sum(r[0] > 0 for r in want.values()) > 5


def test_runs_of_few_words_equal_the_definition():
    rng = random.Random(3)
    texts = [[rng.choice([b"a", b"b"]) for _ in range(rng.randrange(60))] for _ in range(300)]
    texts += [[b"a"] * n for n in range(12)] + [[b"a", b"b", b"c"] * 4 + [b"a"], ([b"a"] * 5 + [b"b"]) * 4, ([b"a"] * 6 + [b"b"]) * 5]
    assert periods.runs(texts) == [plain_runs(t) for t in texts]


def test_deceived_hashes_are_found_out():
    rng = random.Random(5)
    texts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(200)] for _ in range(20)]
    want = [plain_runs(t) for t in texts]
    prime, bases = periods._PRIME, periods._BASES
    try:
        periods._PRIME, periods._BASES = 61, (2, 3)  # so small that other words have equal hashes
        assert periods.runs(texts) == want
    finally:
        periods._PRIME, periods._BASES = prime, bases


def test_odd_texts_have_defined_runs(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a a a a a"), (5, "a a a a a a"), (5, "a a a a a a"), (None, "x y " * 4), (6, "é ß  " * 9)]
    got = periods.find(docs_of(spark, rows)).collect()
    by = {(r.doc_id, r.n_words): (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.collapsed) for r in got}
    assert len(got) == 8
    assert by[1, 0] == by[2, 0] == by[3, 0] == (0, None, None, None, None, "")
    assert by[4, 5] == (0, None, None, None, None, "a a a a a")
    assert by[5, 6] == (1, 0, 6, 1, 6000, "a")
    assert by[None, 8] == (1, 0, 8, 2, 4000, "x y")
    assert by[6, 18] == (1, 0, 18, 2, 9000, "é ß ")
    clash = spark.createDataFrame([(1, "a b " * 5, "n", 3)], "doc_id long, text string, n_runs string, runs int")
    assert periods.find(clash).collect()[0].n_runs == 1
    assert periods.find(spark.createDataFrame([], DOCS)).count() == 0


def test_a_very_long_text_is_searched_whole():
    rng = random.Random(9)
    words = [str(rng.randrange(40_000)).encode() for _ in range(150_000)]
    words[60_000:60_000 + 4 * 7_000] = words[60_000:67_000] * 4
    words[149_000:150_000] = [b"z"] * 1_000
    found = periods.runs([[b"q"] * 6, words])
    assert found[0] == [(0, 6, 1)]
    assert (149_000, 1_000, 1) in found[1]
    assert any(q == 7_000 and s <= 60_000 and s + n >= 88_000 for s, n, q in found[1])
