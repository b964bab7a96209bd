"""Chunks against a plain recursion over joined strings, by pages in rows and by whole documents."""

from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella import registry
from tessella.functions import python_text as P
from tessella.operators import ingest


def plain_split(text, target, marks):
    """Units joined one by one as long as they fit; longer units by the next mark."""
    if len(text) <= target:
        return [text]
    if not marks:
        return [text[i : i + target] for i in range(0, len(text), target)]
    units = text.split(marks[0])
    if len(units) == 1:
        return plain_split(text, target, marks[1:])
    found, line = [], ""
    for unit in units:
        joined = line + marks[0] + unit if line else unit
        if len(joined) <= target:
            line = joined
            continue
        found += [line] if line else []
        line = unit
        if len(unit) > target:
            found += plain_split(unit, target, marks[1:])
            line = ""
    return [x for x in [*found, line] if x.strip()]


def plain_chunks(page, target, overlap, least):
    page = (page or "").strip()
    if not page:
        return []
    merged = []
    for piece in plain_split(page, target, P.SEPARATORS):
        if merged and len(piece) < least:
            merged[-1] += "\n" + piece
        else:
            merged.append(piece)
    if len(merged) > 1 and len(merged[0]) < least:
        merged[:2] = ["\n".join(merged[:2])]
    out = []
    for i, body in enumerate(merged):
        lead = ""
        if i and overlap > 0:
            tail = merged[i - 1][-overlap:]
            ends = [n for n in range(len(tail) - 1) if tail[n] in ".!?" and tail[n + 1].isspace()]
            if ends and ends[0] < len(tail) - 2:
                lead = tail[ends[0] + 1 :].strip()
            else:
                lead = (tail.split(" ", 1)[1] if " " in tail else tail).strip()
        out.append((f"{lead} {body}" if lead else body).strip())
    return [x for x in out if len(x) >= 20]


@settings(max_examples=400, deadline=None)
@given(
    st.lists(st.sampled_from(["alpha", "be", "c" * 37, ". ", "? ", "! ", "; ", ", ", " ", "\n", "\n\n", "\t", ".", "é"]), max_size=120).map("".join),
    st.sampled_from([5, 30, 60]), st.sampled_from([0, 8, 25]), st.sampled_from([0, 10, 25]),
)
def test_chunks_of_a_page_equal_the_recursion(page, target, overlap, least):
    assert P.chunk_page(page, target, overlap, least) == plain_chunks(page, target, overlap, least)


def numbered(pages, *options):
    """{(document, chunk_index): (page, text)} of {document: [(page, text)]}."""
    found = {}
    for document, own in pages.items():
        texts = [(page, c) for page, text in own for c in plain_chunks(text, *options)]
        found |= {(document, i): x for i, x in enumerate(texts)}
    return found


def test_pages_in_rows_and_whole_documents(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice(["word ", "more. ", "line\n", "part\n\n", "é, "]) for _ in range(n))
    # One document has most of the pages, so it spans ranges; one has none that is long enough, one is null.
    pages = {"hot": [(i, text(rng.randint(0, 60))) for i in range(1, 301)], "none": [(1, " x "), (2, None)], None: [(1, text(80)), (2, ""), (3, text(90))]}
    pages |= {f"d{i}": [(p, text(40)) for p in range(1, rng.randint(1, 4) + 1)] for i in range(30)}
    rows = [(d, p, t, "extra") for d, own in pages.items() for p, t in own]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "document string, page int, text string, chunk_index string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ingest.chunks(frame, 60, 20, 15).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected = numbered(pages, 60, 20, 15)
    assert len(got) == len(expected)
    assert {(r["document"], r["chunk_index"]): (r["page"], r["text"]) for r in got} == expected
    assert all(r["token_estimate"] == -(-len(r["text"]) // 4) for r in got)
    whole = spark.createDataFrame([(d, [t for _, t in own]) for d, own in pages.items()] + [("null", None)], "document string, pages array<string>")
    got = ingest.document_chunks(whole, 60, 20, 15).collect()
    assert {(r["document"], r["chunk_index"]): (r["page"], r["text"]) for r in got} == expected
    assert ingest.chunks(frame.limit(0)).count() == 0 and ingest.document_chunks(whole.limit(0)).count() == 0


def test_repeated_pages_are_numbered_alike(spark):
    rows = [("d", 1, "a text that is long enough"), ("d", 1, "a text that is long enough"), ("d", 1, "another text, long enough too")]
    frame = spark.createDataFrame(rows, "document string, page int, text string")
    first, second = (sorted(map(tuple, ingest.chunks(f).collect())) for f in (frame, frame.repartition(3)))
    assert first == second and [r[2] for r in sorted(first, key=lambda r: r[2])] == [0, 1, 2]


def test_queries_equal_the_recursion(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = registry.queries()["chunk_documents"](spark, sf_dir).collect()
    assert {(r["document"], r["chunk_index"]): (r["page"], r["text"]) for r in got} == numbered({d: [(1, t)] for d, t in texts}, 500, 100, 80)
    turns = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn", F.xxhash64("text")).collect():
        turns.setdefault(r["conv_id"], []).append((r["turn"], r["text"]))
    got = registry.queries()["chunk_conversations"](spark, sf_dir).collect()
    expected = numbered(turns, 120, 30, 20)
    assert len(got) == len(expected)
    assert {(r["document"], r["chunk_index"]): (r["page"], r["token_estimate"]) for r in got} == {k: (p, -(-len(t) // 4)) for k, (p, t) in expected.items()}
