from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import fingerprints, layout, pieces, repetition
from tests.llm.helpers import docs_of


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


@pytest.fixture(scope="module")
def library(vocabulary):
    """The public library's unigram model over the same pieces and scores."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(pieces.MODEL_PATH, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for i, piece in enumerate(proto.pieces):
        if piece.type == 1:
            piece.score = vocabulary.score[i]
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


def ids_of(text, vocabulary):
    return np.frombuffer(pieces.Encoder(vocabulary).encode(text), dtype=np.int32).tolist()


def test_encoding_equals_the_library(spark, sf_dir, vocabulary, library):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts += ["", " ", "  a  b ", "é😀▁x", "\n\na\t b", "a\x00b", "<s> <0x41>", "%%%%%%%", "Größe naïve ☃ 漢字かな"]
    total = lambda ids: sum(vocabulary.score[i] for i in ids)
    for text in texts:
        own, other = ids_of(text, vocabulary), library.encode(text)
        if total(own) > -(2**16):
            assert own == other
        else:
            # The library sums in single precision, which past this point is coarser than the scores' steps.
            assert total(own) >= total(other)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_round_trip_is_exact(text):
    v = test_round_trip_is_exact.__dict__.setdefault("v", pieces.load())
    assert pieces.decode_ids(ids_of(text, v), v.surface) == text.replace(pieces.MARK, " ")


def test_round_trip_frame(spark):
    rows = [(1, "Some text, and more."), (2, None), (3, ""), (4, "word " * 20000), (4, "word " * 20000)]
    docs = docs_of(spark, rows).selectExpr("*", "1 AS ids", "2 AS decoded")
    got = {r["doc_id"]: r for r in pieces.round_trip(docs).collect()}
    assert got[1]["decoded"] == "Some text, and more." and got[4]["decoded"] == "word " * 20000
    assert got[2]["ids"] == [] and got[3]["n_pieces"] == 0 and got[4]["n_pieces"] == len(got[4]["ids"])
    assert pieces.round_trip(docs.limit(0)).count() == 0


def brute_repeats(words, least):
    n = len(words)
    out = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return [x if x >= least else 0 for x in out]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40), max_size=8), st.integers(1, 6))
def test_longest_repeats(texts, least):
    expected = [x for t in texts for x in brute_repeats(t, least)]
    assert repetition.longest_repeats(texts, least).tolist() == expected


def brute_counts(text):
    words = (text or "").encode().split()
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (
        len(words),
        sum(len(w.decode()) for w in words),
        sum((text or "").count(c) for c in "#*$%&|<>"),
        sum(x in lines[:i] for i, x in enumerate(lines)),
        len(repeated),
    )


def test_repetition_counts_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in repetition.judge(docs).collect():
        counts = brute_counts(texts[r["doc_id"]])
        assert counts == (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert r["base_failed"] == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
        assert not (r["base_failed"] and r["kept"])


def test_repetition_of_odd_texts(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, "a b c"), (4, "x\u00a0y " * 12), (5, " ".join(f"u{i}" for i in range(900)) + f" {long} mid {long}"), (6, " ".join(f"u{i}" for i in range(50)))]
    got = {r["doc_id"]: r for r in repetition.judge(docs_of(spark, rows).selectExpr("*", "1 AS n_words", "2 AS kept")).collect()}
    assert got[1]["n_words"] == 0 and got[1]["base_failed"] and not got[2]["kept"]
    assert got[4]["n_words"] == 12 and got[4]["longest_repeat"] == 11
    assert not got[5]["base_failed"] and not got[5]["kept"] and got[5]["longest_repeat"] == 60
    assert got[6]["kept"]
    assert repetition.judge(docs_of(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=80), st.sets(st.integers(0, 2**64 - 1), max_size=80), st.integers(0, 40))
def test_peeling_recovers_the_difference(a, b, shared):
    common = {k * 7919 + 11 for k in range(shared)}
    first, second = fingerprints.Sketches(sorted(a | common)), fingerprints.Sketches(sorted(b | common))
    left, right = fingerprints.difference(first, second)
    assert left == (a | common) - (b | common) and right == (b | common) - (a | common)


def test_fingerprints_follow_each_other(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    old, fingerprints.BLOCK_ROWS = fingerprints.BLOCK_ROWS, 30
    try:
        got = {r["doc_id"]: r for r in fingerprints.compare(docs).collect()}
    finally:
        fingerprints.BLOCK_ROWS = old
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest() and got[i]["n_chars"] == len(text)
        for name, other in (("near_edited", new), ("near_next", following)):
            a, b = set(fingerprints.digests(text)), set(fingerprints.digests(other))
            assert got[i][name] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    mean = lambda name: sum(r[name] for r in got.values()) / len(got)
    assert mean("near_edited") > 0.2 > 0.05 > mean("near_next")


def test_fingerprints_of_odd_tables(spark):
    one = fingerprints.compare(docs_of(spark, [(5, "a. b. c. d")])).collect()[0]
    assert one["near_next"] == 1.0 and one["n_chars"] == 10
    rows = [(None, None), (1, ""), (2, "x. y."), (2, "x. y."), (3, "word " * 30000), (4, "z")]
    got = fingerprints.compare(docs_of(spark, rows).selectExpr("*", "1 AS key", "2 AS block", "3 AS look")).collect()
    assert len(got) == 6 and len({r["fingerprint"] for r in got if r["n_chars"] == 5}) == 1
    assert fingerprints.compare(docs_of(spark, [])).count() == 0


def test_layout_of_blocks_lists_and_tables():
    page = (
        "<title>no</title><style>p{}</style><h1>Head&amp;</h1><p>one<p>two <b>bold</b>ed<br>line<ul><li>x<li>y<ol start=3><li>i</ol></ul>"
        "<table><tr><th>A<th>Long head<tr><td>1<td>2</table><div hidden>no</div><div style='display: none'>no<p>no</p></div>"
        "<pre> k\n  l</pre><!-- no --><script>var a='</p>';</script>end 1 < 2"
    )
    assert layout.text_of_page(page) == (
        "Head&\n\none\n\ntwo bolded\nline\n\n- x\n- y\n\n  3. i\n\nA  Long head\n1  2\n\n k\n  l\n\nend 1 < 2"
    )


def test_layout_loses_no_visible_word():
    rng = random.Random(4)
    tags = ["p", "div", "li", "ul", "td", "tr", "table", "b", "span", "section", "h2", "dd", "blockquote", "a"]
    for _ in range(200):
        parts, words = [], []
        for n in range(60):
            tag = rng.choice(tags)
            parts.append(rng.choice([f"<{tag}>", f"</{tag}>", f"<{tag} class='x'>"]))
            if rng.random() < 0.6:
                words.append(f"w{n}")
                parts.append(f" w{n} ")
        got = layout.text_of_page("".join(parts)).replace("-", " ").split()
        assert sorted(got) == sorted(words)


def test_layout_of_odd_pages(spark):
    rows = [(1, None), (2, ""), (3, "<a href='x>y"), (4, "<div>" * 50000 + "deep"), (5, "a <"), (6, "<p>x" * 20000)]
    pages = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "1 AS text", "'u' AS url")
    got = {r["page_id"]: r for r in layout.extract(pages).collect()}
    assert got[1]["text"] == "" and got[2]["n_lines"] == 0 and got[4]["text"] == "deep" and got[5]["text"] == "a <"
    assert got[6]["text"].count("x") == 20000
    assert layout.extract(pages.limit(0)).count() == 0


def test_many_units_at_once_equal_one_by_one(vocabulary):
    rng = np.random.default_rng(3)
    letters = np.array(list("aeinst,.\n\x00é漢🙂▁Z"))
    units = ["▁" + "".join(rng.choice(letters, size=n)) for n in rng.integers(0, 40, 3000)] + ["▁" + "abc" * 40, "▁", "▁▁▁x"]
    packed = vocabulary.lattice.encode([u.encode() for u in units])
    assert packed == [np.array(pieces.viterbi(u.encode(), vocabulary), dtype=np.int32).tobytes() for u in units]
    assert vocabulary.lattice.encode([]) == []


def test_hashed_texts_and_full_memory(spark, vocabulary, monkeypatch):
    rows = [(i, t) for i, t in enumerate([None, "", " ", "a  b", "one two two", " lead", "x▁y", "é" * 200, "two one"])]
    plain = {r["doc_id"]: r for r in pieces.round_trip(docs_of(spark, rows)).collect()}
    hashed = {r["doc_id"]: r for r in pieces.round_trip(docs_of(spark, rows), hashed=True).collect()}
    for i, t in rows:
        assert plain[i]["decoded"] == (t or "").replace(pieces.MARK, " ") and plain[i]["ids"] == hashed[i]["ids"]
        assert hashed[i]["decoded_sha256"] == hashlib.sha256(plain[i]["decoded"].encode()).hexdigest()
    monkeypatch.setattr(pieces, "REMEMBERED", 2)
    small = pieces.Encoder(vocabulary)
    for _ in range(3):
        for i, t in rows:
            assert small.encode(t) == np.array(plain[i]["ids"], dtype=np.int32).tobytes()


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("a<!-->visible<p>two", "avisible\n\ntwo"),
        ("a<!--->b<!-- > x --!>c<!-- open", "abc"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
        ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", "a  b\n   c\n   d"),
        ("<table><tr><td>a<td rowspan=2 colspan=2>b<td>c<tr><td>d<td>e</table>", "a  b  c\nd     e"),
        ("x <select><option>one<option selected>two</select> y <select><option>three<option>four</select>", "x two y three"),
        ("<select multiple><option>one<optgroup label=g><option>two</select>", "one two"),
        ("<textarea>a &amp;\n  b</textarea>", "a &\n  b"),
        ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>", "x=1"),
        ("<svg><title>no</title><g><text>label</text></g><defs><text>no</text></defs>no</svg>", "label"),
        ("<details><summary>more</summary>hidden</details><details open><summary>s</summary>shown</details>", "more\ns\nshown"),
        ("<style>/* x */ .a, p.b {color: red; display:none} @media print {.c{display:none}} #i{visibility:hidden}</style>"
         "<div class='x a'>no</div><p class=b>no</p><div class=b>yes</div><i class=c>also</i><b id=i>no</b>", "yes\nalso"),
        ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b><i>no</i></div>", "yes"),
        ("<ul style='visibility:hidden'><li>no<li><b style='visibility:visible'>yes</b></ul>", "- yes"),
        ("<div style='display:none'><b style='display:block'>no</b></div>end", "end"),
    ],
)
def test_layout_of_visibility_and_spans(page, text):
    assert layout.text_of_page(page) == text


def test_layout_of_deep_nesting():
    for tag in ("ul><li", "blockquote", "table><tr><td", "div", "details open"):
        assert layout.text_of_page(f"<{tag}>" * 700 + "deep").split()[-1] == "deep"
