from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import python_text as P
from tessella.functions import text as T


def one(spark, expr, text):
    return spark.createDataFrame([(text,)], "t string").select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("where is my order A-1001?", ["1001", "a-1001"]),
        ("the top 5 products", ["5"]),
        ("mail Test@Example.com please", ["test@example.com"]),
        ("hello there", []),
        ('he said "Big Deal" twice, "Big Deal"', ['"big deal"']),
        ("é12 and 3,000.", ["12", "3,000"]),
    ],
)
def test_identifiers(spark, text, expected):
    assert one(spark, T.identifiers("t"), text) == expected


def test_redaction_order(spark):
    text = "me@x.org 4111 1111 1111 1111 +91 98765 43210 ABCDE1234F"
    assert one(spark, T.redact("t"), text) == "[email] [card] [phone] [pan]"
    assert one(spark, T.redact("t"), "nothing to hide here") == "nothing to hide here"
    assert one(spark, T.redact("t"), None) is None


def test_capture_modes(spark):
    long = "a" * 4001
    assert one(spark, T.captured(F.col("t"), "none"), long) is None
    assert one(spark, T.captured(F.col("t"), "full"), long) == "a" * 4000 + "…[truncated]"
    assert one(spark, T.captured(F.col("t"), "redacted"), "x me@x.org") == "x [email]"
    assert one(spark, T.captured(F.col("t"), "full"), "") is None


def test_clean_text(spark):
    assert one(spark, T.clean_text("t"), " oﬃ ﬁnd entitle-\nment  of \t leave \n\n\n\nnext ") == "oﬃ find entitlement of leave\n\nnext"


def test_confidence(spark):
    got = one(spark, T.split_confidence("t"), "Yes.\nconfidence: high \n")
    assert (got["answer"], got["confidence"], got["followed_format"]) == ("Yes.", "HIGH", True)
    assert one(spark, T.split_confidence("t"), "Yes.")["confidence"] == "LOW"
    assert one(spark, T.split_confidence("t"), None)["followed_format"] is False


def test_model_output_parsing(spark):
    assert one(spark, T.strip_fences("t"), '```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, T.json_payload("t"), 'sure: {"a": {"b": 2}} done') == '{"a": {"b": 2}}'
    assert one(spark, T.json_payload("t"), "no object") == "no object"
    assert one(spark, T.retry_after_ms("t"), "please try again in 6.168s") == 6418
    assert one(spark, T.retry_after_ms("t"), "later") is None
    assert one(spark, T.safe_filename("t"), "../a/b:c*d.pdf") == "..abcd.pdf"


def test_facts(spark):
    assert one(spark, T.facts("t"), "12 days, code SEC-0001, 9:30, 12.") == ["12", "0001", "9:30", "sec-0001"]


def test_normalise(spark):
    got = one(spark, P.normalise("t"), "Until 31 March – “ok”  １")
    assert got == 'until 31 march - "ok" 1'
    assert P.normalised(None) == ""


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab .,;!?\n", max_size=400), st.integers(10, 60))
def test_splitting_keeps_words_and_sizes(text, target):
    pieces = P.split_text(text, target)
    assert all(len(p) <= target for p in pieces)
    letters = lambda s: re.sub("[^ab]", "", s)
    assert "".join(map(letters, pieces)) == letters(text)


def test_chunks_overlap_and_merge():
    page = "HEADING\n" + "First sentence here. " * 20 + "\n\n" + "Second part follows now. " * 20
    chunks = P.chunk_page(page, 200, 40, 30)
    assert all(len(c) <= 200 + 40 + 31 for c in chunks) and chunks[0].startswith("HEADING")
    assert P.chunk_page("short", 200) == [] and P.chunk_page(None) == [] and P.chunk_page("x" * 20, 200) == ["x" * 20]
    assert P.merge_small(["ab", "c" * 90, "d"], 80) == ["ab\n" + "c" * 90 + "\nd"]
    assert P.overlap_tail("One. Two words", 12) == "Two words" and P.overlap_tail("alpha beta", 7) == "beta"


@pytest.mark.parametrize(
    ("word", "stem"),
    [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("hoping", "hope"), ("agreed", "agre"), ("annual", "annual"),
     ("days", "dai"), ("employee", "employe"), ("leave", "leav"), ("many", "mani"), ("adjustment", "adjust"), ("controlling", "control"), ("sky", "sky")],
)
def test_stems(word, stem):
    assert P.stem(word) == stem


def test_chunks_of_a_page_by_value():
    assert P.split_text("aa bb. cc dd. ee", 9) == ["aa bb", "cc dd. ee"]
    assert P.split_text("\n\none\n\n\n\ntwo\n\nthree", 8) == ["one\n\n", "two", "three"]
    assert P.split_text("xxxxxxxxxx yy", 4) == ["xxxx", "xxxx", "xx", "yy"]
    assert P.split_text("x" * 10, 4) == ["xxxx", "xxxx", "xx"] and P.split_text("", 4) == [""]
    page = "First point here. Second point here.\nThird line of the page, which is long."
    assert P.chunk_page(page, 40, 12, 5) == ["First point here. Second point here.", "point here. Third line of the page, which is long."]


def test_upper_case_letter_by_letter(spark):
    given = ["chß", "éa5", "ﬁx", "ᾳŉ", "", None, "a😀b"]
    rows = spark.createDataFrame(list(enumerate(given)), "i int, t string").select("i", T.upper_each("t").alias("u")).collect()
    assert [r["u"] for r in sorted(rows, key=lambda r: r["i"])] == ["CHẞ", "ÉA5", "ﬁX", "ᾼŉ", "", None, "A😀B"]


def test_a_bound_value_is_in_the_plan_once(spark):
    from tessella.operators import answering

    df = spark.createDataFrame([('{"priority": "low"}',), ("no",), (None,)], "t string")
    found = df.select("t", answering.ticket_problems(F.col("t")).alias("p"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parseJson") + found._jdf.queryExecution().optimizedPlan().toString().count("parse_json") <= 1
    rows = {r["t"]: r["p"] for r in found.collect()}
    assert rows == {'{"priority": "low"}': ["category", "summary", "sentiment", "orderId", "requiresHumanReview"], "no": ["invalid JSON"], None: ["invalid JSON"]}
