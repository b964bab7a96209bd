from __future__ import annotations

import json
from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F

from tessella.functions import python_text as P
from tessella.operators import answering, cache, evals, retrieval, service

NOW = datetime(2024, 5, 1, 12)
ENTRY = "entry_id long, user_id string, v array<double>, entry_ids array<string>, created_at timestamp"


def entries(spark, rows):
    return spark.createDataFrame(rows, ENTRY)


def asked(spark, rows):
    return spark.createDataFrame(rows, "request_id long, user_id string, q array<double>, ids array<string>")


def test_requests_see_live_entries_of_their_tenant(spark):
    old, new = NOW - timedelta(seconds=cache.TTL_SECONDS), NOW - timedelta(seconds=1)
    held = entries(spark, [(1, None, [1.0, 0.0], [], new), (2, "u", [1.0, 0.0], [], old), (3, "u", [0.0, 1.0], ["a"], new), (4, "w", [1.0, 0.0], [], new)])
    rows = [(1, None, [1.0, 0.0], []), (2, "u", [1.0, 0.0], []), (3, "u", [0.0, 1.0], ["b"]), (4, "z", [1.0, 0.0], [])]
    got = {r["request_id"]: (r["hit"], r["reason"]) for r in cache.request(asked(spark, rows), held, F.lit(NOW)).collect()}
    assert got == {1: (True, "hit"), 2: (False, "below threshold"), 3: (False, "identifier guard"), 4: (False, "empty")}
    left, removed = cache.clear(held, "u")
    assert removed.first()["removed"] == 2 and {r["entry_id"] for r in left.collect()} == {1, 4}
    many = entries(spark, [(i, None, [1.0, 0.0], [], NOW - timedelta(seconds=i % 100)) for i in range(cache.CAPACITY + 40)])
    assert cache.newest(many).count() == cache.CAPACITY


def test_serving_order(spark):
    held = entries(spark, [(1, "u", [1.0], [], NOW)])
    rows = [(1, "u", [1.0], []), (2, "poor", [1.0], []), (3, "v", [1.0], []), (4, "v", [0.0], [])]
    more = spark.createDataFrame([(1, [], 5), (2, [], 5), (3, ["t"], 5), (4, None, 7)], "request_id long, tools_used array<string>, cost_nano long")
    spend = spark.createDataFrame([("poor", 10), ("v", 9)], "user_id string, spent_nano long")
    out = service.serve(asked(spark, rows).join(more, "request_id"), spend, held, F.lit(NOW), 10).collect()
    got = {r["request_id"]: (r["source"], r["reason"], r["cost_nano"], r["stored"]) for r in out}
    assert got == {1: ("cache", None, 0, False), 2: ("rejected", "budget", 0, False), 3: ("model", "empty", 5, False), 4: ("model", "empty", 7, True)}


def test_golden_cases_and_scores(spark, tmp_path):
    path = tmp_path / "cases.jsonl"
    cases = [{"id": "a", "expect": "answer", "must_contain": ["Grade 7", "5"], "expected_pages": [2]}, {"id": "b", "expect": "refuse", "known_failure": "x", "must_not_contain": ["ＮＯ"]}]
    path.write_text("\n".join(json.dumps(c) for c in cases))
    golden = service.golden_cases(spark, str(path))
    answers = spark.createDataFrame([("a", "GRADE  7 takes 15", True, [1, 2], None), ("b", "say no", None, None, "no_results")], "id string, answer string, grounded boolean, retrieved_pages array<int>, reason string")
    got = {r["id"]: r for r in evals.score_cases(golden.join(answers, "id"), P.normalise, P.normalise_all).collect()}
    assert got["a"]["passed"] and got["a"]["hit"] and got["a"]["failures"] == []
    assert got["b"]["behaviour"] == "true_refusal" and got["b"]["hit"] is None and got["b"]["failures"] == ["answer contains forbidden: ＮＯ"] and not got["b"]["fixed_known"]


def test_judges_that_cannot_be_read(spark):
    replies = ["", None, "[]", '{"claims": null, "verdict": "not_grounded"}', '{"claims": [], "verdict": "not_grounded"}', '{"claims": [{"claim": "c"}], "verdict": "fully_grounded"}']
    rows = spark.createDataFrame(list(enumerate(replies)), "id long, reply string").select("id", evals.groundedness(F.col("reply")).alias("g"))
    got = {r["id"]: (r["g"]["verdict"], r["g"]["score"]) for r in rows.collect()}
    assert got == {**{i: ("judge_failed", None) for i in (0, 1, 2, 3, 5)}, 4: ("not_grounded", 0.0)}


def test_own_order_without_status_is_found(spark):
    orders = spark.createDataFrame([(1, 7, None)], "order_id long, owner long, status string")
    calls = spark.createDataFrame([(1, 1, 7), (2, 1, 8)], "call_id long, order_id long, user_id long")
    got = {r["call_id"]: (r["found"], r["status"], r["reason"]) for r in answering.order_status(calls, orders).collect()}
    assert got == {1: (True, None, None), 2: (False, None, "no such order for this user")}


def test_vectors_of_several_lengths_meet_their_own(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, None), (5, [])], "id long, v array<double>")
    queries = spark.createDataFrame([(10, [1.0, 0.0]), (11, [1.0, 0.0, 0.0]), (12, []), (13, None)], "query_id long, q array<double>")
    got = {(r["query_id"], r["id"], r["similarity"]) for r in retrieval.knn(queries, corpus, 2).collect()}
    assert got == {(10, 1, 1.0), (10, 2, 0.0), (11, 3, 1.0)}


def test_small_columns(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(service.rupees(F.lit(123456789))) == "₹1234567.89" and one(service.rupees(F.lit(5))) == "₹0.05"
    assert one(service.names(F.lit(" a, ,b,"))) == ["a", "b"] and one(service.names(F.lit(None).cast("string"))) == []
    floats = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<float>")
    assert one(service.rows_of(floats(1, 2, 3, 4, 5), 2)) == [[1.0, 2.0], [3.0, 4.0]] and one(service.rows_of(floats(1), 2)) == []
    body = lambda raw, most=99: one(service.read_body(F.lit(raw).cast("string"), "a long", most))
    assert body('{"a": 1}')["body"]["a"] == 1 and body("")["body"]["a"] is None and body("{")["problem"] == "invalid JSON"
    assert body('{"a": 1}', 3)["problem"] == "too large" and body(None)["problem"] is None
    at = F.lit(datetime(2024, 2, 29, 7, 8, 9, 123000))
    assert one(service.iso_time(at)) == "2024-02-29T07:08:09.123Z" and one(service.http_time(at)) == "Thu, 29 Feb 2024 07:08:09 GMT"
    assert one(service.tracing_disabled(F.lit("000"))) and not one(service.tracing_disabled(F.lit("0a"))) and not one(service.tracing_disabled(F.lit(None).cast("string")))


def test_keyword_blocks_stems_and_odd_texts(spark):
    docs = spark.createDataFrame([(1, "The running dogs ran"), (2, "dog dog"), (3, None), (4, ""), (None, "dog"), (5, "cats"), (6, "dog dog")], "id long, text string")
    queries = spark.createDataFrame([(10, "a dog"), (11, "the"), (12, None), (13, "cat runs"), (14, "dogs cats")], "query_id long, text string")
    rows = lambda **o: {(r["query_id"], r["rank"], r["id"], r["score"]) for r in retrieval.keyword_top(queries, docs, 2, **o).collect()}
    two = round(0.1 * 1.25 / retrieval.ZETA2, 9)
    one = round(0.05 / retrieval.ZETA2, 9)
    assert rows() == {(10, 1, 2, two), (10, 2, 6, two), (14, 1, 1, one), (14, 2, 5, one)}
    assert rows(block=1) == rows()
    stemmed = rows(stemmed=True)
    assert {(q, i) for q, _, i, _ in stemmed} == {(10, 2), (10, 6), (13, 1), (13, 5), (14, 2), (14, 6)}
    assert retrieval.keyword_top(queries.limit(0), docs).count() == 0


def test_cases_on_letters_of_long_upper_case_give_the_sql(spark, tmp_path):
    from tessella.plans import service as plans

    texts = ["aß 5", "straße 5", "ẞxy 5", "Éß", None, "ﬁn 5", "ohne"]
    spark.createDataFrame([(i * 2, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("case_scores", "judge_override", "eval_totals", "eval_report"):
        got = plans.QUERIES[name](spark, str(tmp_path))
        expected = con.execute(f"SELECT {', '.join(got.columns)} FROM ({plans.SQL[name]})").fetchall()
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected)), name


def test_cases_with_blanks_and_letters_that_normalisation_would_change_give_the_sql(spark, tmp_path):
    """The string that is looked for begins an answer as it stands: a line feed, blanks at its ends, wide letters."""
    from tessella.plans import service as plans

    texts = ["A.\nAll rights 5", "a", " a  b 5", "Zu ", "a\t5", "\u00a0ab 5\u3000", "５５５ 5", "ΑΣ 5", "İx 5", "–—x 5", "“q” 5", "\x0bab 5", "x\x0b\n5", "ﬁx 5", "a\u20115 zq", None, ""]
    rows = [(60 * n + i, t) for n, t in enumerate(texts) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("case_scores", "judge_override", "case_diagnosis", "eval_totals", "eval_report"):
        got = plans.QUERIES[name](spark, str(tmp_path))
        expected = con.execute(f"SELECT {', '.join(got.columns)} FROM ({plans.SQL[name]})").fetchall()
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected)), name
