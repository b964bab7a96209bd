from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import answering, cache, evals, ingest, ledger, retrieval
from tessella.sources import files, models, sse


def test_fusion_counter_example(spark):
    v = spark.createDataFrame([(0, 3, 2, 0.5), (0, 2, 1, 0.9)], "query_id long, id long, rank int, similarity double")
    k = spark.createDataFrame([(0, 3, 2)], "query_id long, id long, rank int")
    got = {r["id"]: r for r in retrieval.fuse(v, k).collect()}
    assert round(got[3]["rrf_score"], 4) == 0.0323 and round(got[2]["rrf_score"], 4) == 0.0164
    assert got[3]["position"] == 1 and got[3]["found_by"] == "both" and got[2]["found_by"] == "vector"
    union = {r["id"]: r["rrf_score"] for r in retrieval.fuse_by_union([v, k]).collect()}
    assert union == {i: r["rrf_score"] for i, r in got.items()}


def test_knn_in_blocks_equals_one_block(spark):
    rows = [(i, [float((i * k) % 7 - 3) for k in range(1, 5)]) for i in range(60)]
    corpus = spark.createDataFrame([*rows, (100, None), (101, [1.0])], "id long, v array<float>").repartition(3)
    queries = spark.createDataFrame(rows[:10], "query_id long, q array<float>")
    one = {(r["query_id"], r["rank"]): (r["id"], r["similarity"]) for r in retrieval.knn(queries, corpus, 5).collect()}
    many = {(r["query_id"], r["rank"]): (r["id"], r["similarity"]) for r in retrieval.knn(queries, corpus, 5, block=3).collect()}
    assert one == many and len(one) == 50
    for i, q in rows[:10]:
        best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in rows if j != i)[:5]
        assert [one[i, n + 1] for n in range(5)] == [(j, -s) for s, j in best]


def test_query_terms_drop_stop_words(spark):
    asked = spark.createDataFrame([(1, "How many days of the annual leave"), (2, "the of and")], "id long, t string")
    got = retrieval.query_terms(asked, "id", "t").collect()
    assert {r["term"] for r in got} == {"how", "many", "days", "annual", "leave"} and all(r["n_terms"] == 5 for r in got)


def test_cache_guard(spark):
    req = spark.createDataFrame([(1, "u", [1.0, 0.0], ["5"]), (2, "u", [0.0, 1.0], ["5"]), (3, "w", [1.0, 0.0], ["5"])], "request_id long, user_id string, q array<double>, ids array<string>")
    ent = spark.createDataFrame([(7, "u", [0.933, 0.36], ["7"]), (8, "u", [0.9, 0.43], ["5"])], "entry_id long, user_id string, v array<double>, entry_ids array<string>")
    got = {r["request_id"]: r for r in cache.lookup(req, ent).collect()}
    assert got[1]["hit"] and got[1]["entry_id"] == 8 and got[1]["blocked"] == 1
    assert got[2]["reason"] == "below threshold" and got[3]["reason"] == "empty"
    only = {r["request_id"]: r for r in cache.lookup(req, ent.where("entry_id = 7")).collect()}
    assert not only[1]["hit"] and only[1]["reason"] == "identifier guard"
    n = cache.counters(cache.lookup(req, ent)).first()
    assert (n["lookups"], n["hits"], n["misses"]) == (3, 1, 2)


def test_cost_and_break_even(spark):
    calls = spark.createDataFrame([("openai/gpt-oss-20b", 348, 44), ("other", 10, None)], "model string, input_tokens long, output_tokens long")
    got = {r["model"]: r for r in ledger.priced(calls, ledger.prices(spark)).collect()}
    assert got["openai/gpt-oss-20b"]["nano_usd"] == 39300 and not got["openai/gpt-oss-20b"]["estimated"]
    assert got["other"]["estimated"] and got["other"]["nano_usd"] == 1000
    assert ledger.break_even((0.075, 0.3), (0.15, 0.6)) == {"cost_ratio": 0.5, "max_escalation_rate": 0.5}


def test_budget_overshoots_by_one_call(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    spend = spark.createDataFrame([("u", 1, at(1), 83400), ("u", 2, at(2), 83400), ("u", 3, at(3), 83400)], "user_id string, call_id long, ts timestamp, nano_usd long")
    assert [r["allowed"] for r in ledger.allowed_calls(spend, 50000, "call_id").orderBy("call_id").collect()] == [True, False, False]
    status = ledger.budget_status(ledger.daily_spend(spend.limit(1)), 50000).first()
    assert status["remaining"] == 0 and status["percent_used"] == 100 and not status["allowed"]


def test_span_tree(spark):
    rows = [("t", f"s{i}", f"s{i - 1}" if i else None) for i in range(9)] + [("t", "x", "gone"), ("u", "s0", None)]
    got = {(r["trace_id"], r["span_id"]): (r["depth"], r["root_id"]) for r in ledger.span_tree(spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string")).collect()}
    assert all(got["t", f"s{i}"] == (i, "s0") for i in range(9)) and got["t", "x"] == (0, "x") and got["u", "s0"] == (0, "s0")


def test_span_tree_of_any_depth(spark):
    rows = [("t", i, i - 1 if i else None) for i in range(150)] + [("u", i, i - 1) for i in range(1, 34)] + [("c", 1, 2), ("c", 2, 1), ("c", 3, 2), ("c", 4, None)]
    got = {(r["trace_id"], r["span_id"]): (r["depth"], r["root_id"]) for r in ledger.span_tree(spark.createDataFrame(rows, "trace_id string, span_id long, parent_span_id long")).collect()}
    expected = {("t", i): (i, 0) for i in range(150)} | {("u", i): (i - 1, 1) for i in range(1, 34)} | {("c", 4): (0, 4)}
    assert got == expected


def test_retrieval_scores(spark):
    rows = [([35], [234, 234, 39, 9, 39]), ([35, 34], [34, 1]), (None, [1]), ([7, 7], [1, 2, 7])]
    frame = spark.createDataFrame(rows, "e array<int>, r array<int>").select(evals.retrieval_scores(F.col("e"), F.col("r")).alias("s"))
    got = [r["s"] for r in frame.collect()]
    assert (got[0]["hit"], got[0]["coverage"], got[0]["reciprocal_rank"]) == (False, 0.0, 0.0)
    assert (got[1]["coverage"], got[1]["reciprocal_rank"], got[1]["missed"]) == (0.5, 1.0, [35]) and got[2] is None
    assert got[3]["found"] == [7, 7] and got[3]["reciprocal_rank"] == pytest.approx(1 / 3)


MEASURES = "false_accept_rate double, false_refusal_rate double, recall double, mrr double, coverage double"


def test_gate(spark):
    failed = evals.gate_verdict(evals.gate(spark.createDataFrame([(0.0, 0.2, 0.8, 0.8, 0.7)], MEASURES))).first()
    assert not failed["passed"] and failed["failed"] == ["coverage"]
    only_refuse = evals.gate_verdict(evals.gate(spark.createDataFrame([(0.0, None, None, None, None)], MEASURES))).first()
    assert only_refuse["passed"] and not only_refuse["fatal"]
    nothing = evals.gate_verdict(evals.gate(spark.createDataFrame([(None,) * 5], MEASURES))).first()
    assert nothing["fatal"] and not nothing["passed"]


def test_interleaving_counts_strictly_lower(spark):
    sims = [0.851, 0.806, 0.683, 0.6, 0.59, 0.58, 0.57, 0.56, 0.513]
    rows = [(i, "refuse" if s == 0.806 else "answer", s) for i, s in enumerate(sims)] + [(20, "answer", 0.806)]
    got = evals.interleaving(spark.createDataFrame(rows, "id long, expect string, best_similarity double")).first()
    assert got["blocks"] == 7


def test_interleaving_equals_all_pairs(spark):
    rng = random.Random(5)
    sims = [None, -0.0, 0.0, 0.25, *(rng.random() for _ in range(40))]
    rows = [(i, rng.choice(["refuse", "answer", None]), rng.choice(sims)) for i in range(600)]
    frame = spark.createDataFrame(rows, "id long, expect string, best_similarity double")
    got = {r["id"]: r["blocks"] for r in evals.interleaving(frame).collect()}
    answers = [s for _, e, s in rows if e == "answer" and s is not None]
    assert got == {i: sum(a < s for a in answers) if s is not None else 0 for i, e, s in rows if e == "refuse"}
    assert evals.interleaving(frame.limit(0)).count() == 0
    only = spark.createDataFrame([(1, "refuse", 0.5)], frame.schema)
    assert [r["blocks"] for r in evals.interleaving(only).collect()] == [0]


def plain_lookup(requests, entries, threshold):
    """Every pair, one after another."""
    out = {}
    for rid, user, q, ids in requests:
        own = [e for e in entries if (e[1] or "anon") == (user or "anon")]
        near = []
        for eid, _, v, eids in own:
            score = round(sum(a * b for a, b in zip(q, v, strict=True)), 9) if q and v and len(q) == len(v) else None
            if score is not None and score >= threshold:
                near.append((ids == eids, score, -eid))
        clean, vetoed = (max((n[1:] for n in near if n[0] is same), default=None) for same in (True, False))
        reason = "hit" if clean else "empty" if not own else "identifier guard" if vetoed else "below threshold"
        score, entry = clean or vetoed or (None, None)
        out[rid] = (clean is not None, reason, None if entry is None else -entry, score, sum(not n[0] for n in near))
    return out


def test_cache_lookup_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(11)
    vector = lambda: rng.choice([None, [], [1.0], [float(rng.randint(-2, 2)) / 2 for _ in range(3)]] + [[float(rng.randint(-2, 2)) / 2 for _ in range(3)] for _ in range(6)])
    ids = lambda: rng.choice([None, [], ["A-1"], ["A-1", "A-2"]])
    user = lambda: rng.choice(["hot", "hot", "hot", "u", None, "anon", f"s{rng.randint(0, 50)}"])
    requests = [(f"r{i}", user(), vector(), ids()) for i in range(80)]
    entries = [(i, user(), vector(), ids()) for i in range(400)]
    left = spark.createDataFrame(requests, "request_id string, user_id string, q array<double>, ids array<string>")
    right = spark.createDataFrame(entries, "entry_id long, user_id string, v array<double>, entry_ids array<string>")
    expected = plain_lookup(requests, entries, 0.5)
    assert {x[1] for x in expected.values()} == {"hit", "empty", "identifier guard", "below threshold"}
    for blocks in ((256, 1024, 16_384), (2, 3, 10)):
        for name, size in zip(("REQUEST_BLOCK", "ENTRY_BLOCK", "HELD_ROWS"), blocks, strict=True):
            monkeypatch.setattr(cache, name, size)
        got = {r["request_id"]: tuple(r)[1:] for r in cache.lookup(left, right, 0.5).collect()}
        assert got == expected
    assert {r["reason"] for r in cache.lookup(left, right.limit(0), 0.5).collect()} == {"empty"}
    assert cache.lookup(left.limit(0), right, 0.5).count() == 0


def test_judge(spark):
    rows = [([(True,), (False,)],), ([],), (None,)]
    got = spark.createDataFrame(rows, "c array<struct<supported boolean>>").select(evals.judge_score(F.col("c")).alias("x")).collect()
    assert [r["x"] for r in got] == [0.5, 0.0, None]


def test_tickets(spark):
    good = '{"priority": "high", "category": "billing", "summary": "long enough", "sentiment": "happy", "orderId": null, "requiresHumanReview": true, "more": 1}'
    rows = [(1, 1, "no json"), (1, 2, good.replace('"orderId": null, ', "")), (1, 3, "```json\n" + good + "\n```"), (2, 1, good.replace("true", '"yes"')), (3, 1, good.replace("null", '"A-1001"'))]
    frame = spark.createDataFrame(rows, "email_id long, attempt int, raw string")
    got = [r["p"] for r in frame.select(answering.ticket_problems(F.col("raw")).alias("p")).collect()]
    assert got == [["invalid JSON"], ["orderId"], [], ["requiresHumanReview"], []]
    loops = {r["email_id"]: (r["ok"], r["attempts"]) for r in answering.first_valid(frame).collect()}
    assert loops == {1: (True, 3), 2: (False, 1), 3: (True, 1)}


def test_order_status_denies_alike(spark):
    orders = spark.createDataFrame([("A-2007", "u_2", "shipped")], "order_id string, owner string, status string")
    calls = spark.createDataFrame([(1, "A-2007", "u_1"), (2, "A-2007", "u_2"), (3, "A-9", "u_1")], "call_id long, order_id string, user_id string")
    got = {r["call_id"]: r for r in answering.order_status(calls, orders).collect()}
    assert got[2]["found"] and not got[1]["found"] and got[1]["reason"] == got[3]["reason"]


def test_product_search_by_tag_and_cap(spark):
    rows = [("Standing desk", ["office"], 250000), ("Lamp", ["desk"], 9900), ("Chair", ["office"], 100)]
    found = answering.product_search(spark.createDataFrame(rows, "name string, tags array<string>, price long"), "DESK", 3000, 100)
    assert {r["name"] for r in found.collect()} == {"Standing desk", "Lamp"}


def test_running_headers(spark):
    pages = spark.createDataFrame([("d", i, f"ACME\nbody {'x' * i}\nmiddle\nPage {i} of 5") for i in range(1, 6)] + [("e", 1, "ACME\nz")], "document string, page int, text string")
    repeated = ingest.repeated_lines(pages)
    assert {(r["document"], r["key"]) for r in repeated.collect()} == {("d", "ACME"), ("d", "middle"), ("d", "Page # of #")}
    kept = {(r["document"], r["page"]): r["text"] for r in ingest.strip_repeated(pages, repeated).collect()}
    assert kept["d", 1] == "body x" and kept["e", 1] == "ACME\nz"


def test_glyph_lines(spark):
    rows = [("d", 1, 0, "a", 10.0, False), ("d", 1, 1, "b", None, False), ("d", 1, 2, "c", 11.0, False), ("d", 1, 3, "d", 40.0, True), ("d", 1, 4, "e", 60.0, False)]
    got = ingest.glyph_lines(spark.createDataFrame(rows, "document string, page int, seq int, str string, y double, has_eol boolean"))
    assert got.first()["text"] == "abc\nd\ne"


def test_sse(spark):
    body = ": hi\n\nevent: token\ndata: a\ndata: b\n\ndata: c\n\n\ndata: [DONE]\n\ndata: late\n\n"
    chunks = spark.createDataFrame([("s", i, body[i : i + 5]) for i in range(0, len(body), 5)], "stream_id string, seq int, chunk string")
    got = [(r["event"], r["data"]) for r in sse.parse(chunks).orderBy("position").collect()]
    assert got == [("token", "a\nb"), ("message", "c")]
    assert sse.parse(chunks, "").orderBy("position").first()["data"] == "ab"


def test_retry_rules(spark):
    rows = [(1, 0, None, 503), (3, 0, None, 503), (1, 4, None, 503), (1, 0, None, 400), (1, 0, "timeout", None)]
    frame = spark.createDataFrame(rows, "attempt int, tokens int, error string, status int")
    got = frame.select(sse.may_retry(*map(F.col, frame.columns)).alias("x"), sse.backoff_ceiling_ms(F.col("attempt")).alias("c")).collect()
    assert [r["x"] for r in got] == [True, False, False, False, True] and got[1]["c"] == 4000


def test_publish_follows_the_manifest(spark, tmp_path):
    a = spark.range(3)
    files.publish({"documents": a, "chunks": a}, str(tmp_path), "v1")
    files.publish({"documents": spark.range(5), "chunks": a}, str(tmp_path), "v2")
    spark.range(9).write.parquet(f"{tmp_path}/v3/documents")
    assert {n: t.count() for n, t in files.published(spark, str(tmp_path)).items()} == {"documents": 5, "chunks": 3}


def test_files_fail_one_by_one(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"one|two")
    (tmp_path / "b.pdf").write_bytes(b"bad")
    (tmp_path / "c.txt").write_bytes(b"no")

    def parse(content):
        if content == b"bad":
            raise ValueError("broken")
        return content.decode().split("|")

    listed = files.pdf_files(spark, str(tmp_path))
    assert {(r["filename"], r["problem"]) for r in listed.collect()} == {("a.PDF", None), ("b.pdf", None)}
    got = {(r["page"], r["text"], r["error"]) for r in files.parsed_pages(listed, parse).collect()}
    assert got == {(1, "one", None), (2, "two", None), (0, None, "ValueError: broken")}


def test_model_calls_retry_and_report(spark):
    def make():
        calls = {}

        def call(text):
            calls[text] = calls.get(text, 0) + 1
            if text == "always" or (text == "once" and calls[text] == 1):
                raise RuntimeError("busy")
            return text.upper()

        return call

    asked = spark.createDataFrame([("fine",), ("once",), ("always",)], "prompt string").coalesce(1)
    got = {r["prompt"]: (r["reply"], r["error"], r["tries"]) for r in models.chat(asked, make, wait=0.01).collect()}
    assert got == {"fine": ("FINE", None, 1), "once": ("ONCE", None, 2), "always": (None, "RuntimeError: busy", 3)}
