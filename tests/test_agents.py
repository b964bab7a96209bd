"""Agent rounds against a plain loop over the same rules, tools and runs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tessella.operators import agents

RUNS = "run_id long, user_id long, question string, script string, clash string"
ORDERS = [("A-0001", 1, "shipped"), ("A-0002", 2, "open")]
PARTS = [("Red Bolt", 3.0), ("old bolt", 2.0), ("ab", 1.0), (None, 1.0), ("new bolt", 2.0)]


@pytest.fixture(scope="module")
def tools(spark):
    def fails(calls):
        return calls.withColumn("content", F.lit(None).cast("string")).withColumn("error", F.lit("down"))

    orders = spark.createDataFrame(ORDERS, "order_id string, owner long, status string")
    parts = spark.createDataFrame(PARTS, "name string, price double")
    none = lambda arguments: F.array().cast("array<string>")
    return [agents.order_status(orders), agents.product_search(parts), agents.cancel_order(), agents.Tool("broken", none, fails)]


def replies(open_runs):
    """The script of a run holds each round's calls; after its last the run answers with what it heard."""
    calls = F.from_json(F.get(F.from_json("script", "array<string>"), F.col("iteration") - 1), agents.CALLS)
    heard = F.to_json(F.struct("messages"))
    return open_runs.withColumns({"text": F.when(calls.isNull(), heard), "used": F.lit(5), "calls": calls})


def call(tool, arguments, call_id="c"):
    return {"call_id": call_id, "tool": tool, "arguments": arguments if arguments is None or isinstance(arguments, str) else json.dumps(arguments)}


def plain(user, rounds, most):
    """(outcome, iterations, events) of one run, call by call."""
    events = []
    for i in range(1, most + 1):
        made = rounds[i - 1] if i <= len(rounds) else []
        if not made:
            return "answered", i, events
        for at, c in enumerate(made):
            try:
                parsed = json.loads(c["arguments"] if c["arguments"] is not None else "!")
            except ValueError:
                parsed = None
            parsed = parsed if isinstance(parsed, dict) else {} if parsed is not None else None
            if c["tool"] not in ("get_order_status", "search_products", "cancel_order", "broken"):
                outcome = "hallucinated_name"
            elif parsed is None:
                outcome = "unparseable_arguments"
            elif c["tool"] in ("get_order_status", "cancel_order") and not str(parsed.get("orderId")).startswith("A-000"):
                outcome = "validation_failed"
            elif c["tool"] == "search_products" and not parsed.get("query"):
                outcome = "validation_failed"
            else:
                outcome = {"cancel_order": "approval_required", "broken": "threw"}.get(c["tool"], "ok")
            content = None
            if outcome == "ok" and c["tool"] == "get_order_status":
                own = [s for o, u, s in ORDERS if o == parsed["orderId"] and u == user]
                content = {"found": True, "orderId": parsed["orderId"], "status": own[0]} if own else {"found": False, "reason": "No such order."}
            elif outcome == "ok":
                cap = parsed.get("maxPriceInRupees", float("inf"))
                hits = sorted((p, n.lower()) for n, p in PARTS if n and parsed["query"].lower() in n.lower() and p <= cap)
                content = {"matches": len(hits), "cheapest": hits[0][1]} if hits else {"matches": 0, "note": "No matching products."}
            events.append((i, at, c["call_id"], c["tool"], outcome, content))
            if outcome == "approval_required":
                return "awaiting approval", i, events
    return "step limit", most, events


STATUS, SEARCH = call("get_order_status", {"orderId": "A-0001"}), call("search_products", {"query": "bolt"})
SCRIPTS = [
    (1, []),
    (1, [[STATUS]]),
    (2, [[STATUS], [SEARCH]]),
    (None, [[STATUS, STATUS]]),
    (1, [[SEARCH, call("search_products", {"query": "B", "maxPriceInRupees": 2}), call("search_products", {"query": "zz"}), call("search_products", {"query": "lt"})]]),
    (1, [[call("nothing", {}), call(None, {}), call("get_order_status", "{oo"), call("get_order_status", None), call("get_order_status", {"orderId": "7"})]]),
    (1, [[SEARCH], [STATUS, call("cancel_order", {"orderId": "A-0001"}), SEARCH], [SEARCH]]),
    (1, [[call("cancel_order", {"orderId": "x"})], [call("broken", {})]]),
    (1, [[SEARCH]] * 9),
    (1, [[call("search_products", {"query": "red bolt"}, f"c{i}") for i in range(300)]]),
]


def test_rounds_equal_a_plain_loop(spark, tools):
    rows = [(i, user, "?", json.dumps([json.dumps(r) for r in rounds]), "x") for i, (user, rounds) in enumerate(SCRIPTS)]
    ended, events = agents.run(spark.createDataFrame([*rows, (None, 1, None, "[]", None)], RUNS), replies, tools, 4)
    got = {r["run_id"]: r for r in ended.collect()}
    assert len(got) == ended.count() == len(SCRIPTS)
    seen = {}
    for r in events.collect():
        content = json.loads(r["content"]) if r["outcome"] == "ok" else None
        seen.setdefault(r["run_id"], []).append((r["iteration"], r["position"], r["call_id"], r["tool"], r["outcome"], content))
    for i, (user, rounds) in enumerate(SCRIPTS):
        outcome, iterations, made = plain(user, rounds, 4)
        assert (got[i]["outcome"], got[i]["iterations"], got[i]["tokens"]) == (outcome, iterations, 5 * iterations), i
        assert sorted(seen.get(i, []), key=lambda e: e[:2]) == made, i


def test_the_model_hears_every_message(spark, tools):
    ended, _ = agents.run(spark.createDataFrame([(1, 1, "where?", json.dumps([json.dumps([STATUS]), json.dumps([SEARCH, SEARCH])]), "")], RUNS), replies, tools)
    heard = json.loads(ended.first()["text"])["messages"]
    assert [m["role"] for m in heard] == ["user", "assistant", "tool", "assistant", "tool", "tool"]
    assert heard[0]["content"] == "where?" and json.loads(heard[2]["content"])["status"] == "shipped"


def test_no_runs(spark, tools):
    ended, events = agents.run(spark.createDataFrame([], RUNS), replies, tools)
    assert ended.count() == events.count() == 0


def test_pieces_of_names_are_not_what_is_broadcast(spark, tmp_path):
    spark.createDataFrame(PARTS, "name string, price double").write.parquet(str(tmp_path / "parts"))
    parts = spark.read.parquet(str(tmp_path / "parts"))
    words = ["bolt", "b", "none", "bolt"]
    calls = spark.createDataFrame([(i, 1, 0, "c", "search_products", json.dumps({"query": w})) for i, w in enumerate(words)],
                                  "run_id long, user_id long, position int, call_id string, tool string, arguments string")
    found = {}
    for few in (10, 1):
        ran = agents.product_search(parts, few).execute(calls)
        joins = [line for line in ran._jdf.queryExecution().executedPlan().toString().splitlines() if "[gram#" in line and "Join" in line]
        assert joins and not any("BuildRight" in line for line in joins), joins
        found[few] = {r["run_id"]: r["content"] for r in ran.collect()}
    assert found[10] == found[1]
    assert found[10][0] == found[10][3] == '{"matches":3,"cheapest":"new bolt"}' and found[10][2] == '{"matches":0,"note":"No matching products."}'
