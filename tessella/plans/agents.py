"""Queries on agent rounds over events, orders and parts, and on exported spans, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import agents
from tessella.sources.files import table
from tessella.sources.logs import exported

_WORDS = ("bolt", "old ring", "zinc", "g")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Every event is a run of one of eight users; its question asks for an order, a part, or more."""
    n = F.col("event_id")
    order = F.format_string("A-%04d", n * 7 % 10000)
    word = F.element_at(F.array(*[F.lit(w) for w in _WORDS]), (n % 4 + 1).cast("int"))
    return table(spark, d, "events").select(
        n.alias("run_id"), (F.col("user_id") % 8).alias("user_id"), F.concat_ws(" ", "event_type", order).alias("question"), F.col("event_type").alias("ask"), order.alias("order_id"), word.alias("word")
    )


def _reply(open_runs: DataFrame) -> DataFrame:
    """What the model says, as rules on the question, the round and the last result."""
    n, ask, first = F.col("run_id"), F.col("ask"), F.col("iteration") == 1
    last = F.try_element_at("results", F.lit(-1))["content"]
    order = F.concat(F.lit('{"orderId": "'), F.col("order_id"), F.lit('"}'))
    search = lambda word, cap: F.concat(F.lit('{"query": "'), word, F.lit('"'), cap, F.lit("}"))
    call = lambda tool, arguments: F.struct(F.concat_ws("-", n, "iteration", F.lit(tool)).alias("call_id"), F.lit(tool).alias("tool"), arguments.alias("arguments"))
    capped = F.when(n % 2 == 0, F.lit(', "maxPriceInRupees": 905.5')).otherwise("")
    status, cancel = call("get_order_status", order), call("cancel_order", order)
    part = lambda word, cap: F.array(call("search_products", search(word, cap)))
    missing = F.get_json_object(last, "$.found") == "false"
    calls: Column = (
        F.when(first & (ask == "purchase"), F.array(status))
        .when((F.col("iteration") == 2) & (ask == "purchase") & missing, part(F.lit("bolt"), F.lit("")))
        .when(first & (ask == "click") | (ask == "error"), part(F.col("word"), capped))
        .when(first & (ask == "view"), F.when(n % 2 == 0, F.array(status, cancel)).otherwise(F.array(cancel, status)))
        .when(first & (ask == "signup") & (n % 3 == 1), F.array(call("drop_table", order)))
        .when(first & (ask == "signup") & (n % 3 == 2), F.array(call("get_order_status", F.lit("{oops")), call("get_order_status", F.lit('{"orderId": "7"}'))))
    )
    return open_runs.withColumns({"text": F.when(calls.isNull(), F.coalesce(last, F.lit("hello"))), "used": F.col("iteration") * 10, "calls": calls})


def agent_rounds(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(
        F.format_string("A-%04d", "o_orderkey").alias("order_id"), (F.col("o_custkey") % 8).alias("owner"), F.col("o_orderstatus").alias("status")
    )
    parts = table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))
    tools = [agents.order_status(orders), agents.product_search(parts), agents.cancel_order()]
    ended, events = agents.run(_runs(spark, d), _reply, tools)
    made = events.groupBy("run_id").agg(F.count("*").alias("n_calls"), F.count_if(~F.col("outcome").isin("ok", "approval_required")).alias("n_failed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return ended.join(made, "run_id", "left").select("run_id", "outcome", "text", "iterations", "tokens", zero("n_calls"), zero("n_failed"))


_ROUNDS = """
WITH w AS (SELECT * FROM (VALUES ('bolt'), ('old ring'), ('zinc'), ('g')) t(word), (VALUES (905.5::DOUBLE), ('infinity'::DOUBLE)) c(cap)),
p AS (
  SELECT word, cap, CASE WHEN count(p_name) = 0 THEN '{"matches":0,"note":"No matching products."}'
                         ELSE '{"matches":' || count(p_name) || ',"cheapest":"' || arg_min(lower(p_name), (p_retailprice, lower(p_name))) || '"}' END AS found
  FROM w LEFT JOIN part ON contains(lower(p_name), word) AND p_retailprice <= cap GROUP BY ALL),
r AS (
  SELECT event_id AS n, event_type AS ask, user_id % 8 AS u, 'A-' || lpad((event_id * 7 % 10000)::VARCHAR, 4, '0') AS id, ['bolt', 'old ring', 'zinc', 'g'][event_id % 4 + 1] AS word,
         CASE WHEN event_id % 2 = 0 THEN 905.5::DOUBLE ELSE 'infinity'::DOUBLE END AS cap FROM events),
j AS (
  SELECT r.*, o_orderstatus AS status, p.found, b.found AS bolts FROM r JOIN p USING (word, cap) JOIN p b ON b.word = 'bolt' AND b.cap = 'infinity'::DOUBLE
  LEFT JOIN orders ON o_orderkey = n * 7 % 10000 AND o_custkey % 8 = u),
x AS (
  SELECT *, CASE ask WHEN 'purchase' THEN CASE WHEN status IS NULL THEN 3 ELSE 2 END WHEN 'click' THEN 2 WHEN 'view' THEN 1 WHEN 'error' THEN 6
                     WHEN 'signup' THEN CASE WHEN n % 3 = 0 THEN 1 ELSE 2 END ELSE 1 END AS i FROM j)
SELECT n AS run_id, CASE ask WHEN 'view' THEN 'awaiting approval' WHEN 'error' THEN 'step limit' ELSE 'answered' END AS outcome,
       CASE WHEN ask = 'purchase' THEN CASE WHEN status IS NULL THEN bolts ELSE '{"found":true,"orderId":"' || id || '","status":"' || status || '"}' END
            WHEN ask = 'click' THEN found WHEN ask = 'view' THEN 'This action needs your approval: cancel_order({"orderId": "' || id || '"})'
            WHEN ask = 'error' THEN 'Stopped after 6 rounds without an answer.'
            WHEN ask = 'signup' AND n % 3 = 1 THEN '{"error":"unknown tool; there are: get_order_status, search_products, cancel_order"}'
            WHEN ask = 'signup' AND n % 3 = 2 THEN '{"error":"wrong arguments: orderId"}' ELSE 'hello' END AS text,
       i::BIGINT AS iterations, (5 * i * (i + 1))::BIGINT AS tokens,
       (CASE ask WHEN 'purchase' THEN i - 1 WHEN 'click' THEN 1 WHEN 'view' THEN 2 - n % 2 WHEN 'error' THEN 6 WHEN 'signup' THEN n % 3 ELSE 0 END)::BIGINT AS n_calls,
       CASE WHEN ask = 'signup' THEN n % 3 ELSE 0 END::BIGINT AS n_failed
FROM x"""


def span_export(spark: SparkSession, d: str) -> DataFrame:
    """Turns as spans, each under the one before, written as OTLP JSON and read again."""
    second = 1_000_000_000
    own = lambda turn: F.substr(F.sha2(F.concat_ws(":", "conv_id", turn), 256), F.lit(1), F.lit(16))
    spans = table(spark, d, "conversations").select(
        F.substr(F.sha2(F.col("conv_id").cast("string"), 256), F.lit(1), F.lit(32)).alias("trace_id"),
        own(F.col("turn")).alias("span_id"),
        F.when(F.col("turn") > 0, own(F.col("turn") - 1)).alias("parent_span_id"),
        F.concat(F.lit("turn "), F.coalesce("role", F.lit("unknown"))).alias("name"),
        (F.col("turn") * second).alias("start_ns"),
        (F.col("turn") * second + F.coalesce(F.length("text"), F.lit(0))).alias("end_ns"),
        "text",
        F.col("conv_id").cast("string").alias("conv"),
    )
    back = exported(spans, "chat", F.create_map(F.lit("conv_id"), F.col("conv"), F.lit("text"), F.col("text")))
    text = F.col("attributes")["text"]
    return back.select("service", "trace_id", "span_id", "parent_span_id", "name", "start_ns", "end_ns", F.col("attributes")["conv_id"].alias("conv_id"), F.sha2(text, 256).alias("text_sha256"))


_EXPORTED = """
SELECT 'chat' AS service, left(sha256(conv_id::VARCHAR), 32) AS trace_id, left(sha256(conv_id || ':' || turn), 16) AS span_id,
       CASE WHEN turn > 0 THEN left(sha256(conv_id || ':' || (turn - 1)), 16) END AS parent_span_id, 'turn ' || coalesce(role, 'unknown') AS name,
       turn * 1000000000 AS start_ns, turn * 1000000000 + coalesce(length(text), 0) AS end_ns, conv_id::VARCHAR AS conv_id, sha256(text) AS text_sha256
FROM conversations"""


QUERIES = {f.__name__: f for f in (agent_rounds, span_export)}

SQL = {"agent_rounds": _ROUNDS, "span_export": _EXPORTED}
