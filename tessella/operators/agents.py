"""Agent rounds in bulk: all open runs take one step at a time, with a registry of tools as joins."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import answering
from tessella.operators.service import MOST_STEPS
from tessella.sources.scratch import Tables

CALLS = "array<struct<call_id string, tool string, arguments string>>"
MESSAGES = "array<struct<role string, content string, call_id string>>"
RESULTS = "array<struct<position int, call_id string, tool string, outcome string, content string>>"


@dataclass(frozen=True)
class Tool:
    """A tool of a registry.

    ``problems`` gives the names of wrong parameters (an array, empty if all are right) from the arguments as JSON text.
    ``execute`` takes calls (run_id, user_id, position, call_id, tool, arguments, ...) that were found right, and returns
    the same rows with ``content`` (the result as JSON text) and ``error`` (null, or why the call failed). It sees all
    calls of a round at once, so a look-up is one join. ``user_id`` is the session's, never an argument's.
    """

    name: str
    problems: Callable[[Column], Column]
    execute: Callable[[DataFrame], DataFrame] | None = None
    needs_approval: bool = False


def validator(name: str) -> Callable[[Column], Column]:
    """The parameter rules of a known tool, by its name."""
    return lambda arguments: answering.parameter_problems(F.lit(name), arguments)


def _judged(call: Column, tools: Sequence[Tool]) -> Column:
    """A call with its outcome (that of a call which does not throw) and its wrong parameters."""
    of = lambda value, default: reduce(lambda found, t: F.when(call["tool"] == t.name, value(t)).otherwise(found), tools, default)
    known = F.coalesce(call["tool"].isin(*[t.name for t in tools]), F.lit(False))
    wrong = of(lambda t: t.problems(call["arguments"]), F.lit(None).cast("array<string>"))
    approval = of(lambda t: F.lit(t.needs_approval), F.lit(False))
    own = [call[c].alias(c) for c in ("call_id", "tool", "arguments")]
    right = lambda problems: F.coalesce(F.size(problems) == 0, F.lit(False))
    outcome = lambda problems: answering.tool_outcome(call["tool"], known, approval, call["arguments"], right(problems), F.lit(False))
    return T.bound(wrong, lambda problems: F.struct(*own, outcome(problems).alias("outcome"), problems.alias("problems")))


def _answered(judged: DataFrame, tools: Sequence[Tool]) -> DataFrame:
    """Calls with their result, whether they ran or not: (run_id, position, call_id, tool, outcome, content)."""
    as_error = lambda text: F.to_json(F.struct(text.alias("error")))
    names = F.lit(", ".join(t.name for t in tools))
    refused = (
        F.when(F.col("outcome") == "hallucinated_name", as_error(F.concat(F.lit("unknown tool; there are: "), names)))
        .when(F.col("outcome") == "unparseable_arguments", as_error(F.lit("arguments are no JSON")))
        .when(F.col("outcome") == "validation_failed", as_error(F.concat(F.lit("wrong arguments: "), F.array_join("problems", ", "))))
        .when(F.col("outcome") == "approval_required", F.to_json(F.struct(F.lit("awaiting_human_approval").alias("status"))))
    )
    columns = ["run_id", "position", "call_id", "tool", "outcome", "content"]
    parts = [judged.where("outcome <> 'ok'").withColumn("content", refused).select(columns)]
    for tool in tools:
        if tool.execute is not None and not tool.needs_approval:
            ran = tool.execute(judged.where((F.col("outcome") == "ok") & (F.col("tool") == tool.name)))
            outcome = F.when(F.col("error").isNotNull(), "threw").otherwise("ok")
            content = F.when(F.col("error").isNotNull(), as_error(F.col("error"))).otherwise(F.col("content"))
            parts.append(ran.withColumn("outcome", outcome).withColumn("content", content).select(columns))
    return reduce(DataFrame.unionByName, parts)


def run(runs: DataFrame, model: Callable[[DataFrame], DataFrame], tools: Sequence[Tool], most: int = MOST_STEPS) -> tuple[DataFrame, DataFrame]:
    """Agent runs to their end: (run_id, outcome, text, iterations, tokens), and what became of each call.

    ``runs``: run_id (unique), user_id, question, more columns that the model may read. Each round hands all open runs to
    ``model``: their columns with iteration, ``messages`` so far and ``results`` of the round before; it returns the rows
    with ``text``, ``used`` (tokens) and ``calls``. A reply without calls is the answer. Otherwise all its calls are judged
    against the registry, the right ones run, and the results go back with the next round. A call that needs approval
    ends its run, and later calls of its reply are not reported; at ``most`` rounds what is open ends at the step limit.

    Replies and results of each round are tables in the shared folder: no reply is asked for twice, plans stay short. A round
    costs its model's calls, one join a tool, and one exchange of the calls by run; only open runs take part. A run's
    messages and the results of one reply are in one row: at most ``most`` replies. An empty table ends at once. A null
    run_id is no run and goes; a null user_id owns nothing, a null question is a message without content.
    """
    tables = Tables(runs.sparkSession)
    none = lambda kind: F.array().cast(kind)
    asked = F.struct(F.lit("user").alias("role"), F.col("question").alias("content"), F.lit(None).cast("string").alias("call_id"))
    start = runs.where("run_id is not null").withColumns({"tokens": F.lit(0).cast("long"), "messages": F.array(asked).cast(MESSAGES), "results": none(RESULTS)})
    frontier, ended, events = start, [], []
    calls = F.transform(F.coalesce(F.col("calls").cast(CALLS), none(CALLS)), lambda c: _judged(c, tools))
    final = lambda df, outcome, text, i: df.select("run_id", F.lit(outcome).alias("outcome"), text.alias("text"), F.lit(i).cast("long").alias("iterations"), "tokens")
    for i in range(1, most + 1):
        reply = model(frontier.withColumn("iteration", F.lit(i)))
        said = tables.keep(reply.withColumns({"tokens": F.col("tokens") + F.coalesce("used", F.lit(0)).cast("long"), "calls": calls}), f"replies_{i}")
        ended.append(final(said.where(F.size("calls") == 0), "answered", F.coalesce("text", F.lit("")), i))
        judged = said.where(F.size("calls") > 0).select("run_id", "user_id", F.posexplode("calls").alias("position", "call")).select("run_id", "user_id", "position", "call.*")
        results = F.array_sort(F.collect_list(F.struct("position", "call_id", "tool", "outcome", "content"))).cast(RESULTS)
        met = _answered(judged, tools).groupBy("run_id").agg(results.alias("results"))
        halt = F.filter("results", lambda r: r["outcome"] == "approval_required")
        state = tables.keep(said.drop("results").join(met, "run_id").withColumn("halt", F.try_element_at(halt, F.lit(1))), f"state_{i}")
        approval = F.element_at("calls", F.col("halt.position") + 1)
        wanted = F.concat(F.lit("This action needs your approval: "), approval["tool"], F.lit("("), F.coalesce(approval["arguments"], F.lit("")), F.lit(")"))
        ended.append(final(state.where("halt is not null"), "awaiting approval", wanted, i))
        shown = F.filter("results", lambda r: F.col("halt").isNull() | (r["position"] <= F.col("halt.position")))
        events.append(state.select("run_id", F.lit(i).cast("long").alias("iteration"), F.explode(shown).alias("r")).select("run_id", "iteration", "r.*"))
        message = lambda role, content, call: F.struct(F.lit(role).alias("role"), content.alias("content"), call.alias("call_id"))
        own = F.array(message("assistant", F.coalesce("text", F.to_json(F.transform("calls", lambda c: F.struct(c["call_id"], c["tool"], c["arguments"])))), F.lit(None).cast("string"))).cast(MESSAGES)
        back = F.transform("results", lambda r: message("tool", r["content"], r["call_id"])).cast(MESSAGES)
        going = state.where("halt is null").withColumn("messages", F.concat("messages", own, back))
        frontier = going.select(frontier.columns)
        if going.isEmpty():
            break
    else:
        ended.append(final(frontier, "step limit", F.lit(f"Stopped after {most} rounds without an answer."), most))
    return reduce(DataFrame.unionByName, ended), reduce(DataFrame.unionByName, events)


def order_status(orders: DataFrame) -> Tool:
    """Status of one of the caller's own orders (order_id as in the arguments, unique; owner, status); others are as good as missing."""

    def execute(calls: DataFrame) -> DataFrame:
        own = orders.select(F.col("order_id").alias("wanted"), F.col("owner").alias("user_id"), F.col("status").alias("found_status"))
        asked = calls.withColumn("wanted", F.get_json_object("arguments", "$.orderId")).join(own, ["wanted", "user_id"], "left")
        there = F.to_json(F.struct(F.lit(True).alias("found"), F.col("wanted").alias("orderId"), F.col("found_status").alias("status")))
        missing = F.to_json(F.struct(F.lit(False).alias("found"), F.lit("No such order.").alias("reason")))
        content = F.when(F.col("found_status").isNotNull(), there).otherwise(missing)
        return asked.withColumn("content", content).withColumn("error", F.lit(None).cast("string")).drop("wanted", "found_status")

    return Tool("get_order_status", validator("get_order_status"), execute)


#: Characters of the pieces by which searched words and names meet.
GRAM = 3
#: Distinct searches of a round, each of at most answering.LONGEST_QUERY characters, that are sent to every task.
FEW = 10_000


def product_search(products: DataFrame, few: int = FEW) -> Tool:
    """Products (name, price) whose name holds the query as plain text, at or under a cap: how many, and the cheapest.

    Words and names meet on pieces of up to three characters: a query on its first piece, a name on all of its own; the
    match itself is checked after. A query is searched once, however often it is asked. The result is bounded, as
    a catalogue of any size must not go into one message; ties in price go to the first name.

    Up to ``few`` distinct searches go to the names, whose pieces then do not move; more of them meet by an exchange. The
    pieces are many times the size that Spark expects of them, so they are never what is sent to every task.
    """
    pieces = lambda size: F.transform(F.sequence(F.lit(1), F.greatest(F.length("name") - size + 1, F.lit(1))), lambda i: F.substr("name", i, F.lit(size)))

    def execute(calls: DataFrame) -> DataFrame:
        word, cap = F.lower(F.get_json_object("arguments", "$.query")), F.get_json_object("arguments", "$.maxPriceInRupees").cast("double")
        asked = calls.withColumns({"word": word, "cap": F.coalesce(cap, F.lit(float("inf")))})
        wanted = asked.select("word", "cap").distinct().withColumn("gram", F.left("word", F.lit(GRAM)))
        named = products.select(F.lower("name").alias("name"), "price")
        listed = named.select("name", "price", F.explode(F.array_distinct(F.concat(*[pieces(n) for n in range(1, GRAM + 1)]))).alias("gram"))
        sent = wanted.limit(few + 1).count() <= few
        hits = (F.broadcast(wanted).join(listed, "gram") if sent else wanted.join(listed.hint("merge"), "gram")).where(F.contains("name", F.col("word")) & (F.col("price") <= F.col("cap")))
        found = hits.groupBy("word", "cap").agg(F.count("*").alias("n"), F.min(F.struct("price", "name")).alias("least"))
        joined = asked.join(F.broadcast(found) if sent else found, ["word", "cap"], "left")
        some = F.to_json(F.struct(F.col("n").alias("matches"), F.col("least.name").alias("cheapest")))
        content = F.when(F.col("n").isNotNull(), some).otherwise('{"matches":0,"note":"No matching products."}')
        return joined.withColumn("content", content).withColumn("error", F.lit(None).cast("string")).drop("word", "cap", "n", "least")

    return Tool("search_products", validator("search_products"), execute)


def cancel_order() -> Tool:
    """Asks a person first, so it never runs in a round."""
    return Tool("cancel_order", validator("cancel_order"), None, needs_approval=True)
