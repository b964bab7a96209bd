"""Grounded answers from recorded model replies: gates, parsing, citations, fact support, routing, extraction, tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as T

MIN_SIMILARITY = 0.25
REPLY = "sufficient_context boolean, answer string, citations array<int>"

#: The fields of an extracted ticket.
PRIORITIES = ("low", "normal", "high", "urgent")
CATEGORIES = ("billing", "shipping", "technical", "returns", "other")
SENTIMENTS = ("angry", "frustrated", "neutral", "happy")
ORDER_ID = r"^A-[0-9]{4}$"
TICKET = "priority string, category string, summary string, sentiment string, orderId string, requiresHumanReview boolean"
#: Tools, whether they need an approval.
TOOLS = (("get_current_time", False), ("get_order_status", False), ("search_products", False), ("cancel_order", True))


def context(passages: DataFrame) -> DataFrame:
    """Prompt context of each query: numbered passages with their pages, in rank order."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "page", "text")))
    one = lambda p: F.concat(F.lit("[Passage "), p["rank"].cast("string"), F.lit("] (page "), p["page"].cast("string"), F.lit(")\n"), p["text"])
    return passages.groupBy("query_id").agg(F.array_join(F.transform(ordered, one), "\n\n---\n\n").alias("context"))


def decide(questions: DataFrame) -> DataFrame:
    """Outcome of each question from its hits and the model's recorded reply.

    questions: query_id, hits array<struct<page, text, similarity>> in rank order, reply string. The reasons in
    order: no_results, below_similarity_gate, invalid_model_output, model_said_insufficient, no_valid_citations,
    null (grounded). A reply is parsed only past the gate. Citations are ranks; those out of range are invalid. An answer
    without a valid citation is still given, though it is not grounded.
    """
    best = F.coalesce(F.array_max(F.transform("hits", lambda h: h["similarity"])), F.lit(-1.0))
    parsed = F.from_json(T.strip_fences("reply"), REPLY)
    q = questions.withColumn("best_similarity", best).withColumn("parsed", parsed)
    cited = F.coalesce("parsed.citations", F.array().cast("array<int>"))
    inside = lambda n: (n >= 1) & (n <= F.size("hits"))
    q = q.withColumn("valid", F.filter(cited, inside)).withColumn("invalid_citations", F.filter(cited, lambda n: ~inside(n)))
    reason = (
        F.when(F.coalesce(F.size("hits"), F.lit(0)) <= 0, "no_results")
        .when(F.col("best_similarity") < MIN_SIMILARITY, "below_similarity_gate")
        .when(F.col("parsed.sufficient_context").isNull() | F.col("parsed.answer").isNull(), "invalid_model_output")
        .when(~F.col("parsed.sufficient_context"), "model_said_insufficient")
        .when(F.size("valid") == 0, "no_valid_citations")
    )
    unread = F.coalesce(reason.isin("no_results", "below_similarity_gate"), F.lit(False))
    q = q.withColumn("reason", reason).withColumn("invalid_citations", F.when(unread, F.array().cast("array<int>")).otherwise(F.col("invalid_citations")))
    texts = F.array_join(F.transform("valid", lambda n: F.get("hits", n - 1)["text"]), " ")
    answer_facts = T.facts("parsed.answer")
    missing = T.unsupported_facts(answer_facts, texts)
    grounded = F.col("reason").isNull()
    return q.select(
        "query_id",
        grounded.alias("grounded"),
        "reason",
        F.when(grounded | (F.col("reason") == "no_valid_citations"), F.col("parsed.answer")).alias("answer"),
        "best_similarity",
        F.when(grounded, F.transform("valid", lambda n: F.get("hits", n - 1)["page"])).alias("cited_pages"),
        "invalid_citations",
        F.when(grounded, F.size(answer_facts)).alias("checked_facts"),
        F.when(grounded, missing).alias("unsupported"),
        F.when(grounded, T.support_verdict(answer_facts, missing)).alias("verdict"),
    )


def escalates(confidence: Column, finish: Column, force: Column) -> Column:
    """Whether a cheap model's reply goes to the strong model."""
    free = ~F.coalesce(force.isin("cheap", "strong"), F.lit(False))
    return free & ((confidence == "LOW") | F.coalesce(finish == "length", F.lit(False)))


def route(replies: DataFrame) -> DataFrame:
    """Routing over recorded replies of both models: (question_id, model, escalated, confidence, attempts, nano_usd)."""
    q = replies.withColumn("parsed", T.split_confidence("cheap_content"))
    up = escalates(F.col("parsed.confidence"), F.col("finish_reason"), F.col("force"))
    strong = up | F.coalesce(F.col("force") == "strong", F.lit(False))
    cost = F.when(up, F.col("cheap_nano") + F.col("strong_nano")).when(strong, F.col("strong_nano")).otherwise(F.col("cheap_nano"))
    return q.select(
        "question_id",
        F.when(strong, "strong").otherwise("cheap").alias("model"),
        up.alias("escalated"),
        F.col("parsed.confidence").alias("confidence"),
        F.col("parsed.followed_format").alias("followed_format"),
        F.when(up, 2).otherwise(1).cast("long").alias("attempts"),
        cost.cast("long").alias("nano_usd"),
    )


def ticket_problems(raw: Column) -> Column:
    """Problems of an extracted ticket, in field order; ["invalid JSON"] where the reply is none.

    Unknown fields are dropped. A missing field, a wrong type and a bad value are problems of that field; orderId may
    be null but not missing.
    """
    return T.bound(F.try_parse_json(T.json_payload(raw)), lambda v: F.when(v.isNull(), F.array(F.lit("invalid JSON"))).otherwise(_field_problems(v)))


def checked_tickets(attempts: DataFrame) -> DataFrame:
    """``attempts`` (raw, ...) with ``problems``, as by ``ticket_problems``: replies are parsed in a step of their own, so in compiled code."""
    parsed = attempts.withColumn("_ticket", F.try_parse_json(T.json_payload("raw")))
    return parsed.withColumn("problems", F.when(F.col("_ticket").isNull(), F.array(F.lit("invalid JSON"))).otherwise(_field_problems(F.col("_ticket")))).drop("_ticket")


def _field_problems(v: Column) -> Column:
    of = lambda name: F.try_variant_get(v, f"$.{name}", "string")
    kind = lambda name: F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    is_text = lambda name: F.coalesce(kind(name) == "STRING", F.lit(False))
    good = (
        ("priority", is_text("priority") & of("priority").isin(*PRIORITIES)),
        ("category", is_text("category") & of("category").isin(*CATEGORIES)),
        ("summary", is_text("summary") & F.length(of("summary")).between(5, 200)),
        ("sentiment", is_text("sentiment") & of("sentiment").isin(*SENTIMENTS)),
        ("orderId", (kind("orderId") == "VOID") | is_text("orderId") & of("orderId").rlike(ORDER_ID)),
        ("requiresHumanReview", kind("requiresHumanReview") == "BOOLEAN"),
    )
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in good]))


def first_valid(attempts: DataFrame, most: int = 3) -> DataFrame:
    """Result of repair loops over recorded attempts: (email_id, ok, attempts, raw, last_problems).

    The first of at most ``most`` attempts without problems wins; later ones would not have been made.
    """
    checked = checked_tickets(attempts.where(F.col("attempt") <= most))
    clean = F.min(F.when(F.size("problems") == 0, F.struct("attempt", "raw")))
    summed = checked.groupBy("email_id").agg(clean.alias("clean"), F.max("attempt").alias("made"), F.max_by("problems", "attempt").alias("last_problems"))
    return summed.select(
        "email_id",
        F.col("clean").isNotNull().alias("ok"),
        F.coalesce("clean.attempt", "made").cast("long").alias("attempts"),
        F.col("clean.raw").alias("raw"),
        F.when(F.col("clean").isNull(), F.col("last_problems")).alias("last_problems"),
    )


def tool_outcome(name: Column, known: Column, needs_approval: Column, arguments: Column, valid: Column, failed: Column) -> Column:
    """What became of a tool call; the checks go in this order."""
    return (
        F.when(~known, "hallucinated_name")
        .when(F.try_parse_json(arguments).isNull(), "unparseable_arguments")
        .when(~valid, "validation_failed")
        .when(needs_approval, "approval_required")
        .when(failed, "threw")
        .otherwise("ok")
    )


def order_status(calls: DataFrame, orders: DataFrame) -> DataFrame:
    """Status of the asked order if it is the caller's own; a foreign and a missing order are denied alike.

    calls(call_id, order_id, user_id), orders(order_id, owner, status).
    """
    own = orders.withColumnRenamed("owner", "user_id").withColumn("there", F.lit(True))
    found = calls.join(own, ["order_id", "user_id"], "left").withColumn("there", F.coalesce("there", F.lit(False)))
    return found.select("call_id", F.col("there").alias("found"), "status", F.when(~F.col("there"), "no such order for this user").alias("reason"))


#: The longest product query.
LONGEST_QUERY = 100


def parameter_problems(tool: Column, arguments: Column) -> Column:
    """Names of a known tool's parameters that its arguments lack or state wrongly, in order; null for an unknown tool.

    Arguments that are no JSON object are the problem "arguments". Other parameters are ignored.
    """
    v = F.try_parse_json(arguments)
    kind = lambda name: F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    text = lambda name: F.when(kind(name) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))
    price = F.try_variant_get(v, "$.maxPriceInRupees", "double")
    numeric = kind("maxPriceInRupees").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    order = F.coalesce(text("orderId").rlike(ORDER_ID), F.lit(False))
    query = F.coalesce(F.length(text("query")).between(1, LONGEST_QUERY), F.lit(False))
    cap = kind("maxPriceInRupees").isNull() | F.coalesce(numeric & (price > 0), F.lit(False))
    named = lambda *checks: F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks]))
    problems = (
        F.when(tool == "get_current_time", F.array().cast("array<string>"))
        .when(tool.isin("get_order_status", "cancel_order"), named(("orderId", order)))
        .when(tool == "search_products", named(("query", query), ("maxPriceInRupees", cap)))
    )
    broken = ~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return F.when(problems.isNotNull() & broken, F.array(F.lit("arguments"))).otherwise(problems)


def correlate(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Each tool call with its result: (run_id, call_id, tool, content, state); both sides have run_id and call_id.

    A call without a result is ``pending``, a result without a call ``orphan``; the pair decides, so a call_id may
    come again in another run.
    """
    both = calls.withColumn("asked", F.lit(True)).join(results.withColumn("answered", F.lit(True)), ["run_id", "call_id"], "full")
    state = F.when(F.col("asked").isNull(), "orphan").when(F.col("answered").isNull(), "pending").otherwise("done")
    return both.select("run_id", "call_id", "tool", "content", state.alias("state"))


def product_search(products: DataFrame, query: str, most: float | None = None, minor: int = 1) -> DataFrame:
    """Products whose name, or one of whose tags, holds the query as plain text, at or under a price cap in major units."""
    word = query.lower()
    hit = F.contains(F.lower("name"), F.lit(word)) | F.exists("tags", lambda t: F.contains(t, F.lit(word)))
    return products.where(hit if most is None else hit & (F.col("price") <= most * minor))
