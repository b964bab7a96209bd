"""Queries on ledgers, budgets, evaluation, ingestion, tools and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import answering, evals, ingest, ledger
from tessella.sources import sse
from tessella.sources.files import spread, table

MODELS = ("openai/gpt-oss-120b", "openai/gpt-oss-20b", "unlisted-model")


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as calls: an assistant's turn is output, any other is input; a token is four characters."""
    turns = table(spark, d, "conversations")
    size = F.ceil(F.length("text") / 4).cast("long")
    answer = F.col("role") == "assistant"
    model = F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.col("conv_id") % 3 + 1).cast("int"))
    return turns.select(
        "conv_id",
        "turn",
        model.alias("model"),
        F.when(F.col("conv_id") % 4 > 0, F.concat(F.lit("u_"), (F.col("conv_id") % 4).cast("string"))).alias("user_id"),
        F.col("role").alias("operation"),
        F.when(answer, 0).otherwise(size).cast("long").alias("input_tokens"),
        F.when(answer, size).otherwise(0).cast("long").alias("output_tokens"),
    )


_CALLS = """
calls AS (
  SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'openai/gpt-oss-120b' WHEN 1 THEN 'openai/gpt-oss-20b' ELSE 'unlisted-model' END AS model,
         CASE WHEN conv_id % 4 > 0 THEN 'u_' || (conv_id % 4) END AS user_id, role AS operation,
         CASE WHEN role = 'assistant' THEN 0 ELSE (length(text) + 3) // 4 END AS i, CASE WHEN role = 'assistant' THEN (length(text) + 3) // 4 ELSE 0 END AS o
  FROM conversations),
priced AS (
  SELECT *, i * CASE conv_id % 3 WHEN 0 THEN 150 WHEN 1 THEN 75 ELSE 100 END + o * CASE conv_id % 3 WHEN 0 THEN 600 WHEN 1 THEN 300 ELSE 400 END AS nano,
         o * CASE conv_id % 3 WHEN 0 THEN 600 WHEN 1 THEN 300 ELSE 400 END AS nano_out FROM calls)"""


def token_cost_ledger(spark: SparkSession, d: str) -> DataFrame:
    priced = ledger.priced(_calls(spark, d), ledger.prices(spark))
    speed = ledger.throughput(F.col("output_tokens"), F.col("turn") * 250)
    return priced.select("conv_id", "turn", "model", "input_tokens", "output_tokens", ledger.usd(F.col("nano_usd")).alias("usd"),
                         ledger.usd(F.col("nano_output_usd")).alias("output_usd"), "estimated", speed.alias("tokens_per_s"))


_LEDGER = f"""WITH {_CALLS}
SELECT conv_id, turn, model, i::BIGINT AS input_tokens, o::BIGINT AS output_tokens, round(nano / 1e9, 9) AS usd, round(nano_out / 1e9, 9) AS output_usd,
       conv_id % 3 = 2 AS estimated, coalesce(round(o * 1000.0::DOUBLE / nullif(turn * 250, 0)), 0)::BIGINT AS tokens_per_s FROM priced"""


def usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    return ledger.rollup(ledger.priced(_calls(spark, d), ledger.prices(spark)), ["model", "user_id", "operation"])


def _rollup_sql(name: str, value: str, where: str = "true") -> str:
    group = f"GROUP BY {value}" if name != "total" else ""
    return f"""SELECT '{name}' AS dimension, {value} AS value, count(*) AS calls, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens,
       round(sum(nano) / 1e9, 9) AS usd, round(coalesce(sum(nano_out) / nullif(sum(nano), 0), 0), 9) AS output_share FROM priced WHERE {where} {group}"""


_ROLLUP = f"WITH {_CALLS} " + " UNION ALL ".join(
    [_rollup_sql("total", "''"), *[_rollup_sql(k, k, f"{k} IS NOT NULL") for k in ("model", "user_id", "operation")]]
)


def recent_calls(spark: SparkSession, d: str) -> DataFrame:
    return ledger.recent(table(spark, d, "events"), "ts", "event_id", 20).select("event_id", "user_id", "event_type")


def ledger_ring(spark: SparkSession, d: str) -> DataFrame:
    return ledger.recent(table(spark, d, "events"), "ts", "event_id", ledger.RING).select("event_id", "value")


def _spend(spark: SparkSession, d: str) -> DataFrame:
    cost = F.round(F.coalesce("value", F.lit(0.0)) * 1e4).cast("long")
    return table(spark, d, "events").where("event_type = 'purchase'").select("event_id", "user_id", "ts", cost.alias("nano_usd"))


DAY_LIMIT = 500_000
_SPEND = "spend AS (SELECT event_id, user_id, ts, round(coalesce(value, 0) * 1e4)::BIGINT AS nano FROM events WHERE event_type = 'purchase')"


def budget_daily(spark: SparkSession, d: str) -> DataFrame:
    status = ledger.budget_status(ledger.daily_spend(_spend(spark, d)), DAY_LIMIT)
    return status.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


_DAILY = f"""WITH {_SPEND}, g AS (SELECT user_id, ts::DATE AS day, sum(nano) AS n FROM spend GROUP BY ALL)
SELECT user_id, day::VARCHAR AS day, round(n / 1e9, 9) AS spent, round(greatest({DAY_LIMIT} - n, 0) / 1e9, 9) AS remaining,
       least(100, round(100.0::DOUBLE * n / {DAY_LIMIT}))::BIGINT AS percent_used, n < {DAY_LIMIT} AS allowed FROM g"""


def budget_allow(spark: SparkSession, d: str) -> DataFrame:
    return ledger.allowed_calls(_spend(spark, d), DAY_LIMIT, "event_id").select("event_id", "nano_before", "allowed")


_ALLOW = f"""WITH {_SPEND}
SELECT event_id, b AS nano_before, b < {DAY_LIMIT} AS allowed FROM (
  SELECT event_id, coalesce(sum(nano) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM spend)"""


def span_tree(spark: SparkSession, d: str) -> DataFrame:
    """A conversation as a trace in which each turn is the child of the one before."""
    turns = table(spark, d, "conversations")
    spans = turns.select(
        F.col("conv_id").alias("trace_id"),
        F.col("turn").alias("span_id"),
        F.when(F.col("turn") > 0, F.col("turn") - 1).alias("parent_span_id"),
    )
    return ledger.span_tree(spans).select("trace_id", "span_id", F.col("depth").cast("long").alias("depth"), "root_id")


_SPANS = """
WITH RECURSIVE t AS (
  SELECT conv_id, turn, 0 AS depth, turn AS root FROM conversations c
  WHERE turn = 0 OR NOT EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1)
  UNION ALL
  SELECT c.conv_id, c.turn, t.depth + 1, t.root FROM t JOIN conversations c ON c.conv_id = t.conv_id AND c.turn = t.turn + 1)
SELECT conv_id AS trace_id, turn AS span_id, depth::BIGINT AS depth, root AS root_id FROM t"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs with a tool of the same number as each assistant's turn."""
    calls = ledger.priced(_calls(spark, d), ledger.prices(spark))
    tool = F.when(F.col("operation") == "assistant", F.element_at(F.array(*[F.lit(n) for n, _ in answering.TOOLS]), (F.col("turn") % 4 + 1).cast("int")))
    turns = calls.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), "nano_usd", F.col("turn").alias("iteration"),
                         (F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), tool.alias("tool"))
    return ledger.run_totals(turns)


def agent_run_totals(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).select("run_id", "tokens", ledger.usd(F.col("nano_usd")).alias("usd"), "iterations", F.array_join("tools", ",").alias("tools"))


_RUNS = f"""WITH {_CALLS},
runs AS (SELECT conv_id AS run_id, sum(i + o)::BIGINT AS tokens, round(sum(nano) / 1e9, 9) AS usd, max(turn)::BIGINT AS iterations,
         coalesce(string_agg(CASE WHEN operation = 'assistant' THEN ['get_current_time', 'get_order_status', 'search_products', 'cancel_order'][turn % 4 + 1] END, ',' ORDER BY turn), '') AS tools
  FROM priced GROUP BY conv_id)"""


def wrong_process(spark: SparkSession, d: str) -> DataFrame:
    required = F.when(F.col("run_id") % 2 == 0, "get_order_status")
    return ledger.wrong_process(_runs(spark, d), required).select("run_id", F.array_join("tools", ",").alias("tools"))


def _cases(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as scored cases: quality is the expectation, toxic a known failure, long texts are answered."""
    joined = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return joined.select(
        F.col("doc_id").alias("id"),
        F.when(F.col("quality") == 1, "answer").otherwise("refuse").alias("expect"),
        (F.col("n_chars") > 1200).alias("answered"),
        (F.col("toxic") == 1).alias("known_failure"),
        F.when(F.col("quality") == 1, F.col("n_chars") % 3 > 0).alias("hit"),
        F.when(F.col("quality") == 1, (F.col("n_chars") % 3).cast("double") / 2).alias("coverage"),
        F.when(F.col("quality") == 1, F.when(F.col("n_chars") % 3 > 0, 1.0 / (F.col("n_chars") % 3)).otherwise(0.0)).alias("mrr"),
        ((F.col("n_chars") % 1000).cast("double") / 1000).alias("best_similarity"),
    ).withColumn("behaviour", evals.behaviour(F.col("expect"), F.col("answered")))


_CASES = """
cases AS (
  SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'answer' ELSE 'refuse' END AS expect, n_chars > 1200 AS answered, toxic = 1 AS known,
         CASE WHEN quality = 1 THEN n_chars % 3 > 0 END AS hit, CASE WHEN quality = 1 THEN (n_chars % 3) / 2.0::DOUBLE END AS coverage,
         CASE WHEN quality = 1 THEN coalesce(1.0::DOUBLE / nullif(n_chars % 3, 0), 0) END AS mrr, (n_chars % 1000) / 1000.0::DOUBLE AS sim
  FROM labels JOIN documents USING (doc_id))"""
_MEASURES = """
count(*) FILTER (WHERE expect = 'answer' AND answered) AS true_accept, count(*) FILTER (WHERE expect = 'refuse' AND answered) AS false_accept,
count(*) FILTER (WHERE expect = 'refuse' AND NOT answered) AS true_refusal, count(*) FILTER (WHERE expect = 'answer' AND NOT answered) AS false_refusal,
round(count(*) FILTER (WHERE expect = 'refuse' AND answered)::DOUBLE / nullif(count(*) FILTER (WHERE expect = 'refuse'), 0), 9) AS false_accept_rate,
round(count(*) FILTER (WHERE expect = 'answer' AND NOT answered)::DOUBLE / nullif(count(*) FILTER (WHERE expect = 'answer'), 0), 9) AS false_refusal_rate,
round(avg(hit::INT), 9) AS recall, round(avg(mrr), 9) AS mrr, round(avg(coverage), 9) AS coverage, count(hit) AS retrieval_cases"""


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d).agg(*evals.summary(_cases(spark, d)))


def eval_two_views(spark: SparkSession, d: str) -> DataFrame:
    return evals.two_views(_cases(spark, d))


_VIEWS = f"""WITH {_CASES}
SELECT 'all' AS view, count(*) AS n, count(*) FILTER (WHERE known) AS known, {_MEASURES} FROM cases
UNION ALL SELECT 'tracked', count(*), count(*) FILTER (WHERE known), {_MEASURES} FROM cases WHERE NOT known HAVING count(*) > 0"""


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return evals.sweep(_cases(spark, d).withColumnRenamed("answered", "model_answered"))


_LEVELS = ", ".join(f"({t}::DOUBLE)" for t in evals.THRESHOLDS)
_SWEEP = f"""WITH {_CASES}, o AS (SELECT t.threshold, expect = 'answer' AS a, sim < t.threshold AS gated, NOT (sim < t.threshold) AND answered AS ok
  FROM cases, (VALUES {_LEVELS}) t(threshold))
SELECT threshold, count(*) FILTER (WHERE NOT a AND ok) AS false_accept, count(*) FILTER (WHERE a AND NOT ok) AS false_refusal,
       round(coalesce(count(*) FILTER (WHERE NOT a AND ok)::DOUBLE / nullif(count(*) FILTER (WHERE NOT a), 0), 0), 9) AS false_accept_rate,
       round(coalesce(count(*) FILTER (WHERE a AND NOT ok)::DOUBLE / nullif(count(*) FILTER (WHERE a), 0), 0), 9) AS false_refusal_rate,
       round(count(*) FILTER (WHERE gated)::DOUBLE / count(*), 9) AS gated_fraction, count(*) FILTER (WHERE NOT gated) AS model_calls FROM o GROUP BY threshold"""


def sweep_sets(spark: SparkSession, d: str) -> DataFrame:
    sets = evals.sweep_sets(threshold_sweep(spark, d))
    return sets.select(*[F.size(c).cast("long").alias(c) for c in sets.columns])


_SETS = f"""SELECT count(*) FILTER (WHERE false_accept = 0) AS no_false_accept, count(*) FILTER (WHERE false_refusal = 0) AS no_false_refusal,
       count(*) FILTER (WHERE false_accept = 0 AND false_refusal = 0) AS clean FROM ({_SWEEP})"""


def interleaving(spark: SparkSession, d: str) -> DataFrame:
    return evals.interleaving(_cases(spark, d))


_INTERLEAVING = f"""WITH {_CASES}
SELECT r.id, r.sim AS best_similarity, count(a.id) AS blocks FROM (SELECT * FROM cases WHERE expect = 'refuse') r
LEFT JOIN (SELECT * FROM cases WHERE expect = 'answer') a ON a.sim < r.sim GROUP BY r.id, r.sim"""


def gate_checks(spark: SparkSession, d: str) -> DataFrame:
    return evals.gate(confusion_matrix(spark, d))


_GATE = f"WITH {_CASES}, m AS (SELECT {_MEASURES} FROM cases) " + " UNION ALL ".join(
    f"SELECT '{n}' AS name, {n} AS value, {float(b)}::DOUBLE AS bound, {n} IS NOT NULL AS measured, coalesce({n} {'<=' if most else '>='} {b}, true) AS ok FROM m"
    for n, b, most in evals.GATE
)


def gate_verdict(spark: SparkSession, d: str) -> DataFrame:
    verdict = evals.gate_verdict(gate_checks(spark, d))
    return verdict.withColumn("failed", F.array_join("failed", ","))


_VERDICT = f"""SELECT bool_and(ok) AND count(*) FILTER (WHERE measured) > 0 AS passed, count(*) FILTER (WHERE measured) = 0 AS fatal,
       coalesce(string_agg(CASE WHEN NOT ok THEN name END, ',' ORDER BY name), '') AS failed FROM ({_GATE})"""


def judge_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Quality as the human label; the judge skips every document of fewer than 200 characters."""
    cases = _cases(spark, d)
    human = cases.select("id", (F.col("expect") == "answer").alias("label"))
    judged = table(spark, d, "documents").where("n_chars >= 200").select(F.col("doc_id").alias("id"), (F.col("n_chars") > 1200).alias("label"))
    return evals.agreement(human, judged)


_AGREEMENT = f"""WITH {_CASES}
SELECT count(*) AS labelled, count(*) FILTER (WHERE n_chars >= 200 AND (expect = 'answer') = (n_chars > 1200)) AS agreed,
       round(count(*) FILTER (WHERE n_chars >= 200 AND (expect = 'answer') = (n_chars > 1200))::DOUBLE / nullif(count(*), 0), 9) AS agreement
FROM cases JOIN documents ON doc_id = id"""


def dataset_problems(spark: SparkSession, d: str) -> DataFrame:
    """Documents as golden cases; the language stands for the expectation, so only two languages are valid."""
    docs = table(spark, d, "documents")
    expect = F.when(F.col("lang") == "en", "answer").when(F.col("lang") == "fr", "refuse").otherwise(F.col("lang"))
    cases = docs.select(
        F.col("source").alias("id"),
        F.when(F.col("n_chars") > 40, F.col("text")).alias("question"),
        expect.alias("expect"),
        F.when(F.col("n_chars") % 2 == 0, F.array(F.lit(1))).alias("expected_pages"),
        F.when(F.col("n_chars") % 5 == 0, F.array(F.lit("x"))).when(F.col("n_chars") % 7 == 0, F.array().cast("array<string>")).alias("must_contain"),
    )
    return evals.dataset_problems(cases).groupBy("id", "problem").agg(F.count("*").alias("n"))


_PROBLEMS = """
WITH c AS (SELECT source AS id, n_chars > 40 AS q, CASE lang WHEN 'en' THEN 'answer' WHEN 'fr' THEN 'refuse' ELSE lang END AS e, n_chars % 2 = 0 AS p, n_chars % 5 = 0 AS m, n_chars % 5 = 0 OR n_chars % 7 = 0 AS listed FROM documents)
SELECT id, problem, count(*) AS n FROM (
  SELECT id, 'missing question' AS problem FROM c WHERE NOT q
  UNION ALL SELECT id, 'bad expect' FROM c WHERE e NOT IN ('answer', 'refuse')
  UNION ALL SELECT id, 'answer without a check' FROM c WHERE e = 'answer' AND NOT p AND NOT m
  UNION ALL SELECT id, 'refuse with a check' FROM c WHERE e = 'refuse' AND (p OR listed)
  UNION ALL SELECT id, 'duplicate id' FROM c WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1) GROUP BY ALL"""


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of each query vector against the label it should find and the next one."""
    from tessella.plans.retrieval import EVERY, knn_topk

    labels = table(spark, d, "embeddings").select("vec_id", "label")
    hits = knn_topk(spark, d).where("rank <= 5").join(labels.withColumnRenamed("vec_id", "id"), "id")
    got = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]).alias("retrieved"))
    asked = labels.where(f"vec_id % {EVERY} = 0").select(F.col("vec_id").alias("query_id"), F.array(F.col("label"), (F.col("label") + 1) % 10).alias("expected"))
    scored = asked.join(got, "query_id").withColumn("s", evals.retrieval_scores(F.col("expected"), F.col("retrieved")))
    return scored.select("query_id", "s.hit", "s.coverage", F.round("s.reciprocal_rank", 9).alias("reciprocal_rank"), F.size("s.missed").cast("long").alias("missed"))


def _metrics_sql() -> str:
    from tessella.plans.retrieval import SQL as R

    return f"""
WITH h AS (SELECT query_id, rank, label FROM ({R["knn_topk"]}) JOIN embeddings ON vec_id = id WHERE rank <= 5),
g AS (SELECT query_id, list(label ORDER BY rank) AS got FROM h GROUP BY query_id),
s AS (SELECT query_id, got, label AS a, (label + 1) % 10 AS b FROM g JOIN embeddings ON vec_id = query_id)
SELECT query_id, list_contains(got, a) OR list_contains(got, b) AS hit, (list_contains(got, a)::INT + list_contains(got, b)::INT) / 2.0::DOUBLE AS coverage,
       round(coalesce(1.0::DOUBLE / list_position(list_transform(got, lambda x: x = a OR x = b), true), 0), 9) AS reciprocal_rank,
       (2 - list_contains(got, a)::INT - list_contains(got, b)::INT)::BIGINT AS missed FROM s"""


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select(F.col("source").alias("document"), F.col("doc_id").alias("page"), "text"))


def extraction_assessment(spark: SparkSession, d: str) -> DataFrame:
    return ingest.assess(_pages(spark, d))


_ASSESS = r"""
WITH g AS (SELECT source AS document, count(*) AS pages, sum(length(text))::BIGINT AS total_chars, count(*) FILTER (WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 20) AS empty_pages FROM documents GROUP BY source)
SELECT *, round(total_chars / pages)::BIGINT AS chars_per_page, CASE WHEN total_chars < 200 THEN 'scanned' WHEN empty_pages > pages * 0.5 THEN 'partly scanned' WHEN round(total_chars / pages) < 150 THEN 'sparse' ELSE 'ok' END AS verdict FROM g"""


def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines at the edges of a language's documents, each taken as a page; a source has too few common lines."""
    pages = _pages(spark, d).withColumn("text", F.concat(F.lit("Source "), "document", F.lit(" page "), F.col("page").cast("string"), F.lit("\n"), "text"))
    return ingest.repeated_lines(pages)


def strip_repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d).withColumn("text", F.concat(F.lit("Source "), "document", F.lit(" page "), F.col("page").cast("string"), F.lit("\n"), "text"))
    kept = ingest.strip_repeated(pages, ingest.repeated_lines(pages))
    return kept.select("page", F.sha2("text", 256).alias("text_sha256"))


_HEADED = "p AS (SELECT source AS document, doc_id AS page, 'Source ' || source || ' page ' || doc_id || chr(10) || text AS t FROM documents)"
_KEY = r"regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '[0-9]+', '#', 'g')"
_REPEATED = rf"""
{_HEADED},
l AS (SELECT document, page, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS a FROM p),
e AS (SELECT document, page, unnest(list_distinct(list_concat(a[1:2], a[greatest(len(a) - 1, 1):]))) AS x FROM l),
n AS (SELECT document, count(*) AS pages FROM p GROUP BY document HAVING count(*) >= 4),
rep AS (SELECT document, {_KEY} AS key, count(*) AS n_pages, any_value(pages) AS pages FROM e JOIN n USING (document) GROUP BY ALL HAVING count(*) >= 0.6 * any_value(pages))"""
_STRIP = rf"""WITH {_REPEATED}
SELECT page, sha256(array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT list_contains(coalesce(k, []), {_KEY})), chr(10))) AS text_sha256
FROM p LEFT JOIN (SELECT document, list(key) AS k FROM rep GROUP BY document) USING (document)"""


def dedup_checksum(spark: SparkSession, d: str) -> DataFrame:
    return ingest.by_checksum(table(spark, d, "documents"), "doc_id", "text")


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of every document, each taken as one page."""
    return ingest.document_chunks(spread(table(spark, d, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("document"), F.array("text").alias("pages")))


def chunk_conversations(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of every conversation, each turn a page: its digest, as texts are long."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("document"), F.col("turn").alias("page"), "text")
    return ingest.chunks(turns, 120, 30, 20).select("document", "page", "chunk_index", "token_estimate", F.sha2("text", 256).alias("text_sha256"))


def document_stats(spark: SparkSession, d: str) -> DataFrame:
    docs, vectors = table(spark, d, "documents"), table(spark, d, "embeddings")
    unembedded = docs.join(vectors.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")
    counts = [docs.agg(F.count("*")).scalar(), vectors.agg(F.count("*")).scalar(), unembedded.agg(F.count("*")).scalar()]
    return spark.range(1).select(counts[0].alias("documents"), counts[1].alias("embeddings"), counts[2].alias("unembedded"))


def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    """What is left of orders and lines, by status, once every failed order is deleted; and orphans."""
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    kept, rest = ingest.delete_cascade(orders, lines, orders.where("o_orderstatus = 'F'").select("o_orderkey"), "o_orderkey", "l_orderkey")
    lost = ingest.orphans(rest, kept, "l_orderkey", "o_orderkey")
    by = rest.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("lines"))
    return by.withColumn("orders", kept.agg(F.count("*")).scalar()).withColumn("orphans", lost.agg(F.count("*")).scalar())


_CASCADE = """
WITH k AS (SELECT * FROM orders WHERE o_orderstatus <> 'F' OR o_orderstatus IS NULL),
r AS (SELECT l.* FROM lineitem l WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))
SELECT l_returnflag AS flag, count(*) AS lines, (SELECT count(*) FROM k) AS orders,
       (SELECT count(*) FROM r WHERE l_orderkey NOT IN (SELECT o_orderkey FROM k)) AS orphans FROM r GROUP BY l_returnflag"""


def identifier_extract(spark: SparkSession, d: str) -> DataFrame:
    ids = T.identifiers("text")
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.array_join(ids, "|").alias("identifiers"), F.size(ids).cast("long").alias("n"))


_IDENTIFIERS = r"""
SELECT doc_id, array_to_string(ids, '|') AS identifiers, len(ids)::BIGINT AS n FROM (
  SELECT doc_id, list_sort(list_distinct(list_transform(list_concat(regexp_extract_all(text, '\b[A-Za-z]{1,4}-[0-9]{3,}\b'), regexp_extract_all(text, '\b[0-9][0-9,.]*\b'),
    regexp_extract_all(text, '\b[\w.+-]+@[\w-]+\.[\w.]+\b'), regexp_extract_all(text, '"([^"]{1,60})"')), lambda x: lower(x)))) AS ids FROM documents)"""


def redact_pii(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", T.redact("text").alias("text"))


_REDACTED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\b[\w.+-]+@[\w-]+\.[\w.]+\b', '[email]', 'g'),
  '\b[0-9](?:[ -]?[0-9]){{12,18}}\b', '[card]', 'g'), '\+?[0-9](?:[ -]?[0-9]){{7,13}}\b', '[phone]', 'g'), '\b[A-Z]{{5}}[0-9]{{4}}[A-Z]\b', '[pan]', 'g')"""


def capture_modes(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    digest = lambda mode: F.sha2(T.captured(F.col("text"), mode), 256)
    return docs.select("doc_id", T.captured(F.col("text"), "none").alias("none"), digest("full").alias("full"), digest("redacted").alias("redacted"))


_CAPPED = "CASE WHEN length(text) > 4000 THEN left(text, 4000) || '…[truncated]' WHEN length(text) > 0 THEN text END"
_CAPTURE = f"SELECT doc_id, NULL::VARCHAR AS none, sha256({_CAPPED}) AS \"full\", sha256({_REDACTED.format(_CAPPED)}) AS redacted FROM documents"


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.sha2(T.clean_text("text"), 256).alias("text_sha256"), T.preview("text").alias("preview"))


_CLEAN = r"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(text, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'),
  '(\w)-\n(\w)', '\1\2', 'g'), '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS text_sha256,
  left(regexp_replace(text, '\s+', ' ', 'g'), 140) AS preview FROM documents"""


def order_status_authz(spark: SparkSession, d: str) -> DataFrame:
    """Every order asked for by a customer who owns it or, for each third, by the next customer."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("status"))
    calls = orders.select(F.col("order_id").alias("call_id"), "order_id", F.when(F.col("order_id") % 3 == 0, F.col("owner") + 1).otherwise(F.col("owner")).alias("user_id"))
    return answering.order_status(calls, orders)


_STATUS = """
SELECT o_orderkey AS call_id, o_orderkey % 3 <> 0 AS found, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS status,
       CASE WHEN o_orderkey % 3 = 0 THEN 'no such order for this user' END AS reason FROM orders"""


def product_search(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.split(F.lower("p_type"), " ").alias("tags"), (F.col("p_retailprice") * 100).alias("price"))
    return answering.product_search(parts, "ECO", 950, 100).select("p_partkey", "name")


_PRODUCTS = """SELECT p_partkey, p_name AS name FROM part WHERE (contains(lower(p_name), 'eco')
  OR len(list_filter(string_split(lower(p_type), ' '), lambda t: contains(t, 'eco'))) > 0) AND p_retailprice * 100 <= 95000"""


def tool_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Events as tool calls: the type stands for the tool, props for its arguments."""
    calls = table(spark, d, "events")
    name = (
        F.when(F.col("event_type") == "click", "get_order_status")
        .when(F.col("event_type") == "view", "search_products")
        .when(F.col("event_type") == "purchase", "cancel_order")
        .otherwise(F.col("event_type"))
    )
    arguments = F.when(F.col("event_id") % 11 == 0, "{broken").otherwise(F.col("props"))
    tools = spark.createDataFrame(list(answering.TOOLS), "tool string, needs_approval boolean")
    named = calls.select("event_id", name.alias("tool"), arguments.alias("arguments"), "value").join(tools, "tool", "left")
    k = F.get_json_object("arguments", "$.k").cast("int")
    outcome = answering.tool_outcome(
        F.col("tool"), F.col("needs_approval").isNotNull(), F.col("needs_approval"), F.col("arguments"), F.coalesce(k >= 20, F.lit(False)), F.coalesce(F.col("value") > 90, F.lit(False))
    )
    return named.select("event_id", outcome.alias("outcome"))


_OUTCOME = """
SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'hallucinated_name' WHEN event_id % 11 = 0 THEN 'unparseable_arguments'
  WHEN coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT), -1) < 20 THEN 'validation_failed' WHEN event_type = 'purchase' THEN 'approval_required'
  WHEN value > 90 THEN 'threw' ELSE 'ok' END AS outcome FROM events"""


def _tickets(spark: SparkSession, d: str) -> DataFrame:
    """Events as extraction attempts: three attempts an e-mail, of which some break a field each."""
    e = spread(table(spark, d, "events").select("event_id"))
    n = F.col("event_id")
    text = lambda s: F.lit(s)
    priority = F.when(n % 5 == 0, "asap").otherwise("high")
    summary = F.when(n % 7 == 0, "no").otherwise("a summary of the mail")
    order = F.when(n % 3 == 0, text("null")).when(n % 3 == 1, text('"A-1001"')).otherwise(text('"B-1"'))
    review = F.when(n % 2 == 0, text("true")).otherwise(text("false"))
    body = F.concat(text('{"priority": "'), priority, text('", "category": "billing", "summary": "'), summary, text('", "sentiment": "neutral", "orderId": '), order, text(', "requiresHumanReview": '), review, text("}"))
    raw = F.when(n % 13 == 0, text("sorry, no")).when(n % 4 == 0, F.concat(text("```json\n"), body, text("\n```"))).otherwise(body)
    return e.select(F.floor(n / 3).alias("email_id"), (n % 3 + 1).cast("int").alias("attempt"), raw.alias("raw"), "event_id")


def ticket_validation(spark: SparkSession, d: str) -> DataFrame:
    return answering.checked_tickets(_tickets(spark, d)).select("event_id", F.array_join("problems", ",").alias("problems"))


_TICKET = """
t AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'invalid JSON' ELSE concat_ws(',', CASE WHEN event_id % 5 = 0 THEN 'priority' END,
  CASE WHEN event_id % 7 = 0 THEN 'summary' END, CASE WHEN event_id % 3 = 2 THEN 'orderId' END) END AS problems FROM events)"""


def extract_repair(spark: SparkSession, d: str) -> DataFrame:
    out = answering.first_valid(_tickets(spark, d))
    return out.select("email_id", "ok", "attempts", F.array_join("last_problems", ",").alias("last_problems"))


_REPAIR = f"""WITH {_TICKET},
g AS (SELECT event_id // 3 AS email_id, min(event_id % 3 + 1) FILTER (WHERE problems = '') AS first, max(event_id % 3 + 1) AS made, arg_max(problems, event_id) AS last FROM t GROUP BY 1)
SELECT email_id::BIGINT AS email_id, first IS NOT NULL AS ok, coalesce(first, made)::BIGINT AS attempts, CASE WHEN first IS NULL THEN last END AS last_problems FROM g"""


def model_routing(spark: SparkSession, d: str) -> DataFrame:
    """Turns as replies of the cheap model, with a confidence line on two of three."""
    turns = table(spark, d, "conversations")
    line = F.when(F.col("turn") % 3 == 0, "\nCONFIDENCE: high ").when(F.col("turn") % 3 == 1, "\nCONFIDENCE: LOW").otherwise("")
    size = F.length("text").cast("long")
    replies = turns.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("question_id"),
        F.concat("text", line).alias("cheap_content"),
        F.when(size > 900, "length").otherwise("stop").alias("finish_reason"),
        F.when(F.col("conv_id") % 5 == 0, "cheap").when(F.col("conv_id") % 5 == 1, "strong").alias("force"),
        (size * 75).alias("cheap_nano"),
        (size * 150).alias("strong_nano"),
    )
    return answering.route(replies)


_ROUTING = """
WITH r AS (SELECT conv_id * 100 + turn AS question_id, conv_id % 5 AS f, turn % 3 AS k, length(text) AS n FROM conversations),
u AS (SELECT *, f > 1 AND (k <> 0 OR n > 900) AS up FROM r)
SELECT question_id, CASE WHEN up OR f = 1 THEN 'strong' ELSE 'cheap' END AS model, up AS escalated, CASE WHEN k = 0 THEN 'HIGH' ELSE 'LOW' END AS confidence, k < 2 AS followed_format,
       CASE WHEN up THEN 2 ELSE 1 END::BIGINT AS attempts, (CASE WHEN up THEN n * 225 WHEN f = 1 THEN n * 150 ELSE n * 75 END)::BIGINT AS nano_usd FROM u"""


def routing_summary(spark: SparkSession, d: str) -> DataFrame:
    routed = model_routing(spark, d)
    even = ledger.break_even((0.075, 0.3), (0.15, 0.6))
    rate = F.round(F.avg(F.col("escalated").cast("int")), 9)
    return routed.agg(F.count("*").alias("questions"), F.sum("attempts").alias("attempts"), ledger.usd(F.sum("nano_usd")).alias("usd"), rate.alias("escalation_rate"),
                      (rate < even["max_escalation_rate"]).alias("pays"))


_ROUTED = f"""SELECT count(*) AS questions, sum(attempts)::BIGINT AS attempts, round(sum(nano_usd) / 1e9, 9) AS usd, round(avg(escalated::INT), 9) AS escalation_rate,
       round(avg(escalated::INT), 9) < 0.5 AS pays FROM ({_ROUTING})"""


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), "ts", (F.col("event_type") != "error").alias("is_token"))


def idle_gaps(spark: SparkSession, d: str) -> DataFrame:
    return sse.stalls(_stream(spark, d), 3600 * 6).select("stream_id", "ts", F.round("gap_seconds", 6).alias("gap_seconds"))


_GAPS = """
SELECT user_id AS stream_id, ts, round(epoch_us(ts - p) / 1e6, 6) AS gap_seconds FROM (
  SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE epoch_us(ts - p) / 1e6 > 21600"""


def ttft(spark: SparkSession, d: str) -> DataFrame:
    return sse.latency(_stream(spark, d))


_TTFT = """
SELECT user_id AS stream_id, (epoch_us(min(ts) FILTER (WHERE event_type <> 'error') - min(ts)) // 1000)::BIGINT AS ttft_ms, (epoch_us(max(ts) - min(ts)) // 1000)::BIGINT AS total_ms,
       count(*) FILTER (WHERE event_type <> 'error') AS tokens FROM events GROUP BY user_id"""


def sse_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Events written as frames, cut into two chunks each inside a frame, and parsed again."""
    e = table(spark, d, "events").select("user_id", "event_id", sse.frame(F.col("event_type"), F.concat("props", F.lit("\n"), F.col("event_id").cast("string"))).alias("f"))
    cut = F.array(F.struct(F.lit(0).alias("n"), F.left("f", F.lit(9)).alias("c")), F.struct(F.lit(1).alias("n"), F.substr("f", F.lit(10)).alias("c")))
    chunks = e.select(F.col("user_id").alias("stream_id"), "event_id", F.explode(cut).alias("p"))
    chunks = chunks.select("stream_id", (F.col("event_id") * 2 + F.col("p.n")).alias("seq"), F.col("p.c").alias("chunk"))
    return sse.parse(chunks)


_SSE = """
SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS position, event_type AS event, props || chr(10) || event_id AS data FROM events"""


def retry_log(spark: SparkSession, d: str) -> DataFrame:
    """Events as attempts of a request a user and day: the number of each, and whether it may be made again."""
    from pyspark.sql import Window

    e = table(spark, d, "events")
    attempt = F.row_number().over(Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")).cast("long")
    tokens = F.when(F.col("event_type") == "click", 0).otherwise(F.col("event_id") % 2)
    status: Column = F.when(F.col("event_type") == "error", 503).otherwise(200)
    numbered = e.withColumn("attempt", attempt)
    again = sse.may_retry(F.col("attempt"), tokens, F.lit(None).cast("string"), status)
    return numbered.select("event_id", "attempt", again.alias("again"), sse.backoff_ceiling_ms(F.col("attempt")).alias("ceiling_ms"))


_RETRY = """
SELECT event_id, attempt, event_id % 2 = 0 AND attempt < 3 AND event_type = 'error' AS again, least(8000, 1000 * pow(2, attempt - 1))::BIGINT AS ceiling_ms FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS attempt FROM events)"""

QUERIES = {
    f.__name__: f
    for f in (
        token_cost_ledger, usage_rollup, recent_calls, ledger_ring, budget_daily, budget_allow, span_tree, agent_run_totals, wrong_process, confusion_matrix,
        eval_two_views, threshold_sweep, sweep_sets, interleaving, gate_checks, gate_verdict, judge_agreement, dataset_problems, retrieval_metrics,
        extraction_assessment, repeated_lines, strip_repeated_lines, dedup_checksum, chunk_documents, chunk_conversations, document_stats, delete_cascade, identifier_extract,
        redact_pii, capture_modes, clean_text, order_status_authz, product_search, tool_outcomes, ticket_validation, extract_repair, model_routing,
        routing_summary, idle_gaps, ttft, sse_roundtrip, retry_log,
    )
}
SQL = {
    "token_cost_ledger": _LEDGER,
    "usage_rollup": _ROLLUP,
    "recent_calls": "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20",
    "ledger_ring": "SELECT event_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 500",
    "budget_daily": _DAILY,
    "budget_allow": _ALLOW,
    "span_tree": _SPANS,
    "agent_run_totals": f"{_RUNS} SELECT * FROM runs",
    "wrong_process": f"{_RUNS} SELECT run_id, tools FROM runs WHERE run_id % 2 = 0 AND NOT list_contains(string_split(tools, ','), 'get_order_status')",
    "confusion_matrix": f"WITH {_CASES} SELECT {_MEASURES} FROM cases",
    "eval_two_views": _VIEWS,
    "threshold_sweep": _SWEEP,
    "sweep_sets": _SETS,
    "interleaving": _INTERLEAVING,
    "gate_checks": _GATE,
    "gate_verdict": _VERDICT,
    "judge_agreement": _AGREEMENT,
    "dataset_problems": _PROBLEMS,
    "retrieval_metrics": _metrics_sql(),
    "extraction_assessment": _ASSESS,
    "repeated_lines": f"WITH {_REPEATED} SELECT document, key, n_pages FROM rep",
    "strip_repeated_lines": _STRIP,
    "dedup_checksum": "SELECT sha256(text) AS checksum, min(doc_id) AS document, count(*) AS copies FROM documents GROUP BY 1",
    "document_stats": "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings) AS embeddings, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS unembedded",
    "delete_cascade": _CASCADE,
    "identifier_extract": _IDENTIFIERS,
    "redact_pii": f"SELECT doc_id, {_REDACTED.format('text')} AS text FROM documents",
    "capture_modes": _CAPTURE,
    "clean_text": _CLEAN,
    "order_status_authz": _STATUS,
    "product_search": _PRODUCTS,
    "tool_outcomes": _OUTCOME,
    "ticket_validation": f"WITH {_TICKET} SELECT event_id, problems FROM t",
    "extract_repair": _REPAIR,
    "model_routing": _ROUTING,
    "routing_summary": _ROUTED,
    "idle_gaps": _GAPS,
    "ttft": _TTFT,
    "sse_roundtrip": _SSE,
    "retry_log": _RETRY,
}
