"""What a service around the model does, as tables: document lists, filters, traces, request bodies, frames, agent runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators import cache
from tessella.sources.scratch import Tables

#: Largest request body in bytes, seconds between heartbeats, model steps of an agent run.
BODY_BYTES = 1_000_000
HEARTBEAT_SECONDS = 15
MOST_STEPS = 6
#: Paths that are never traced.
UNTRACED = ("/health", "/ledger")

CASE = (
    "id string, doc string, question string, expect string, expected_pages array<int>, must_contain array<string>, must_not_contain array<string>, "
    "preferred_reason string, known_failure string, tags array<string>"
)


def golden_cases(spark: SparkSession, path: str) -> DataFrame:
    """Golden cases from JSON lines, by an explicit schema; fields that are missing are null."""
    return spark.read.schema(CASE).json(path)


def newest_first(docs: DataFrame, at: str = "created_at", key: str = "id") -> DataFrame:
    """Documents, newest first; of equal times the lowest key first, null times last."""
    return docs.orderBy(F.col(at).desc_nulls_last(), key)


def numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """Rows with their position (from 0) in an order of all of them.

    Rows are sorted by ranges and written with their place in their partition; the partitions' sizes, one row each, add
    up to where each begins. So no task sees more than its range.
    """
    tables = Tables(rows.sparkSession)
    placed = tables.keep(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    met = placed.withColumn("_part", part).join(F.broadcast(begins), "_part")
    return met.withColumn("position", F.col("_begin") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_begin", "_at")


def of_document(rows: DataFrame, document: int | None = None, column: str = "document_id") -> DataFrame:
    """Rows of one document, or all where none is named. The filter reaches the scan."""
    return rows if document is None else rows.where(F.col(column) == document)


def resolve_names(docs: DataFrame, aliases: dict[str, tuple[str, bool]]) -> DataFrame:
    """(alias, id): the newest document whose filename holds a text, or holds it not; null where there is none.

    aliases: alias to (text, whether the filename holds it). One pass for all aliases; docs has id, filename, created_at.
    """
    newest = lambda text, holds: F.max_by(F.when(fits(text, holds), F.col("id")), F.when(fits(text, holds), F.struct("created_at", -F.col("id"))))
    fits = lambda text, holds: F.contains(F.col("filename"), F.lit(text)) == F.lit(holds)
    rows = F.array(*[F.struct(F.lit(a).alias("alias"), newest(*rule).alias("id")) for a, rule in aliases.items()])
    return docs.agg(rows.alias("found")).select(F.explode("found").alias("f")).select("f.alias", "f.id")


def tagged(cases: DataFrame, tag: str | None = None) -> DataFrame:
    """Cases with a tag, or all where none is named."""
    return cases if tag is None else cases.where(F.array_contains("tags", tag))


def traced(requests: DataFrame, path: str = "path", untraced: Sequence[str] = UNTRACED) -> DataFrame:
    """Requests that are traced: not those of the paths that only look at the service."""
    return requests.where(~F.coalesce(F.col(path).isin(*untraced), F.lit(False)))


def tracing_disabled(trace_id: Column) -> Column:
    """A trace id of zeros only says that tracing is off."""
    return F.coalesce(trace_id.rlike("^0+$"), F.lit(False))


def costliest(runs: DataFrame, most: int, cost: str = "cost", key: str = "trace_id") -> DataFrame:
    """The runs of highest cost, that first; ties by key. Spark keeps ``most`` rows a task."""
    return runs.orderBy(F.desc(cost), key).limit(most)


def rupees(paise: Column) -> Column:
    """An amount in paise as text, with two decimals."""
    return F.concat(F.lit("₹"), (paise.cast("decimal(20,0)") / 100).cast("decimal(22,2)").cast("string"))


def iso_time(at: Column) -> Column:
    """UTC time as ISO text with milliseconds."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def http_time(at: Column) -> Column:
    """UTC time as RFC 1123 text."""
    return F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def rows_of(flat: Column, width: int) -> Column:
    """A flat buffer as rows of ``width``; a rest that fills no row goes."""
    full = F.floor(F.size(flat) / width).cast("int")
    rows = F.transform(F.sequence(F.lit(0), F.greatest(full - 1, F.lit(0))), lambda i: F.slice(flat, i * width + 1, width))
    return F.when(full > 0, rows).otherwise(F.array().cast("array<array<float>>"))


def names(listed: Column) -> Column:
    """Names of a comma-separated list: trimmed, in order, empty ones gone; none for null."""
    return F.filter(F.transform(F.split(F.coalesce(listed, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def available(tools: DataFrame, denied: Column) -> DataFrame:
    """Tools (tool, ...) that a comma-separated list of names does not deny."""
    return tools.where(~F.array_contains(names(denied), F.col("tool")))


def read_body(raw: Column, schema: str, most: int = BODY_BYTES) -> Column:
    """struct(problem, body) of a request body: ``too large`` beyond ``most`` bytes, ``invalid JSON``, or null and the fields.

    An empty or null body is an object without fields.
    """
    text = F.when(F.trim(F.coalesce(raw, F.lit(""))) == "", "{}").otherwise(raw)
    problem = F.when(F.octet_length(text) > most, "too large").when(F.try_parse_json(text).isNull(), "invalid JSON")
    return F.struct(problem.alias("problem"), F.when(problem.isNull(), F.from_json(text, schema)).alias("body"))


def heartbeats(frames: DataFrame, every: int = HEARTBEAT_SECONDS) -> DataFrame:
    """(stream_id, seq, beats): keep-alive comments that a writer sends before each frame (stream_id, seq, ts), one each
    ``every`` seconds without a frame; only frames that some precede."""
    before = F.lag("ts").over(Window.partitionBy("stream_id").orderBy("ts", "seq"))
    beats = F.floor(F.timestamp_diff("SECOND", before, F.col("ts")) / every)
    return frames.select("stream_id", "seq", beats.cast("long").alias("beats")).where("beats > 0")


def mock_tokens(prompts: DataFrame, fail_after: int = 3, wait_ms: int = 40) -> DataFrame:
    """Tokens of a mock model: (prompt_id, seq, event, token, at_ms) from (prompt_id, answer, mode).

    Each word is a token, the last event is ``done``. Mode ``slow`` doubles the waits, ``fail`` ends with ``error`` after
    some tokens, ``hang`` ends there without an event. A null answer is only done.
    """
    words = F.filter(F.split(F.coalesce("answer", F.lit("")), " "), lambda w: w != "")
    broken = F.col("mode").isin("fail", "hang")
    said = F.when(broken, F.slice(words, 1, fail_after)).otherwise(words)
    rows = F.transform(said, lambda w: F.struct(F.lit("token").alias("event"), w.alias("token")))
    last = F.struct(F.when(F.col("mode") == "fail", "error").otherwise("done").alias("event"), F.lit(None).cast("string").alias("token"))
    events = F.when(F.col("mode") == "hang", rows).otherwise(F.concat(rows, F.array(last)))
    step = F.when(F.col("mode") == "slow", 2 * wait_ms).otherwise(wait_ms)
    spread = prompts.select("prompt_id", step.alias("step"), F.posexplode(events).alias("seq", "e"))
    return spread.select("prompt_id", F.col("seq").cast("long").alias("seq"), "e.event", "e.token", (F.col("step") * (F.col("seq") + 1)).cast("long").alias("at_ms"))


def agent_runs(steps: DataFrame, most: int = MOST_STEPS) -> DataFrame:
    """What became of recorded agent runs: (run_id, steps, tool_calls, outcome) from (run_id, step, kind, tool_calls).

    A run ends at its first step of kind ``final`` (answered) or ``approval`` (awaiting approval) within ``most`` steps;
    else it met the limit, or is unfinished where it has fewer. Steps past the end count for nothing.
    """
    inside = F.col("step") <= most
    end = F.min(F.when(inside & F.col("kind").isin("final", "approval"), F.struct("step", "kind")))
    runs = steps.groupBy("run_id").agg(end.alias("end"), F.max("step").alias("last"))
    ended = runs.select("run_id", F.coalesce("end.step", F.least("last", F.lit(most))).cast("long").alias("steps"), "end.kind", "last")
    outcome = (
        F.when(F.col("kind") == "final", "answered")
        .when(F.col("kind") == "approval", "awaiting approval")
        .when(F.col("last") >= most, "step limit")
        .otherwise("unfinished")
    )
    made = steps.join(ended, "run_id").where("step <= steps").groupBy("run_id").agg(F.sum("tool_calls").alias("tool_calls"))
    return ended.join(made, "run_id").select("run_id", "steps", "tool_calls", outcome.alias("outcome"))


def serve(requests: DataFrame, spend: DataFrame, entries: DataFrame, now: Column, limit_nano: int, threshold: float = cache.THRESHOLD) -> DataFrame:
    """Budget, cache, model, in this order, for a batch of requests: (request_id, source, reason, entry_id, cost_nano, stored).

    requests: request_id, user_id, q, ids, tools_used, cost_nano (what the model would cost); spend: user_id, spent_nano
    of the day. All requests of a batch see the budget and the cache as they are at its start. A tenant at its limit is
    rejected, a hit costs nothing, and a model's answer is stored where it used no tool.
    """
    tenant = cache.namespace().alias("tenant")
    spent = spend.select(tenant, "spent_nano").groupBy("tenant").agg(F.sum("spent_nano").alias("spent_nano"))
    asked = requests.select(tenant, "*").join(spent, "tenant", "left")
    over = F.coalesce(F.col("spent_nano") >= limit_nano, F.lit(False))
    found = cache.request(requests, entries, now, threshold).select("request_id", "hit", F.col("reason").alias("miss"), "entry_id")
    both = asked.withColumn("over", over).join(found, "request_id")
    source = F.when(F.col("over"), "rejected").when(F.col("hit"), "cache").otherwise("model")
    modelled = source == "model"
    return both.select(
        "request_id",
        source.alias("source"),
        F.when(F.col("over"), "budget").when(modelled, F.col("miss")).alias("reason"),
        F.when(source == "cache", F.col("entry_id")).alias("entry_id"),
        F.when(modelled, F.col("cost_nano")).otherwise(0).cast("long").alias("cost_nano"),
        (modelled & cache.cacheable(F.col("tools_used"))).alias("stored"),
    )
