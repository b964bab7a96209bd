"""Token and cost ledgers, daily budgets, routing, spans and agent runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.sources.scratch import shared_folder

#: List prices in USD per million tokens (input, output), and those of unlisted models.
PRICES = (
    ("openai/gpt-oss-120b", 0.15, 0.6),
    ("openai/gpt-oss-20b", 0.075, 0.3),
    ("qwen/qwen3.8-27b", 0.1, 0.4),
    ("gemini-2.0-flash", 0.1, 0.4),
)
DEFAULT_PRICE = (0.1, 0.4)
#: Calls that a bounded ledger keeps.
RING = 500


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRICES), "model string, input_per_m double, output_per_m double")


def priced(calls: DataFrame, price_list: DataFrame) -> DataFrame:
    """Calls with usd, output_usd and estimated (the model has no listed price).

    Prices are of few models; each call's cost is a count of 1e-9 USD first, so sums do not depend on their order.
    """
    p_in = F.coalesce("input_per_m", F.lit(DEFAULT_PRICE[0]))
    p_out = F.coalesce("output_per_m", F.lit(DEFAULT_PRICE[1]))
    nano = lambda tokens, price: F.round(F.coalesce(tokens, F.lit(0)) * price * 1000).cast("long")
    joined = calls.join(price_list, "model", "left")
    return joined.select(
        *[joined[c] for c in calls.columns],
        (nano("input_tokens", p_in) + nano("output_tokens", p_out)).alias("nano_usd"),
        nano("output_tokens", p_out).alias("nano_output_usd"),
        F.col("input_per_m").isNull().alias("estimated"),
    )


def usd(nano: Column) -> Column:
    return F.round(F.coalesce(nano, F.lit(0)) / 1e9, 9)


def rollup(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Total and one breakdown by each key: (dimension, value, calls, tokens in and out, usd, output_share).

    One pass with grouping sets. Rows without a key are left out of its breakdown, not out of the total.
    """
    measures = [
        F.count("*").alias("calls"),
        F.sum("input_tokens").cast("long").alias("input_tokens"),
        F.sum("output_tokens").cast("long").alias("output_tokens"),
        F.sum("nano_usd").alias("nano"),
        F.sum("nano_output_usd").alias("nano_out"),
        F.grouping_id().alias("gid"),
    ]
    sets = [[], *[[F.col(k)] for k in keys]]
    grouped = calls.groupingSets(sets, *[F.col(k) for k in keys]).agg(*measures)
    every = 2 ** len(keys) - 1
    bit = {k: every - 2 ** (len(keys) - 1 - i) for i, k in enumerate(keys)}
    dimension = F.when(F.col("gid") == every, "total")
    value = F.when(F.col("gid") == every, "")
    for k in keys:
        dimension = dimension.when(F.col("gid") == bit[k], k)
        value = value.when(F.col("gid") == bit[k], F.col(k).cast("string"))
    return (
        grouped.select("*", dimension.alias("dimension"), value.alias("value"))
        .where("value is not null and (dimension = 'total' or value <> '')")
        .select(
            "dimension",
            "value",
            "calls",
            "input_tokens",
            "output_tokens",
            usd(F.col("nano")).alias("usd"),
            F.round(F.coalesce(F.try_divide("nano_out", "nano"), F.lit(0.0)), 9).alias("output_share"),
        )
    )


def recent(rows: DataFrame, at: str, tie: str, n: int) -> DataFrame:
    """The last n rows, newest first; a top-k report."""
    return rows.orderBy(F.desc(at), F.desc(tie)).limit(n)


def daily_spend(spend: DataFrame) -> DataFrame:
    """(user_id, day, spent) by UTC day, from (user_id, ts, nano_usd)."""
    return spend.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("nano_usd").alias("nano_usd"))


def budget_status(daily: DataFrame, limit_nano: int) -> DataFrame:
    """Spent, remaining, percent used (at most 100) and whether the next call is allowed, by user and day."""
    left = F.greatest(F.lit(limit_nano) - F.col("nano_usd"), F.lit(0))
    return daily.select(
        "user_id",
        "day",
        usd(F.col("nano_usd")).alias("spent"),
        usd(left).alias("remaining"),
        F.least(F.lit(100), F.round(100.0 * F.col("nano_usd") / limit_nano)).cast("long").alias("percent_used"),
        (left > 0).alias("allowed"),
    )


def allowed_calls(spend: DataFrame, limit_nano: int, order: str) -> DataFrame:
    """Whether each call was let through: the day's earlier calls cost less than the limit, so one may overshoot.

    With costs of at least 0 the sum over all earlier calls decides as the sum over the allowed ones would.
    """
    before = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("nano_usd").over(before), F.lit(0))
    return spend.withColumn("nano_before", spent).withColumn("allowed", spent < limit_nano)


def throughput(tokens: Column, duration_ms: Column) -> Column:
    """Output tokens a second, 0 without a duration."""
    return F.coalesce(F.round(F.try_divide(tokens * 1000.0, duration_ms)), F.lit(0.0)).cast("long")


def break_even(cheap: tuple[float, float], strong: tuple[float, float], shape: tuple[int, int] = (1000, 300)) -> dict[str, float]:
    """Cost ratio of two models on a call of the given tokens, and the escalation rate at which routing stops paying."""
    cost = lambda price: (shape[0] * price[0] + shape[1] * price[1]) / 1e6
    ratio = cost(cheap) / cost(strong)
    return {"cost_ratio": round(ratio, 3), "max_escalation_rate": round(1 - ratio, 3)}


def span_tree(spans: DataFrame) -> DataFrame:
    """Depth and root of every span, by pointer jumping on the parent column: (trace_id, span_id, depth, root_id).

    Each step doubles the distance covered and cuts the lineage, until every pointer is at a root; so a tree of depth d
    takes log2(d) joins on (trace_id, span_id), whatever d is. A span whose parent is missing is a root. Spans that
    reach no root, as their parents form a cycle, are left out.
    """
    shared_folder(spans.sparkSession)
    ids = spans.select("trace_id", F.col("span_id").alias("up"))
    known = spans.select("trace_id", "span_id", F.col("parent_span_id").alias("up")).join(
        ids.withColumn("there", F.lit(True)), ["trace_id", "up"], "left"
    )
    state = known.select(
        "trace_id", "span_id", F.when(F.col("there"), F.col("up")).alias("up"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("depth")
    ).checkpoint()
    # No span is deeper than its trace has spans.
    most = spans.groupBy("trace_id").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while True:
        upper = state.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"))
        jumped = state.join(upper, ["trace_id", "up"], "left").select(
            "trace_id",
            "span_id",
            F.coalesce("up2", "up").alias("up"),
            # Past the root there is nothing to add.
            (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"),
            F.col("up2").isNotNull().alias("moved"),
        ).checkpoint()
        reach *= 2
        moving = jumped.where("moved").limit(1).count()
        if not moving or reach > 2 * most:
            return jumped.where("not moved").select("trace_id", "span_id", "depth", F.coalesce("up", "span_id").alias("root_id"))
        state = jumped.drop("moved")


def run_totals(turns: DataFrame) -> DataFrame:
    """Totals of each run and its tools in order: (run_id, tokens, nano_usd, iterations, tools)."""
    ordered = F.array_sort(F.collect_list(F.when(F.col("tool").isNotNull(), F.struct("seq", "tool"))))
    return turns.groupBy("run_id").agg(
        F.sum("tokens").cast("long").alias("tokens"),
        F.sum("nano_usd").cast("long").alias("nano_usd"),
        F.max("iteration").cast("long").alias("iterations"),
        F.transform(ordered, lambda x: x["tool"]).alias("tools"),
    )


def wrong_process(runs: DataFrame, required: Column) -> DataFrame:
    """Runs that answered without the tool that they needed."""
    return runs.where(required.isNotNull() & ~F.array_contains("tools", required))
