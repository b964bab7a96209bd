"""Evaluation of a retrieval and answering system: per-case scores, aggregates, threshold sweep, gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.sources.scratch import Tables

#: Thresholds of the sweep, and the gate's checks (name, bound, whether the bound is a maximum).
THRESHOLDS = (0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.6, 0.7)
GATE = (
    ("false_accept_rate", 0.0, True),
    ("false_refusal_rate", 0.2, True),
    ("recall", 0.8, False),
    ("mrr", 0.6, False),
    ("coverage", 0.8, False),
)


def behaviour(expect: Column, answered: Column) -> Column:
    """One of the four cells of expected against actual behaviour."""
    return (
        F.when((expect == "answer") & answered, "true_accept")
        .when(expect == "answer", "false_refusal")
        .when(answered, "false_accept")
        .otherwise("true_refusal")
    )


def retrieval_scores(expected: Column, retrieved: Column) -> Column:
    """struct(found, missed, hit, coverage, reciprocal_rank); null where nothing is expected.

    Expected pages keep their order and repeats; the rank is that of the first retrieved page which is expected.
    """
    found = F.filter(expected, lambda p: F.array_contains(retrieved, p))
    missed = F.filter(expected, lambda p: ~F.array_contains(retrieved, p))
    first = F.array_position(F.transform(retrieved, lambda p: F.array_contains(expected, p)), True)
    scores = F.struct(
        found.alias("found"),
        missed.alias("missed"),
        (F.size(found) > 0).alias("hit"),
        F.try_divide(F.size(found).cast("double"), F.size(expected)).alias("coverage"),
        F.when(first > 0, 1.0 / first).otherwise(0.0).alias("reciprocal_rank"),
    )
    return F.when(expected.isNotNull(), scores)


def summary(cases: DataFrame, within: Column | None = None) -> list[Column]:
    """Aggregates over scored cases (behaviour, hit, coverage, mrr): the confusion matrix and null-safe rates.

    A rate without cases to measure it is null, not 0.
    """
    on = within if within is not None else F.lit(True)
    n = lambda b: F.count_if(on & (F.col("behaviour") == b))
    cells = ["true_accept", "false_accept", "true_refusal", "false_refusal"]
    ratio = lambda a, b: F.round(F.try_divide(a.cast("double"), b), 9)
    measured = on & F.col("hit").isNotNull()
    mean = lambda c: F.round(F.avg(F.when(measured, c)), 9)
    return [
        *[n(c).alias(c) for c in cells],
        ratio(n("false_accept"), n("false_accept") + n("true_refusal")).alias("false_accept_rate"),
        ratio(n("false_refusal"), n("false_refusal") + n("true_accept")).alias("false_refusal_rate"),
        mean(F.col("hit").cast("int")).alias("recall"),
        mean(F.col("mrr")).alias("mrr"),
        mean(F.col("coverage")).alias("coverage"),
        F.count_if(measured).alias("retrieval_cases"),
    ]


def two_views(cases: DataFrame) -> DataFrame:
    """The summary of all cases and of those without a known failure, in one pass: rows view, n, and the measures."""
    both = cases.withColumn("view", F.explode(F.when(F.col("known_failure"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("tracked")))))
    return both.groupBy("view").agg(F.count("*").alias("n"), F.count_if("known_failure").alias("known"), *summary(cases))


def sweep(observations: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Recorded observations (expect, best_similarity, model_answered) replayed at each threshold.

    A row is spread to the thresholds inside the scan and summed on the map side, so nothing but twelve rows a task
    is shuffled. Here an empty denominator gives 0, unlike in ``summary``.
    """
    spread = observations.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    gated = F.col("best_similarity") < F.col("threshold")
    answered = ~gated & F.col("model_answered")
    answer = F.col("expect") == "answer"
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(F.count_if(a).cast("double"), F.count_if(b)), F.lit(0.0)), 9)
    return spread.groupBy("threshold").agg(
        F.count_if(~answer & answered).alias("false_accept"),
        F.count_if(answer & ~answered).alias("false_refusal"),
        ratio(~answer & answered, ~answer).alias("false_accept_rate"),
        ratio(answer & ~answered, answer).alias("false_refusal_rate"),
        ratio(gated, F.lit(True)).alias("gated_fraction"),
        F.count_if(~gated).alias("model_calls"),
    )


def sweep_sets(swept: DataFrame) -> DataFrame:
    """Thresholds without false accepts, without false refusals, and without either, in order."""
    pick = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("threshold"))))
    no_accept, no_refusal = F.col("false_accept") == 0, F.col("false_refusal") == 0
    return swept.agg(pick(no_accept).alias("no_false_accept"), pick(no_refusal).alias("no_false_refusal"), pick(no_accept & no_refusal).alias("clean"))


def interleaving(observations: DataFrame) -> DataFrame:
    """For each refuse case, the number of answer cases of strictly lower similarity: (id, best_similarity, blocks).

    Answers are counted by distinct similarity before anything moves. The distinct values are sorted by ranges and
    written; each range adds up its own counts, and the ranges' sums, one row each, add up to where a range begins. A
    refuse case then looks its value up. So no pair of cases is built, and neither a frequent value nor a dense interval
    is one task. A case without similarity has none below it and is below none.
    """
    counted = observations.where("best_similarity is not null").groupBy("best_similarity").agg(F.count_if(F.col("expect") == "answer").alias("n"))
    placed = Tables(observations.sparkSession).keep(counted.orderBy("best_similarity").withColumn("part", F.spark_partition_id()), "values")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = placed.groupBy("part").agg(F.sum("n").alias("n")).select("part", before(Window.orderBy("part")).alias("begin"))
    within = placed.withColumn("own", before(Window.partitionBy("part").orderBy("best_similarity")))
    # One row a partition of the sort.
    below = within.join(F.broadcast(begins), "part").select("best_similarity", (F.col("begin") + F.col("own")).alias("blocks"))
    refused = observations.where("expect = 'refuse'").select("id", "best_similarity")
    return refused.join(below, "best_similarity", "left").select("id", "best_similarity", F.coalesce("blocks", F.lit(0)).cast("long").alias("blocks"))


def gate(measures: DataFrame, checks=GATE) -> DataFrame:
    """One row a check: (name, value, bound, measured, ok); an unmeasured value is ok."""
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.col(name).cast("double").alias("value"),
                F.lit(float(bound)).alias("bound"),
                F.col(name).isNotNull().alias("measured"),
                F.coalesce(F.col(name) <= bound if most else F.col(name) >= bound, F.lit(True)).alias("ok"),
            )
            for name, bound, most in checks
        ]
    )
    return measures.select(F.explode(rows).alias("c")).select("c.*")


def gate_verdict(checks: DataFrame) -> DataFrame:
    """One row: the gate passes if every check is ok and at least one was measured; fatal if none was."""
    return checks.agg(
        (F.bool_and("ok") & (F.count_if("measured") > 0)).alias("passed"),
        (F.count_if("measured") == 0).alias("fatal"),
        F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("name")))).alias("failed"),
    )


def judge_score(claims: Column) -> Column:
    """Share of supported claims: 0 without claims, null where the judge's reply could not be read."""
    supported = F.size(F.filter(claims, lambda c: c["supported"]))
    return F.when(claims.isNull(), None).when(F.size(claims) == 0, 0.0).otherwise(supported / F.size(claims))


def agreement(human: DataFrame, judged: DataFrame) -> DataFrame:
    """Agreement of a judge with human labels (id, label): the denominator counts every label, also skipped ones."""
    both = human.join(judged.withColumnRenamed("label", "verdict"), "id", "left")
    same = F.count_if(F.col("label") == F.col("verdict"))
    return both.agg(F.count("*").alias("labelled"), same.alias("agreed"), F.round(F.try_divide(same.cast("double"), F.count("*")), 9).alias("agreement"))


def dataset_problems(cases: DataFrame) -> DataFrame:
    """Problems of a golden set, one row each: (id, problem).

    A case that expects an answer needs something to check, so empty lists count as none; one that expects a refusal must
    not state pages or strings at all, not even in an empty list.
    """
    has = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    problems = F.array_compact(
        F.array(
            F.when(F.coalesce(F.col("id"), F.lit("")) == "", "missing id"),
            F.when(F.coalesce(F.col("question"), F.lit("")) == "", "missing question"),
            F.when(~F.coalesce(F.col("expect").isin("answer", "refuse"), F.lit(False)), "bad expect"),
            F.when((F.col("expect") == "answer") & ~has("expected_pages") & ~has("must_contain"), "answer without a check"),
            F.when((F.col("expect") == "refuse") & (F.col("must_contain").isNotNull() | F.col("expected_pages").isNotNull()), "refuse with a check"),
        )
    )
    own = cases.select("id", F.explode(problems).alias("problem"))
    twice = cases.where("id is not null").groupBy("id").count().where("count > 1").select("id", F.lit("duplicate id").alias("problem"))
    return own.unionByName(twice)


def score_cases(results: DataFrame, plain=lambda c: c, plain_all=lambda c: c) -> DataFrame:
    """Verdict of each case: (id, behaviour, passed, failures, fixed_known, reason_note), failures in a fixed order.

    results: id, expect, expected_pages, retrieved_pages, must_contain, must_not_contain, answer, grounded, reason,
    preferred_reason, known_failure. Behaviour counts first, then retrieval where pages are expected, then strings.
    A reason other than the preferred one is only noted. A null ``grounded`` is not answered. ``plain`` is what the
    answer is compared by, ``plain_all`` the same of lists.
    """
    answered = F.coalesce("grounded", F.lit(False))
    retrieval = retrieval_scores(F.col("expected_pages"), F.coalesce("retrieved_pages", F.array().cast("array<int>")))
    compared = results.withColumns({"said": plain(F.col("answer")), "must": plain_all(F.col("must_contain")), "never": plain_all(F.col("must_not_contain"))})
    scored = compared.withColumns(
        {
            "behaviour": behaviour(F.col("expect"), answered),
            "hit": retrieval["hit"],
            "strings": T.check_strings(F.col("said"), F.col("must_contain"), F.col("must_not_contain"), F.col("must"), F.col("never")),
        }
    )
    listed = lambda c: F.array_join(c, ", ")
    failures = F.array_compact(
        F.array(
            F.when(F.col("behaviour") == "false_accept", "answered when it should have refused"),
            F.when(F.col("behaviour") == "false_refusal", "refused when it should have answered"),
            F.when(~F.col("hit"), F.concat(F.lit("expected page(s) "), F.array_join(F.col("expected_pages").cast("array<string>"), ","), F.lit(" not retrieved"))),
            F.when(F.size("strings.missing") > 0, F.concat(F.lit("answer missing: "), listed("strings.missing"))),
            F.when(F.size("strings.forbidden") > 0, F.concat(F.lit("answer contains forbidden: "), listed("strings.forbidden"))),
        )
    )
    known = F.coalesce("known_failure", F.lit("")) != ""
    other = F.col("preferred_reason").isNotNull() & ~F.col("reason").eqNullSafe(F.col("preferred_reason"))
    note = F.concat(F.lit('caught by "'), F.coalesce("reason", F.lit("null")), F.lit('" rather than the usual "'), "preferred_reason", F.lit('"'))
    return scored.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0).select(
        *results.columns, "behaviour", "hit", "passed", "failures", (known & F.col("passed")).alias("fixed_known"), F.when(other, note).alias("reason_note")
    )


CLAIMS = "claims array<struct<claim string, supported boolean, evidence string>>, verdict string"
#: Verdicts of the groundedness judge.
VERDICTS = ("fully_grounded", "partially_grounded", "not_grounded")


def groundedness(reply: Column) -> Column:
    """struct(verdict, claims, unsupported, score) of a judge's reply; ``judge_failed`` without a score if it cannot be read.

    The score is the share of supported claims, 0 without claims, whatever the judge's own verdict.
    """
    parsed = F.from_json(T.strip_fences(reply), CLAIMS)
    complete = F.forall(parsed["claims"], lambda c: c["claim"].isNotNull() & c["supported"].isNotNull())
    read = F.coalesce(parsed["claims"].isNotNull() & parsed["verdict"].isin(*VERDICTS) & complete, F.lit(False))
    claims = F.when(read, parsed["claims"])
    return F.struct(
        F.when(read, parsed["verdict"]).otherwise("judge_failed").alias("verdict"),
        F.coalesce(F.size(claims), F.lit(0)).cast("long").alias("claims"),
        F.when(read, F.size(F.filter(claims, lambda c: ~c["supported"]))).cast("long").alias("unsupported"),
        judge_score(claims).alias("score"),
    )


def refusal(reply: Column) -> Column:
    """struct(correct, reasoning) of a refusal judge's reply; both null if it cannot be read."""
    parsed = F.from_json(T.strip_fences(reply), "correct boolean, reasoning string")
    read = parsed["correct"].isNotNull() & parsed["reasoning"].isNotNull()
    return F.struct(F.when(read, parsed["correct"]).alias("correct"), F.when(read, parsed["reasoning"]).alias("reasoning"))


def override(scores: DataFrame, judged: DataFrame) -> DataFrame:
    """Scores (id, grounded, passed, failures, ...) after the judge (id, reply): an answered case with a score under 1 fails.

    A reply that cannot be read, or none, changes nothing.
    """
    joined = scores.join(judged.select("id", groundedness(F.col("reply")).alias("judge")), "id", "left")
    fails = F.coalesce(F.col("grounded") & (F.col("judge.score") < 1), F.lit(False))
    more = F.concat(F.lit("judge: "), F.col("judge.unsupported").cast("string"), F.lit(" unsupported claim(s)"))
    return joined.withColumns(
        {
            "passed": F.col("passed") & ~fails,
            "failures": F.when(fails, F.concat("failures", F.array(more))).otherwise(F.col("failures")),
            "judge_score": F.col("judge.score"),
        }
    ).drop("judge")


def diagnosis(passed: Column, hit: Column, acts: Column, judged: Column) -> Column:
    """Which half of a failed case broke: ``retrieval`` before ``answering``; null where neither is shown."""
    answering = acts.isin("false_accept", "false_refusal") | F.coalesce(judged < 1, F.lit(False))
    return F.when(~passed, F.when(~hit, "retrieval").when(answering, "answering"))


def totals(scores: DataFrame) -> DataFrame:
    """One row a view (``all``, ``tracked`` without known failures): cases, passed, failed, known, sums of cost and latency."""
    known = F.coalesce("known_failure", F.lit("")) != ""
    views = F.when(known, F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("tracked")))
    seen = scores.withColumn("known", known).withColumn("view", F.explode(views))
    return seen.groupBy("view").agg(
        F.count("*").alias("cases"),
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed") & ~F.col("known")).alias("failed"),
        F.count_if("known").alias("known"),
        F.count_if("fixed_known").alias("fixed"),
        F.sum("cost_nano").alias("cost_nano"),
        F.sum("latency_ms").alias("latency_ms"),
    )


def report_lines(summaries: DataFrame) -> DataFrame:
    """(view, line): the one-line summary of each view of ``totals``."""
    rate = F.round(F.try_divide(100.0 * F.col("passed"), F.col("cases")))
    line = F.concat(
        F.col("passed").cast("string"), F.lit("/"), F.col("cases").cast("string"), F.lit(" passed ("), F.coalesce(rate.cast("long").cast("string"), F.lit("-")),
        F.lit("%), "), F.col("failed").cast("string"), F.lit(" failed, "), F.col("known").cast("string"), F.lit(" known"),
    )
    return summaries.select("view", line.alias("line"))
