"""URL filter: host and path rules first, then a ratio of two character language models.

DataFrame functions only. Two variable-order Markov models (interpolated Witten-Bell smoothing, orders
up to 3) are counted over the URLs that a rule accepts and over those that a rule rejects. Both are held
as one array of log ratios over all grams of a 32-letter alphabet, so what travels to the tasks has a
fixed size (32^4 doubles, 8 MB), whatever the corpus. A URL's score is the mean log ratio of its
characters; the verdict compares it with a threshold calibrated on rule-labelled URLs left out of counting.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters of the model; a URL's other characters count as the last one, digits as 0. Code 0 pads the start.
LETTERS = "abcdefghijklmnopqrstuvwxyz0/.-~"
SYMBOLS = 32
ORDER = 4
#: One labelled URL in five calibrates the threshold and is not counted.
CALIBRATE = 5
#: Steps of the calibrated threshold in a unit of mean log ratio.
STEPS = 100

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains and the paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def url_parts(url: str | Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null URL or one without ``://``."""
    part = lambda n: F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", n), F.lit(""))
    return F.translate(part(1), _UPPER, _UPPER.lower()), part(2)


def scored_text(url: str | Column) -> Column:
    """What the models see: the whole URL after its scheme, with query and fragment; all of one without a scheme."""
    return F.coalesce(F.regexp_replace(url, r"^[^:/?#]*://", ""), F.lit(""))


def matched_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """struct(size, name, verdict) of the longest rule that fits, else null; equal lengths go by name."""
    fits = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(F.lit(len(r.name)).alias("size"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict")),
        )
        for r in rules
    ]
    return F.array_max(F.array(*fits))


def grams(text: Column) -> Column:
    """Codes of the grams that end at each character, as numbers below 32^4; empty for an empty text."""
    plain = F.regexp_replace(F.regexp_replace(F.translate(text, _UPPER, _UPPER.lower()), "[0-9]", "0"), "[^a-z0/.-]", "~")
    codes = F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.instr(F.lit(LETTERS), c))
    back = lambda a, i, k: F.coalesce(F.get(a, i - k), F.lit(0)) * SYMBOLS**k
    # The codes go through a one-element array so that each is computed once, not once a position.
    return F.flatten(
        F.transform(
            F.array(codes),
            lambda a: F.transform(a, lambda c, i: c + back(a, i, 1) + back(a, i, 2) + back(a, i, 3)),
        )
    )


def log_ratios(labelled: DataFrame) -> DataFrame:
    """One row with ``weights``: at index g, ln P(letter | context) of accepted minus that of rejected URLs.

    ``labelled`` has grams and accepted (boolean). Counts cover all its rows; they are summed on the map side
    first, and every table here has at most 32^4 rows.
    """
    spark = labelled.sparkSession
    seen = (
        labelled.select("accepted", F.explode("grams").alias("gram"))
        .groupBy("gram")
        .agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r"))
    )
    below = None
    for k in range(1, ORDER + 1):
        counted = seen.groupBy((F.col("gram") % SYMBOLS**k).alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        context = counted.groupBy(F.floor(F.col("g") / SYMBOLS).alias("ctx")).agg(
            F.sum("a").alias("na"), F.sum("r").alias("nr"), F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("r") > 0).alias("tr")
        )
        table = spark.range(SYMBOLS**k).select(
            F.col("id").alias("g"), F.floor(F.col("id") / SYMBOLS).alias("ctx"), (F.col("id") % SYMBOLS ** (k - 1)).alias("low")
        )
        table = table.join(counted, "g", "left").join(context, "ctx", "left").na.fill(0)
        if below is None:
            table = table.withColumns({"pa0": F.lit(1.0 / SYMBOLS), "pr0": F.lit(1.0 / SYMBOLS)})
        else:
            table = table.join(below.select(F.col("g").alias("low"), F.col("pa").alias("pa0"), F.col("pr").alias("pr0")), "low")
        mixed = lambda n, total, kinds, low: F.when(
            F.col(total) > 0, (F.col(n) + F.col(kinds) * F.col(low)) / (F.col(total) + F.col(kinds))
        ).otherwise(F.col(low))
        below = table.select("g", mixed("a", "na", "ta", "pa0").alias("pa"), mixed("r", "nr", "tr", "pr0").alias("pr"))
    weight = F.log("pa") - F.log("pr")
    ordered = F.array_sort(F.collect_list(F.struct("g", weight.alias("w"))))
    return below.agg(F.transform(ordered, lambda x: x["w"]).alias("weights"))


def mean_ratio(weights: Column, codes: Column) -> Column:
    """Length-normalised log-likelihood difference; 0 for an empty text."""
    total = F.aggregate(codes, F.lit(0.0), lambda s, g: s + F.get(weights, g.cast("int")))
    return F.when(F.size(codes) > 0, total / F.size(codes)).otherwise(F.lit(0.0))


def threshold(scored: DataFrame) -> DataFrame:
    """One row: the score that best parts accepted from rejected (mean of both error rates), from steps of 0.01.

    ``scored`` has score and accepted. 0 where a class is missing. Of a gap without scores the middle is taken; ties
    go to the value nearest to 0. The histogram has one row a step, which the models' smallest probability bounds.
    """
    steps = (
        scored.groupBy(F.floor(F.col("score") * STEPS).alias("step"))
        .agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r"))
    )
    upward = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    errors = steps.select(
        "step",
        ((F.col("step") + F.coalesce(F.lag("step").over(Window.orderBy("step")) + 1, F.col("step"))) / 2).alias("cut"),
        F.coalesce(F.sum("a").over(upward), F.lit(0)).alias("missed"),
        F.coalesce(F.sum("r").over(upward), F.lit(0)).alias("caught"),
        F.sum("a").over(every).alias("all_a"),
        F.sum("r").over(every).alias("all_r"),
    ).where("all_a > 0 and all_r > 0")
    error = F.col("missed") / F.col("all_a") + (F.col("all_r") - F.col("caught")) / F.col("all_r")
    best = errors.agg(F.min(F.struct(F.round(error, 12).alias("e"), F.abs("cut").alias("far"), "cut")).alias("best"))
    return best.select(F.coalesce(F.col("best.cut") / STEPS, F.lit(0.0)).alias("threshold"))


def judge(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """Verdict of every URL: the longest fitting rule's, else the models'.

    Returns page_id, host, path, rule, verdict, score. The models see whole URLs (``scored_text``), so one without a
    host is judged by its characters too. A null URL has an empty host and path, no rule and score 0. An empty table
    gives no rows. Without URLs of both labels all ratios are 0 and the threshold is 0, so URLs without a rule are allowed.
    Repeated rows are judged alike; other columns are not read.
    """
    host, path = url_parts("url")
    parts = pages.select("page_id", host.alias("host"), path.alias("path"), scored_text("url").alias("told"))
    codes = grams(F.col("told"))
    ruled = parts.withColumn("hit", matched_rule(rules, F.col("host"), F.col("path")))
    labelled = ruled.where(F.col("hit").isNotNull()).select(
        (F.col("hit.verdict") == "allow").alias("accepted"),
        codes.alias("grams"),
        (F.pmod(F.xxhash64("told"), F.lit(CALIBRATE)) == 0).alias("held_out"),
    )
    weights = log_ratios(labelled.where(~F.col("held_out"))).scalar()
    scored = labelled.where("held_out").withColumn("weights", weights)
    scored = scored.select("accepted", mean_ratio(F.col("weights"), F.col("grams")).alias("score"))
    score = F.when(F.col("hit").isNull(), mean_ratio(F.col("weights"), codes))
    by_model = F.when(F.col("score") >= threshold(scored).scalar(), F.lit("allow")).otherwise(F.lit("block"))
    return ruled.withColumn("weights", weights).withColumn("score", score).select(
        "page_id",
        "host",
        "path",
        F.col("hit.name").alias("rule"),
        F.when(F.col("hit").isNotNull(), F.col("hit.verdict")).otherwise(by_model).alias("verdict"),
        "score",
    )
