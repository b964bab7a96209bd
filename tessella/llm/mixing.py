"""Mixing of sources to target weights by hash-threshold histograms (DataFrame functions only).

Each source gets a target in words. Whole copies of a source come first (target // size); the rest of
the target is met by the documents whose 36-bit hash lies below a threshold. The threshold is found
without sorting documents: words are summed by (source, hash bucket), the bucket in which the running
sum passes the budget is refined on the next hash bits, and so on, so each level reads only one bucket
of each source. Thresholds nest: a larger budget takes a superset of documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import written, word_count

#: Bits of the hash that each level resolves; three levels resolve 36 bits.
LEVEL_BITS = 12
LEVELS = 3


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Targets by source from (source, source_size): min(cap * size, level * weight).

    The level is the one at which the targets sum to ``share`` of all sizes, which is where repeated
    resharing of what exceeds the caps ends. Weights go to the sources by code point, null last, and repeat.
    The frame has one row a source, so its global windows hold names of sources only.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (
        sizes.withColumn("rank", F.row_number().over(named))
        .withColumn("weight", F.element_at(cycle, (F.col("rank") - 1) % len(weights) + 1))
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
    )
    filled = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    levelled = (
        ranked.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("capped", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("budget") - F.col("capped")) / F.col("open"))
        .withColumn("fits", F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level")))
        .withColumn("level", F.max("fits").over(every))
    )
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(
        F.least(F.col("most"), F.col("level") * F.col("weight"))
    )
    return levelled.select("source", "source_size", target.alias("target"))


def _bits(level: int):
    """Bits of the hash that level 0, 1, ... resolves, highest first."""
    return F.shiftright("hash", LEVEL_BITS * (LEVELS - 1 - level)).bitwiseAND(F.lit(2**LEVEL_BITS - 1))


def _sized(docs: DataFrame, seed: int, *columns: str) -> DataFrame:
    """Size, hash and source key of each document, with the named columns.

    The hash is the start of an MD5 sum, which any engine can compute, so that a mix can be checked outside of Spark.
    """
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    return docs.select(
        *columns,
        word_count("text").alias("size"),
        F.conv(F.left(F.md5(said), F.lit(LEVEL_BITS * LEVELS // 4)), 16, 10).cast("long").alias("hash"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"),
    )


def _copies() -> Column:
    """How often the mix takes a document: whole copies, and one more below the threshold of its source."""
    return F.col("copies") + (F.col("hash") < F.col("cut")).cast("long")


def repeat(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """The mix itself: each document as often as ``mix`` takes it, with all its columns; those not taken go."""
    sized = written(_sized(docs, seed, "doc_id", "source"))
    cuts = thresholds(sized, weights, share, cap).select("key", "copies", "cut")
    rows = _sized(docs.select("doc_id", "text", "source", F.struct(*[F.col(c) for c in docs.columns]).alias("row")), seed, "row")
    taken = rows.join(cuts, "key").withColumn("times", _copies().cast("int")).where("times > 0")
    once = taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("copy"))
    return once.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def mix(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17
) -> DataFrame:
    """Words that the mix takes of each document.

    Returns doc_id, source, size, source_size, target, taken. ``taken`` is a multiple of ``size``, at most
    ``ceil(cap)`` times it. A null text has size 0; a null source is a source of its own; an empty table gives
    no rows. The hash is of doc_id and text, so rows that agree in both are taken or left together; this holds
    too for documents that agree in the first 36 hash bits. Other columns of ``docs`` are not read.
    """
    sized = written(_sized(docs, seed, "doc_id", "source"))
    cuts = thresholds(sized, weights, share, cap)
    taken = (F.col("size") * _copies()).alias("taken")
    return sized.join(cuts, "key").select("doc_id", "source", "size", "source_size", "target", taken)


def thresholds(sized: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Of each source: key, source_size, target, whole copies, and the cut below which hashes give one more copy."""
    first = sized.groupBy("key", _bits(0).alias("bucket")).agg(
        F.first("source").alias("source"), F.sum("size").alias("words")
    )
    histogram = written(first)
    totals = histogram.groupBy("key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    targets = source_targets(totals, weights, share, cap).withColumn(
        "key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = written(
        targets.withColumn("copies", whole.cast("long"))
        .withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
        .withColumn("prefix", F.lit(0).cast("long"))
    )
    for level in range(LEVELS):
        if level:
            inside = sized.withColumn("prefix", F.shiftright("hash", LEVEL_BITS * (LEVELS - level)))
            histogram = (
                inside.join(plan.select("key", "prefix"), ["key", "prefix"])
                .groupBy("key", _bits(level).alias("bucket"))
                .agg(F.sum("size").alias("words"))
            )
        running = Window.partitionBy("key").orderBy("bucket")
        crossing = (
            histogram.select("key", "bucket", "words", F.sum("words").over(running).alias("up_to"))
            .join(plan.select("key", "rest"), "key")
            .where(F.col("up_to") > F.col("rest"))
            .groupBy("key")
            .agg(F.min(F.struct("bucket", "words", "up_to")).alias("at"))
        )
        # A source whose budget no bucket passes (it has no words) keeps prefix 0 and takes nothing.
        plan = written(
            plan.join(crossing, "key", "left").select(
                "key",
                "source_size",
                "target",
                "copies",
                F.coalesce(F.col("rest") - (F.col("at.up_to") - F.col("at.words")), F.lit(0.0)).alias("rest"),
                (F.col("prefix") * 2**LEVEL_BITS + F.coalesce(F.col("at.bucket"), F.lit(0))).alias("prefix"),
                F.coalesce("at.words", F.lit(0)).alias("words"),
            )
        )
    near = F.when(2 * F.col("rest") >= F.col("words"), 1).otherwise(0)
    return plan.select("key", "source_size", "target", "copies", (F.col("prefix") + near).alias("cut"))
