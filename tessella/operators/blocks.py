"""Joins of packed blocks: every block of queries with every block of a corpus, in one scan of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Query blocks of so many bytes in all are broadcast; more are dealt to shares of the corpus.
BROADCAST_BYTES = 8_000_000


def meet(corpus: DataFrame, queries: DataFrame, size: str) -> DataFrame:
    """All pairs of a corpus block and a query block; ``queries`` is a written table, ``size`` an expression of its bytes a row.

    Few queries, as their summed size shows, go out to the corpus, which then stays where it is. Otherwise the corpus
    is dealt into shares, one a shuffle partition, each query block is sent to each share, and the two sides are
    joined on the share. Either way the corpus is read once.
    """
    total = queries.agg(F.sum(F.expr(size))).first()[0] or 0
    if total <= BROADCAST_BYTES:
        return corpus.crossJoin(F.broadcast(queries))
    spark = corpus.sparkSession
    shares = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = corpus.withColumn("share", F.pmod(F.xxhash64(F.element_at("ids", 1)), F.lit(shares)))
    everywhere = queries.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)).cast("array<bigint>")))
    return dealt.join(everywhere.hint("merge"), "share").drop("share")
