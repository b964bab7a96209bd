"""Connected components of a link table, by contraction to random neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Scratch


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b) with another end, label the smallest node reachable.

    Each round draws a random order of the nodes, moves every node to the first one among itself and its
    neighbours, and keeps the links between different ones. In expectation a round leaves at most three of four
    linked nodes, whatever their ids, so rounds grow with the logarithm of the nodes, and so do the tables, which
    shrink likewise. Every round is written and read back, so plans stay short and sizes are those of files. A node
    of very many links is combined on the map side. An empty link table, or one of loops only, gives no rows.
    """
    scratch = Scratch(links.sparkSession)
    edges = scratch.keep(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges0")
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        number = len(moves)
        draw = lambda c: F.struct(F.xxhash64(F.lit(number), c).alias("drawn"), F.col(c).alias("node"))
        nearest = edges.groupBy("a").agg(F.min(draw("b")).alias("near"))
        first = F.least(draw("a"), F.col("near"))["node"]
        moves.append(scratch.keep(nearest.select(F.col("a").alias("node"), first.alias("to")), f"moves{number}"))
        to = lambda end: moves[-1].select(F.col("node").alias(end), F.col("to").alias(f"to_{end}"))
        moved = edges.join(to("a"), "a").join(to("b"), "b").where("to_a <> to_b")
        edges = scratch.keep(moved.select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct(), f"edges{number + 1}")
        scratch.drop(f"edges{number}")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    # A node that lost its last link stays where it is from then on.
    end = moves[-1]
    for number in range(len(moves) - 2, -1, -1):
        later = end.select(F.col("node").alias("to"), F.col("to").alias("last"))
        joined = moves[number].join(later, "to", "left").select("node", F.coalesce("last", "to").alias("to"))
        end = scratch.keep(joined, f"ends{number}")
    least = end.groupBy("to").agg(F.min("node").alias("label"))
    labels = Scratch(links.sparkSession).keep(end.join(least, "to").select("node", "label"), "labels")
    scratch.drop()
    return labels
