"""Multi-party perspective rotation of chats (DataFrame functions only).

Each dialogue is rendered once for every participant: that speaker's turns are the assistant's and carry the
training mask, all others are turns of named users, system turns stay system turns. The rendering is one row a
turn with its text and its place in the rendered dialogue, so a dialogue of any length is never one value; the
concatenation of ``segment`` by ``start`` is the dialogue's text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turns of a dialogue are numbered in blocks of this many, so that no task holds a dialogue's rows together.
BLOCK = 256


def rotate(turns: DataFrame, system_roles: tuple[str, ...] = ("system",)) -> DataFrame:
    """(conv_id, perspective, turn, role_name, segment, start, end, mask_start, mask_end, trained) of each turn.

    Format of a segment: ``<|system|>``, ``<|assistant|>`` or ``<|user name=SPEAKER|>``, a line feed, the text,
    ``<|end|>`` and a line feed. Offsets are code points in the rendered dialogue, end exclusive. The mask covers
    text and ``<|end|>`` of the assistant's turns and is empty (start = end) elsewhere. Turns go by turn, then
    role, then text; equal rows stay as equal turns. A null role is a speaker named ``unknown``, a null text is
    empty, a null turn sorts first, a null conv_id is a dialogue of its own. A dialogue of system turns only has
    no participant and no rendering. Other columns are not read.
    """
    said = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("unknown")).alias("speaker"),
        F.coalesce("text", F.lit("")).alias("said"),
        F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK).alias("block"),
    )
    is_system = F.col("speaker").isin(*system_roles)
    # A row for each speaker of a dialogue, from map-side sums; a dialogue with very many turns is few rows here.
    cast = said.where(~is_system).select(F.col("conv_id").alias("cast_id"), F.col("speaker").alias("perspective")).distinct()
    rotated = said.join(cast, F.col("conv_id").eqNullSafe(F.col("cast_id"))).drop("cast_id")
    own = F.col("speaker") == F.col("perspective")
    head = (
        F.when(is_system, F.lit("<|system|>\n"))
        .when(own, F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), "speaker", F.lit("|>\n")))
    )
    rendered = rotated.select(
        "*",
        F.when(is_system, "system").when(own, "assistant").otherwise("user").alias("role_name"),
        F.length(head).alias("head_size"),
        F.concat(head, "said", F.lit("<|end|>\n")).alias("segment"),
    ).withColumn("size", F.length("segment").cast("long"))
    dialogue = ["conv_id", "perspective"]
    by_block = rendered.groupBy(*dialogue, "block").agg(F.sum("size").alias("block_size"))
    blocks = by_block.withColumn(
        "base", F.sum("block_size").over(Window.partitionBy(*dialogue).orderBy("block")) - F.col("block_size")
    ).select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"), "base")
    within = Window.partitionBy(*dialogue, "block").orderBy("turn", "speaker", "said").rowsBetween(Window.unboundedPreceding, 0)
    placed = rendered.withColumn("up_to", F.sum("size").over(within)).join(
        blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b"))
    )
    start = F.col("base") + F.col("up_to") - F.col("size")
    masked = F.when(F.col("role_name") == "assistant", F.col("head_size")).otherwise(F.lit(0))
    upto = F.when(F.col("role_name") == "assistant", F.col("size") - 1).otherwise(F.lit(0))
    return placed.select(
        "conv_id",
        "perspective",
        "turn",
        "role_name",
        "segment",
        start.alias("start"),
        (start + F.col("size")).alias("end"),
        (start + masked).alias("mask_start"),
        (start + upto).alias("mask_end"),
        (F.col("role_name") == "assistant").alias("trained"),
    )
