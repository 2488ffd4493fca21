"""Chat formatting: collapse logged snapshots of one conversation, then render the maximal ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadq.llm.frames import text_of

#: Turns of a conversation are worked on in segments of so many turn numbers, so that a very long
#: conversation spreads over many tasks. Also the parts in which it is rendered.
SEGMENT = 4096


def _turns(conversations: DataFrame, segment: int) -> DataFrame:
    return conversations.select(
        "conv_id",
        "turn",
        text_of("role").alias("role"),
        text_of("text").alias("text"),
        F.coalesce(F.floor(F.col("turn") / segment), F.lit(-1)).cast("long").alias("part"),
    )


def prefix_hashes(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One narrow row per turn: conv_id, position (from 1), n_turns, and the hash of all turns up to it.

    The hash of a prefix is the XOR of hashes of (position, role, text), two of 64 bits, so it rolls
    from one turn to the next and from one segment to the next. Turns are ordered by turn number
    (null first), then by content.
    """
    said = _turns(conversations, segment).select(
        "conv_id", "turn", "part", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(7), "text", "role").alias("b")
    )
    inside = Window.partitionBy("conv_id", "part").orderBy("turn", "a", "b")
    parts = said.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        F.col("conv_id").alias("id"),
        F.col("part").alias("of"),
        F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"),
        F.sum("n").over(Window.partitionBy("conv_id")).alias("n_turns"),
    )
    same = (F.col("conv_id").eqNullSafe(F.col("id"))) & (F.col("part") == F.col("of"))
    placed = (
        said.withColumn("row", F.row_number().over(inside))
        .join(parts, same)
        .withColumn("position", F.col("offset") + F.col("row"))
        .select("conv_id", "part", "position", "n_turns", F.xxhash64("position", "a").alias("a"), F.xxhash64("position", "b").alias("b"))
    )
    whole = placed.groupBy("conv_id", "part").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    whole = whole.select(
        F.col("conv_id").alias("id"),
        F.col("part").alias("of"),
        F.coalesce(F.bit_xor("a").over(ahead), F.lit(0)).alias("a0"),
        F.coalesce(F.bit_xor("b").over(ahead), F.lit(0)).alias("b0"),
    )
    rolling = Window.partitionBy("conv_id", "part").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        placed.withColumns({"a": F.bit_xor("a").over(rolling), "b": F.bit_xor("b").over(rolling)})
        .join(whole, same)
        .select("conv_id", "position", "n_turns", F.col("a").bitwiseXOR(F.col("a0")).alias("a"), F.col("b").bitwiseXOR(F.col("b0")).alias("b"))
    )


def maximal(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, n_turns, copies of the conversations that are no proper prefix of another one.

    Of conversations with equal turns the smallest conv_id stays; `copies` counts them. All
    hashes are grouped with a map-side combine before they meet, so a first turn that very many
    conversations share is one row in the anti-join.
    """
    hashes = prefix_hashes(conversations, segment)
    ends = hashes.filter("position = n_turns").groupBy("n_turns", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    begun = hashes.filter("position < n_turns").select(F.col("position").alias("n_turns"), "a", "b").distinct()
    return ends.join(begun, ["n_turns", "a", "b"], "left_anti").select("conv_id", "n_turns", "copies")


def render(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, part, n_turns, copies, text of every maximal conversation, rendered turn by turn.

    A part holds the turns of one segment: part 0 is all of a conversation of up to `segment` turns, and no
    task ever holds a longer one whole. Turns without a number are in part -1. A null role or text counts as empty; rows
    that repeat a turn number are turns of their own, in the order of their content. Rows without a conv_id form one
    conversation. Other columns are ignored. An empty table gives an empty result.
    """
    turns = _turns(conversations, segment)
    stay = maximal(conversations, segment).select(F.col("conv_id").alias("id"), "n_turns", "copies")
    parts = turns.select("conv_id", "part").distinct().join(stay, F.col("conv_id").eqNullSafe(F.col("id")))
    parts = parts.select("id", F.col("part").alias("of"), "n_turns", "copies")
    said = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    order = F.struct("turn", F.xxhash64("role", "text"), F.xxhash64(F.lit(7), "text", "role"), said.alias("said"))
    return (
        turns.join(parts, (F.col("conv_id").eqNullSafe(F.col("id"))) & (F.col("part") == F.col("of")))
        .groupBy("conv_id", "part", "n_turns", "copies")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda t: t["said"]), "").alias("text"))
    )
