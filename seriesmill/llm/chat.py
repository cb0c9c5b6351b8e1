"""Chat formatting of maximal conversations.

A log that is written again after each turn holds every conversation many times, each a prefix
of the next. Every turn gets the rolling hash of its conversation up to there: the exclusive or of
the hashes of (turn number, role, text) of all turns so far, in two 64-bit lanes. A conversation
whose whole hash is the hash of a proper prefix of another is a snapshot; an anti-join drops it. Of
equal conversations the one with the smallest id stays. What is left is rendered, turn by turn,
between role marks.

Scale: a conversation is hashed and rendered in blocks of `BLOCK` turn numbers, then by blocks, so
one with a third of all turns is spread over tasks until its rendered blocks meet in its one
result row. Prefix hashes and whole hashes are distinct before the anti-join, so a first turn that
most conversations share is one row. Texts are shuffled twice: to drop repeated rows, and to render.

Defined results: repeated rows count once; several different rows of a turn stand in order of role
and text; a null turn comes first; null role or text is empty in the rendering (and differs from
empty in the comparison); rows with null conv_id are one conversation; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesmill.llm.common import named, written

BLOCK = 64
START, END = "<|im_start|>", "<|im_end|>"
LANES = ("h1", "h2")


def turn_hash(seed: int) -> Column:
    parts = [F.lit(seed), F.col("turn")]
    for name in ("role", "text"):
        parts += [F.col(name).isNull(), F.col(name)]
    return F.xxhash64(*parts)


def rolling_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, turn, whether it is the last, and the hash of the conversation up to the turn."""
    xor = lambda column: F.bit_xor(column)
    by_turn = turns.groupBy("conv_id", "block", "turn").agg(
        xor(turn_hash(1)).alias("h1"), xor(turn_hash(2)).alias("h2"), F.count(F.lit(1)).alias("rows")
    )
    by_turn = written(by_turn, "chat-turns")
    blocks = by_turn.groupBy("conv_id", "block").agg(
        *[xor(x).alias(x) for x in LANES], F.max("turn").alias("last"), F.sum("rows").alias("rows")
    )
    conversation = Window.partitionBy("conv_id").orderBy("block")
    earlier = conversation.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "conv_id", "block",
        *[F.coalesce(xor(x).over(earlier), F.lit(0)).alias(f"{x}_before") for x in LANES],
        F.max("last").over(Window.partitionBy("conv_id")).alias("last"),
        F.sum("rows").over(Window.partitionBy("conv_id")).alias("n_turns"),
    )
    blocks = written(blocks, "chat-blocks").alias("b")
    same = F.col("t.conv_id").eqNullSafe(F.col("b.conv_id")) & F.col("t.block").eqNullSafe(F.col("b.block"))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    within = by_turn.withColumns({x: xor(x).over(so_far) for x in LANES})
    joined = within.alias("t").join(blocks, same)
    return joined.select(
        "t.conv_id", "t.turn", "b.n_turns",
        F.col("t.turn").eqNullSafe(F.col("b.last")).alias("is_last"),
        *[F.col(f"t.{x}").bitwiseXOR(F.col(f"b.{x}_before")).alias(x) for x in LANES],
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and copies of the conversations that no longer one starts with."""
    hashes = written(rolling_hashes(turns), "chat-hashes")
    first = F.min(F.struct(F.col("conv_id").isNull().alias("null"), F.col("conv_id"), F.col("n_turns"))).alias("first")
    whole = hashes.where("is_last").groupBy(*LANES).agg(first, F.count(F.lit(1)).alias("copies"))
    prefixes = hashes.where("not is_last").select(*LANES).distinct()
    return whole.join(prefixes, list(LANES), "left_anti").select("first.conv_id", "first.n_turns", "copies")


def rendered(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """The kept conversations' texts."""
    kept = kept.alias("k")
    rows = turns.alias("t").join(kept, F.col("t.conv_id").eqNullSafe(F.col("k.conv_id")), "left_semi")
    in_order = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    line = lambda x: F.concat(F.lit(START), F.coalesce(x["role"], F.lit("")), F.lit("\n"), F.coalesce(x["text"], F.lit("")), F.lit(END + "\n"))
    blocks = rows.groupBy("conv_id", "block").agg(F.array_join(F.transform(in_order, line), "").alias("part"))
    parts = F.array_sort(F.collect_list(F.struct("block", "part")))
    return blocks.groupBy("conv_id").agg(F.array_join(parts["part"], "").alias("chat"))


def chats(table: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """conv_id, n_turns, copies, n_chars and chat of every maximal conversation."""
    names = {"conv_id": conv_col, "turn": turn_col, "role": role_col, "text": text_col}
    turns = table.select(*[named(v).alias(k) for k, v in names.items()]).distinct()
    turns = turns.withColumn("turn", F.col("turn").cast("long"))
    # below all turn numbers
    lowest = F.lit(-(1 << 62)).cast("long")
    turns = turns.withColumn("turn", F.coalesce("turn", lowest)).withColumn("block", F.floor(F.col("turn") / BLOCK))
    turns = written(turns, "chat-rows")
    kept = written(maximal_conversations(turns), "chat-kept").alias("k")
    texts = rendered(turns, kept).alias("r")
    joined = kept.join(texts, F.col("k.conv_id").eqNullSafe(F.col("r.conv_id")))
    return joined.select("k.conv_id", "n_turns", "copies", F.length("chat").cast("long").alias("n_chars"), "chat")
