"""Multi-party perspective rotation of conversations, with DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as `assistant` and everyone else as a named
`user`; the system is no participant. One row is one message of one rendering, with its place in the rendered text and its loss mask, and
places come from prefix sums in two levels, over blocks of turns and within a block, so that no conversation is collected into one row or
sorted as a whole. Its rows do meet its list of participants by an equi-join on the conversation, whose large partitions Spark can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_TURNS = 64
LAST = (1 << 63) - 1


def rotate_perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", system: str = "system") -> DataFrame:
    """One row per message and participant of its conversation: conv_id, perspective, turn, speaker, chat_role (`assistant` for the
    perspective's own messages, `system` for the system's, else `user`), rendered, text_start and text_end (characters of the rendered dialogue that the message itself
    takes, end exclusive), message_start (where its header begins) and loss (1 where the perspective speaks, else 0).

    The rendered dialogue is the rows' `rendered` in order of message_start. A header is `<|assistant|>`, `<|system|>` or `<|user:NAME|>` and a new
    line; a message ends with a new line. No name or text can forge a header: `<|` and `|>` in them get a backslash inside. A null text is
    empty, and so may be any of any length; a null speaker shares the name `unknown` with those who have it. Rows with a null
    conversation belong to none and are left out; a null turn comes last. Rows of the same turn are ordered by speaker and text, repeated
    rows are rendered as often as they come. A conversation of the system alone, and an empty table, give no rows; other columns are ignored.
    """
    said = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), _escaped(F.coalesce(F.col(speaker_col), F.lit("unknown"))).alias("speaker"), _escaped(F.coalesce(F.col(text_col), F.lit(""))).alias("text")
    )
    said = said.withColumn("at", F.coalesce("turn", F.lit(LAST)))
    speakers = said.filter(F.col("speaker") != system).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker") == F.col("perspective")
    header = F.when(own, F.lit("<|assistant|>\n")).when(F.col("speaker") == system, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user:"), F.col("speaker"), F.lit("|>\n")))
    rows = said.join(speakers, "conv_id").withColumns({"header": header, "block": F.col("at").bitwiseAND(-BLOCK_TURNS)})
    rows = rows.withColumn("rendered", F.concat("header", "text", F.lit("\n"))).withColumn("size", F.length("rendered").cast("long"))
    sums = rows.groupBy("conv_id", "perspective", "block").agg(F.sum("size").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sums.select("conv_id", "perspective", "block", before.alias("base"))
    inner = Window.partitionBy("conv_id", "perspective", "block").orderBy("at", "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(bases, ["conv_id", "perspective", "block"])
    start = F.col("base") + F.col("inner")
    return placed.select("conv_id", "perspective", "turn", "speaker", _role(own, system).alias("chat_role"), "rendered", start.alias("message_start"), (start + F.length("header")).alias("text_start"), (start + F.length("header") + F.length("text")).alias("text_end"), own.cast("int").alias("loss"))


def _role(own: Column, system: str) -> Column:
    return F.when(own, F.lit("assistant")).when(F.col("speaker") == system, F.lit("system")).otherwise(F.lit("user"))


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<|"), F.lit("<\\|")), F.lit("|>"), F.lit("|\\>"))
