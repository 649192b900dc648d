"""Chat formatting, with Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, HEAD_END, NEXT, CLOSE = "<s>[INST]", "[/INST]", "<sep>", "</s>"
#: What no text may hold: each begins with < or [, and a backslash after that character breaks it.
CONTROL = r"([<\[])(?=/?(?:s>|INST\]|sep>))"


def escape(text: Column) -> Column:
    """Backslashes doubled, then one put into each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted, mask`` for each conversation.

    Turns are sorted by (turn, role, text), so ties and repeated rows have a
    fixed order. Adjacent turns of one role make one block::

        <s>[INST]role[/INST]text<sep>text</s>

    ``mask`` has a span (start, bytes, loss) for each text, over the UTF-8 bytes
    of ``formatted``, in order; loss spans are the escaped texts of the
    assistant, and nothing else carries loss.

    Roles that change number the blocks, and lengths add up to the spans'
    starts, before turns are collected; all steps share one shuffle by
    conv_id. Null texts and roles are empty, a null turn sorts first, rows of a
    null conv_id are one conversation. A conversation is one row, as is its
    text; other columns are ignored.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    before = F.lag("role").over(order)
    opened = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(HEAD_END))
    changed = F.coalesce(before != F.col("role"), F.lit(True))
    placed = rows.select(
        "conv_id",
        F.row_number().over(order).alias("place"),
        F.col("role"),
        F.when(changed, opened).alias("opened"),
        F.when(before.isNull(), opened).when(changed, F.concat(F.lit(CLOSE), opened)).otherwise(F.lit(NEXT)).alias("lead"),
        escape(F.col("text")).alias("body"),
        changed.cast("int").alias("changed"),
    )
    size = F.octet_length("body").cast("long")
    numbered = placed.select(
        "conv_id", "place", "role", "opened", "body",
        F.sum("changed").over(Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)).alias("block"),
        (F.sum(F.octet_length("lead") + size).over(Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)) - size).alias("start"),
        size.alias("bytes"),
    )
    turn = F.struct("place", "body", "start", "bytes", (F.col("role") == "assistant").alias("loss"))
    blocks = numbered.groupBy("conv_id", "block").agg(F.max("opened").alias("opened"), F.sort_array(F.collect_list(turn)).alias("turns"))
    merged = blocks.select(
        "conv_id",
        F.struct("block", F.concat("opened", F.array_join(F.col("turns.body"), NEXT), F.lit(CLOSE)).alias("text"), "turns").alias("block"),
    )
    chats = merged.groupBy("conv_id").agg(F.sort_array(F.collect_list("block")).alias("blocks"))
    spans = F.transform(F.flatten("blocks.turns"), lambda t: F.struct(t["start"].alias("start"), t["bytes"].alias("bytes"), t["loss"].alias("loss")))
    return chats.select("conv_id", F.array_join("blocks.text", "").alias("formatted"), spans.alias("mask"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns, loss, formatted``: turns (role, text) read back from ``formatted``, and the text under the loss mask.

    ``loss`` joins the loss spans of ``mask``, cut from the bytes of
    ``formatted`` and unescaped.
    """
    blocks = F.split("formatted", CLOSE, -1)
    bodies = F.slice(blocks, 1, F.size(blocks) - 1)

    def block_turns(block: Column) -> Column:
        parts = F.split(block, r"\[/INST\]", 2)
        role = unescape(F.substring(parts[0], len(OPEN) + 1, 1 << 30))
        return F.transform(F.split(parts[1], NEXT, -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    raw = F.col("formatted").cast("binary")
    cut = lambda m: unescape(F.substr(raw, (m["start"] + 1).cast("int"), m["bytes"].cast("int")).cast("string"))
    loss = F.array_join(F.transform(F.filter("mask", lambda m: m["loss"]), cut), "")
    return formatted.select("conv_id", F.flatten(F.transform(bodies, block_turns)).alias("turns"), loss.alias("loss"), "formatted")
