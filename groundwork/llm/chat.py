r"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log holds events of conversations: ``message`` starts a turn's text, ``delta`` appends
to it, ``edit`` replaces it, ``regenerate`` replaces it and voids what later turns had
before. Folding a log in sequence order gives the final turns; rendering marks them:

    <turn>ROLE<text>TEXT</turn>\n            plain turns
    <turn>ROLE<loss>TEXT</turn>\n            turns under the loss mask

In ROLE and TEXT a backslash is written \0 and a less-than sign \1, so no text holds
a mark; undoing \1 before \0 is exact, as each written backslash is followed by its digit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, PLAIN, LOSS, CLOSE = "<turn>", "<text>", "<loss>", "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\0")), F.lit("<"), F.lit("\\1"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\1"), F.lit("<")), F.lit("\\0"), F.lit("\\"))


def fold(events: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: the final turns of (conv_id, seq, turn, kind, role, text) events.

    Deltas after a turn's last message, edit or regenerate append to it in sequence
    order; deltas before it are void. Events of a turn that precede a regenerate of an
    earlier turn are void, and a turn without other events is gone. Null texts count as empty; the role is that of the turn's last
    event that has one. Equal sequence numbers are taken by kind, role and text.
    A null conv_id is a conversation of its own.
    """
    starts = F.col("kind") != "delta"
    again = F.max(F.when(F.col("kind") == "regenerate", F.col("seq")))
    # what a regenerate of an earlier turn voids goes first: null turns are the earliest
    place = F.coalesce(F.col("turn").cast("long"), F.lit(-(2**62)))
    earlier = Window.partitionBy("conv_id").orderBy("__place").rangeBetween(Window.unboundedPreceding, -1)
    events = events.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("__place", place).withColumn("__void", again.over(earlier))
    events = events.filter(F.col("__void").isNull() | (F.col("seq") > F.col("__void")))
    body = F.struct("seq", "kind", "role", "text")
    events = events.withColumn("__from", F.max(F.when(starts, body)).over(Window.partitionBy("conv_id", "turn")))
    live = F.col("__from").isNull() | (body >= F.col("__from"))
    turns = events.groupBy("conv_id", "turn").agg(
        F.array_sort(F.collect_list(F.when(live, body))).alias("parts"),
        F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "kind", "role"))).getField("role").alias("role"),
    )
    # parts of the same sequence number as the start are kept only if they are deltas or the start itself
    return turns.select("conv_id", "turn", "role", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def render(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted: the turns of each conversation in order, as one text.

    The output of a conversation is one row, so one conversation has to fit in a task.
    """
    mark = F.when(F.col("role") == loss_role, F.lit(LOSS)).otherwise(F.lit(PLAIN))
    piece = F.concat(F.lit(OPEN), escape(F.coalesce("role", F.lit(""))), mark, escape(F.coalesce("text", F.lit(""))), F.lit(CLOSE))
    grouped = turns.select("conv_id", F.struct(F.col("turn"), piece.alias("piece")).alias("p")).groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return grouped.select("conv_id", F.array_join(F.transform("ps", lambda p: p["piece"]), "").alias("formatted"))


def parse(formatted: Column) -> Column:
    """array<struct<role, loss, text>> read back from a formatted conversation."""
    pieces = F.filter(F.split(formatted, "</turn>\n"), lambda p: p != "")

    def one(p: Column) -> Column:
        body = F.substring(p, len(OPEN) + 1, F.length(p))
        loss = F.instr(body, LOSS) > 0
        at = F.instr(body, "<")
        role, text = F.substring(body, 1, at - 1), F.substring(body, at + len(PLAIN), F.length(body))
        return F.struct(unescape(role).alias("role"), loss.alias("loss"), unescape(text).alias("text"))

    return F.transform(pieces, one)


def message_events(conversations: DataFrame) -> DataFrame:
    """Every row as a message of its own: turns are numbered by (turn, role, text), so repeated turns all stay."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = conversations.select("conv_id", F.row_number().over(order).cast("long").alias("turn"), "role", "text")
    return rows.select("conv_id", F.col("turn").alias("seq"), "turn", F.lit("message").alias("kind"), "role", "text")


def format_chat(events: DataFrame) -> DataFrame:
    """conv_id, formatted of a log of events; an empty log gives an empty result."""
    return render(fold(events))


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader finds in the formatted texts: turns, text under the loss mask, lengths."""
    read = formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
