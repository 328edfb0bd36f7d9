"""Chat formatting from an event log: conversations are folded from their events, then rendered with a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.llm._native import let

#: The template's control strings. Every one of them begins with "<", which escaping removes from texts and roles.
START, BODY, END = "<|turn|>", "<|says|>", "<|end|>"


def escape(text: Column) -> Column:
    """Takes "<" and "[" out of a text, so that neither this template's nor other common templates' control strings survive in it."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&lsqb;"))


def unescape(text: Column) -> Column:
    """Undoes escape()."""
    out = F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&lsqb;"), F.lit("["))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def fold_events(events: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """One row per message (conversation, turn, role, text) from events (conversation, seq, kind, turn, role, text).

    Kinds: `message` and `regenerate` begin the turn's text anew, `edit` replaces it, `delta` appends to it, `delete`
    removes the turn until a later event brings it back. Other kinds are ignored. Events are applied by seq; equal seq by
    kind and text. The role is that of the last event that names one. Null texts count as empty, deltas without a message
    before them start from nothing. Messages are folded one by one, so a long conversation meets in no task here.
    """
    known = events.where(F.col("kind").isin("message", "regenerate", "edit", "delta", "delete"))
    step = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), "role")
    log = known.groupBy(conversation, "turn").agg(F.array_sort(F.collect_list(step)).alias("__log"))

    def fold(log: Column) -> Column:
        ends = F.transform(log, lambda e, i: F.when(e["kind"] != "delta", i).otherwise(F.lit(-1)))
        return let(F.array_max(ends), lambda last: F.struct(
            F.array_join(F.transform(F.slice(log, F.greatest(last, F.lit(0)) + 1, F.size(log)), lambda e: F.when(e["kind"] == "delete", F.lit("")).otherwise(e["text"])), "").alias("text"),
            F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(F.transform(log, lambda e: e["role"]), lambda r: r.isNotNull())), -1).alias("role"),
            ((last >= 0) & (F.get(log, last)["kind"] == "delete") & (F.size(log) == last + 1)).alias("gone"),
        ))

    folded = log.withColumn("__out", fold(F.col("__log")))
    return folded.where(~F.coalesce(F.col("__out.gone"), F.lit(False))).select(conversation, "turn", F.col("__out.role").alias("role"), F.col("__out.text").alias("text"))


def message_events(rows: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Events for a table that holds one finished message per row; rows that share a turn become messages of their own, by role and text.

    `turn` becomes a struct of the turn and that ordinal.
    """
    same = Window.partitionBy(conversation, "turn").orderBy("role", "text")
    return rows.withColumn("__nth", F.row_number().over(same)).select(conversation, F.lit(0).alias("seq"), F.lit("message").alias("kind"), F.struct("turn", "__nth").alias("turn"), "role", "text")


def render(messages: DataFrame, conversation: str = "conv_id", learn: str = "assistant") -> DataFrame:
    """One row per conversation: `segments` (array<struct<text, loss>>) and `formatted`, their texts joined.

    A turn is START role BODY text END; role and text are escaped, null ones empty. The mask `loss` is true on exactly
    the texts of turns whose role is `learn`. Turns go by turn; equal turns by role and text, repeated rows each count.
    Sorting happens in the shuffle by conversation; a conversation's text has to meet in one row, as that is the result.
    """
    role = escape(F.col("role"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    parts = F.array(segment(F.concat(F.lit(START), role, F.lit(BODY)), F.lit(False)), segment(escape(F.col("text")), F.coalesce(F.col("role") == learn, F.lit(False))), segment(F.lit(END), F.lit(False)))
    turns = messages.select(conversation, F.struct("turn", "role", "text", parts.alias("parts")).alias("__turn"))
    grouped = turns.groupBy(conversation).agg(F.array_sort(F.collect_list(F.struct(F.col("__turn.turn"), F.col("__turn.role"), F.col("__turn.parts")))).alias("__turns"))
    out = grouped.withColumn("segments", F.flatten(F.transform("__turns", lambda t: t["parts"]))).drop("__turns")
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parse(formatted: Column) -> Column:
    """The turns (array<struct<role, text>>) of a formatted conversation, unescaped."""
    pieces = F.filter(F.split(formatted, "<\\|end\\|>"), lambda p: p != "")

    def turn(piece: Column) -> Column:
        return let(F.split(F.substring(piece, len(START) + 1, 1 << 30), "<\\|says\\|>"), lambda x: F.struct(unescape(F.get(x, F.lit(0))).alias("role"), unescape(F.get(x, F.lit(1))).alias("text")))

    return F.transform(pieces, turn)


def under_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    return unescape(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""))


def format_conversations(events: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Event log to formatted conversations: fold_events(), then render()."""
    return render(fold_events(events, conversation), conversation)


