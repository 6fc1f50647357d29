"""Prefix-target expansion of conversations, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it as context, that reply alone
trainable. Turns after the last reply form one more example without a target, so nothing is lost.

Template: ``<|turn|>role<|text|>text<|end|>`` for each turn. Controls start with ``<|``; inside texts and
roles ``<``, any backslashes, ``|`` gains one backslash after ``<``, so no text can hold a control, and
taking one backslash away restores it. Other formats' control strings stay ordinary text.

A conversation is one row of ordered turns, as a chat model needs it whole; the group is pre-sorted by
(turn, role, text), so ties and repeated rows have a defined order.

Defined cases: null text and null role count as empty; a null conv_id is a conversation of its own; a null
turn sorts first; roles other than ``assistant`` are context; texts of any length are formatted whole; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, target_turn, formatted, mask_start, mask_end): one row per example.

    ``formatted[mask_start:mask_end]`` (code points) is the only trainable text; target_turn is the
    0-based place of the reply, null for the example without a target.
    """
    clean = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    parts = turns.withColumn("head", F.transform("t", lambda x: F.concat(F.lit(TURN), escape(x.role), F.lit(TEXT)))).withColumn("body", F.transform("t", lambda x: escape(x.text)))
    parts = parts.withColumn("replies", F.filter(F.transform("t", lambda x, i: F.when(x.role == "assistant", i)), lambda i: i.isNotNull()))
    last = F.coalesce(F.array_max("replies"), F.lit(-1))
    targets = F.transform("replies", lambda i: F.struct(i.alias("at"), F.lit(True).alias("trains")))
    rest = F.when(last < F.size("t") - 1, F.array(F.struct((F.size("t") - 1).alias("at"), F.lit(False).alias("trains")))).otherwise(F.array().cast("array<struct<at:int,trains:boolean>>"))
    each = parts.select("conv_id", "head", "body", F.posexplode(F.concat(targets, rest)).alias("example", "x"))
    before = F.transform(F.slice(F.arrays_zip("head", "body"), F.lit(1), F.col("x.at")), lambda p: F.concat(p.head, p.body, F.lit(END)))
    head, body = F.get("head", F.col("x.at")), F.get("body", F.col("x.at"))
    lead = each.select("conv_id", "example", "x", F.concat(F.array_join(before, ""), head).alias("lead"), body.alias("body"))
    start = F.char_length("lead")
    return lead.select(
        "conv_id",
        "example",
        F.when(F.col("x.trains"), F.col("x.at")).alias("target_turn"),
        F.concat("lead", "body", F.lit(END)).alias("formatted"),
        F.when(F.col("x.trains"), start).alias("mask_start"),
        F.when(F.col("x.trains"), start + F.char_length("body")).alias("mask_end"),
    )


def turns_of(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted example."""
    cut = F.slice(F.split(formatted, r"<\|turn\|>"), F.lit(2), F.size(F.split(formatted, r"<\|turn\|>")))
    return F.transform(cut, lambda p: F.struct(unescape(F.substring_index(p, TEXT, 1)).alias("role"), unescape(F.substring_index(F.substring_index(p, TEXT, -1), END, 1)).alias("text")))


def read_back(rows: DataFrame) -> DataFrame:
    """Per conversation, from its examples alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    masked = F.when(F.col("mask_start").isNotNull(), unescape(F.substring("formatted", F.col("mask_start") + 1, F.col("mask_end") - F.col("mask_start"))))
    slim = rows.select("conv_id", "example", "formatted", masked.alias("loss"))
    whole = slim.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: F.coalesce(x.loss, F.lit(""))), "").alias("loss"),
        F.sum(F.char_length("formatted").cast("long")).alias("formatted_chars"),
    )
    read = whole.select("conv_id", turns_of(F.col("longest")).alias("t"), "loss", "formatted_chars")
    spoken = F.array_join(F.transform("t", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
