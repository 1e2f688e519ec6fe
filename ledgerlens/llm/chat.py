"""Chat formatting: every reply becomes an example of its own, with all turns before it as context."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
# Strings that chat templates treat as control.
CONTROL = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]")

_FIRST = "[" + "".join(sorted({re.escape(c[0]) for c in CONTROL})) + "]"
_REST = "|".join(re.escape(c[1:]) for c in CONTROL)


def escape(text: Column) -> Column:
    """No control string is left in the result; ``unescape`` gives the text back.

    A backslash goes behind the first character of a control string. A control string that already
    has backslashes there gets one more, so the number of them tells what the text held.
    """
    return F.regexp_replace(text, rf"({_FIRST})(\\*+)({_REST})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"({_FIRST})\\(\\*+)({_REST})", "$1$2$3")


def segment(role: Column, text: Column) -> Column:
    """A turn as the template writes it: start mark, role, line feed, escaped text, end mark."""
    return F.concat(F.lit(START), F.url_encode(role), F.lit("\n"), escape(text), F.lit(END))


def prefix_examples(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    reply_role: str = "assistant",
) -> DataFrame:
    """One row per example: ``conv_id``, ``target`` (1-based position of its last turn),
    ``conversation_turns``, ``formatted``, ``loss_start``, ``loss_end``.

    Each turn of ``reply_role`` gives an example that ends with it. ``formatted`` holds all turns up
    to there; only the code points ``loss_start`` (from 0) to ``loss_end`` (exclusive), the escaped
    text of that reply, are trainable. Turns after the last reply, or a conversation without reply,
    give one more example with an empty loss span, so that no turn is lost.

    Turns stand in the order of ``turn_col`` (nulls first), ties by role, then text; repeated rows
    stay. Null roles and texts are empty; rows without conversation id are one conversation. An
    empty table gives an empty result; other columns of the input are not read.

    Turns of a conversation meet once, in an aggregate by conversation; examples are then made row
    by row, so a task holds one conversation and one example at a time. An example is one value
    with its whole context, so the examples of n turns hold about n*n/2 segments, and a conversation
    has to fit a value (2 GB).
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    convs = convs.select(
        "conv_id",
        F.transform("ts", lambda t: t["role"] == reply_role).alias("replies"),
        F.transform("ts", lambda t: segment(t["role"], t["text"])).alias("segments"),
        # what stands before the text in a segment: start mark, role, line feed
        F.transform("ts", lambda t: F.length(F.url_encode(t["role"])) + len(START) + 1).alias("heads"),
        F.size("ts").alias("conversation_turns"),
    )
    places = F.filter(
        F.sequence(F.lit(1), F.col("conversation_turns")),
        lambda i: F.get("replies", i - 1) | (i == F.col("conversation_turns")),
    )
    told = convs.select("*", F.explode(places).alias("target"))
    told = told.select(
        "conv_id",
        "target",
        "conversation_turns",
        F.array_join(F.slice("segments", F.lit(1), F.col("target")), "").alias("formatted"),
        F.get("replies", F.col("target") - 1).alias("reply"),
        (F.length(F.get("segments", F.col("target") - 1)) - F.get("heads", F.col("target") - 1) - len(END)).alias("chars"),
    )
    end = F.length("formatted") - F.when(F.col("reply"), len(END)).otherwise(0)
    return told.select(
        "conv_id",
        "target",
        "conversation_turns",
        "formatted",
        (end - F.when(F.col("reply"), F.col("chars")).otherwise(0)).alias("loss_start"),
        end.alias("loss_end"),
    )


def parse(formatted: Column) -> Column:
    """The (role, text) structs that a formatted example holds."""
    pieces = F.split(formatted, re.escape(END), -1)
    pieces = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.substring(p, len(START) + 1, 2**31 - 1))

    def turn(piece: Column) -> Column:
        mark = F.instr(piece, "\n")
        return F.struct(
            F.url_decode(F.substring(piece, F.lit(1), mark - 1)).alias("role"),
            unescape(F.substring(piece, mark + 1, F.length(piece))).alias("text"),
        )

    return F.transform(pieces, turn)


def read_back(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation hold: ``conv_id``, ``n_turns``, ``turns_sha256`` (role,
    line feed, text, line feed of each turn), ``loss_chars``, ``loss_sha256`` (all text under the loss
    spans, unescaped, in order), ``formatted_chars``.

    The example that ends with the last turn tells the turns, all of them tell the loss.
    """
    masked = unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    whole = F.col("target") == F.col("conversation_turns")
    turns = F.when(whole, parse(F.col("formatted")))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    small = examples.select("conv_id", "target", F.length("formatted").alias("chars"), masked.alias("masked"), turns.alias("turns"))
    small = small.select(
        "conv_id", "chars", F.struct("target", "masked").alias("m"),
        F.size("turns").alias("n"), F.sha2(F.array_join(line, ""), 256).alias("sha"),
    )
    told = small.groupBy("conv_id").agg(
        F.max(F.when(F.col("sha").isNotNull(), F.col("n"))).cast("long").alias("n_turns"),
        F.max("sha").alias("turns_sha256"),
        F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["masked"]), "").alias("loss"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    return told.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
