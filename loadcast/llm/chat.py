"""Chat formatting: conversations to one training string each, and back.

The turns of a conversation are collected as structs, sorted by turn, and joined
to runs of one role; every run is written as

    <|start|>ROLE<|text|>TEXT<|next|>TEXT...<|end|>

so merged turns keep their borders.  Control strings inside roles and texts get
a backslash behind their first character (one more, if backslashes stand there
already), so no text can open or close a turn and the escape can be undone.
The loss mask covers the texts of assistant turns, as spans of code points.

Defined results: a null text or role is empty; null turns come first, equal
turns go by role, then text, and repeated rows stay repeated turns; all rows
with a null conv_id form one conversation; an empty table gives an empty table;
columns besides the four are not read.  A conversation is one output row, so
its turns meet in one task by definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks of this template, and control strings of common templates, which texts must not forge.
START, TEXT, NEXT, END = "<|start|>", "<|text|>", "<|next|>", "<|end|>"
_ANGLE = r"<(?=\\*(?:\||/?s>|/?SYS>>))"
_SQUARE = r"\[(?=\\*/?INST\])"
LEARNED = "assistant"

CHUNK = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, _ANGLE, r"<\\"), _SQUARE, r"[\\")


def unescape(text: Column) -> Column:
    angle, square = _ANGLE.replace("<(?=", r"<\\(?=", 1), _SQUARE.replace(r"\[(?=", r"\[\\(?=", 1)
    return F.regexp_replace(F.regexp_replace(text, angle, "<"), square, "[")


def running_sums(numbers: Column) -> Column:
    """Sums of all earlier elements, for each element; chunks keep it from growing with the square."""

    def before(values: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("out"))
        step = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))
        return F.aggregate(values, zero, step, lambda acc: acc["out"])

    count = F.ceil(F.size(numbers) / CHUNK).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    chunks = F.transform(starts, lambda c: F.slice(numbers, c * CHUNK + 1, F.lit(CHUNK)))
    totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x))
    return F.flatten(F.zip_with(chunks, before(totals), lambda c, base: F.transform(before(c), lambda x: x + base)))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (array of struct<low, high>, code points from 0, high excluded)."""
    empty = F.lit("")
    turn = F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def opening(t: Column, i: Column) -> Column:
        """What stands before the text of a turn."""
        head = F.concat(F.lit(START), escape(t["role"]), F.lit(TEXT))
        joins = F.get("turns", i - 1)["role"] == t["role"]
        return F.when(i == 0, head).when(joins, F.lit(NEXT)).otherwise(F.concat(F.lit(END), head))

    part = F.transform(
        "turns",
        lambda t, i: F.struct(opening(t, i).alias("head"), escape(t["text"]).alias("body"), (t["role"] == LEARNED).alias("learned")),
    )
    low = running_sums(F.transform("parts", lambda p: (F.length(p["head"]) + F.length(p["body"])).cast("long")))
    span = lambda p, at: F.when(
        p["learned"],
        F.struct((at + F.length(p["head"])).alias("low"), (at + F.length(p["head"]) + F.length(p["body"])).alias("high")),
    )
    return chats.select("conv_id", part.alias("parts")).select(
        "conv_id",
        F.concat(F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), ""), F.lit(END)).alias("formatted"),
        F.filter(F.zip_with("parts", low, span), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of struct<role, text>, read back from a formatted conversation."""
    blocks = F.slice(F.split(formatted, F.lit(_quoted(END)), -1), 1, F.size(F.split(formatted, F.lit(_quoted(END)), -1)) - 1)

    def turns_of(block: Column) -> Column:
        role = F.substring_index(block, TEXT, 1)
        texts = F.split(F.substr(block, F.length(role) + len(TEXT) + 1), _quoted(NEXT), -1)
        name = unescape(F.substr(role, F.lit(len(START) + 1)))
        return F.transform(texts, lambda t: F.struct(name.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns_of))


def masked_text(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, nothing between them."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["low"] + 1).cast("int"), (s["high"] - s["low"]).cast("int")))), "")


def _quoted(mark: str) -> str:
    return mark.replace("|", r"\|")


def chat_digest(turns: DataFrame) -> DataFrame:
    """Counts and digests, all read back from the formatted conversations."""
    said = F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return (
        format_chats(turns)
        .withColumns({"back": read_turns(F.col("formatted")), "learned": masked_text(F.col("formatted"), F.col("loss_spans"))})
        .select(
            "conv_id",
            F.size("back").cast("long").alias("n_turns"),
            F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
            F.length("learned").cast("long").alias("loss_chars"),
            F.sha2("learned", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )
