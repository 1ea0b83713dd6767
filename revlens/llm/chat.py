"""Chat formatting (operator 7), in Spark expressions only.

A conversation's turns are collected as structs and sorted, adjacent turns of
one role become one block, and the blocks are concatenated:

    <|im_start|>ROLE<|im_sep|>TEXT<|turn|>TEXT...<|im_end|>\\n

Control strings inside roles and texts are escaped with a backslash and come
back by one left-to-right pass, whatever the text holds.

Defined cases: a null role or text is empty; rows are ordered by (turn, role,
text), a null turn first, so ties and repeated rows have one order; all rows
with a null ``conv_id`` are one conversation; an empty table gives an empty
result; other columns are ignored.  A conversation becomes one string, so it
is bounded by Spark's string size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, TURN, END = "<|im_start|>", "<|im_sep|>", "<|turn|>", "<|im_end|>\n"
# Openers of control strings of this and other public templates (fixed values).
_OPENER = r"([<\[])(?=\||/?s>|/?INST\])"


def escape(c: Column) -> Column:
    """Double every backslash, then put one behind the first character of each
    control string; afterwards no control string is left."""
    return F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), _OPENER, r"$1\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans``: the formatted string and the spans
    (``start``, ``length``; code points of ``formatted``) of assistant texts
    that a loss counts."""
    by_conv = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    t = conversations.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = t.select(
        "conv_id", "turn", "role", "text", escape(F.col("text")).alias("body"),
        F.lag("role").over(by_conv).alias("before"), F.lead("role").over(by_conv).alias("after"))
    opens = ~F.col("role").eqNullSafe(F.col("before"))
    closes = ~F.col("role").eqNullSafe(F.col("after"))
    head = F.when(opens, F.lit(len(START + SEP)) + F.length(escape(F.col("role")))).otherwise(F.lit(len(TURN)))
    body = F.length("body")
    tail = F.when(closes, F.lit(len(END))).otherwise(F.lit(0))
    so_far = F.sum((head + body + tail).cast("long")).over(by_conv.rowsBetween(Window.unboundedPreceding, 0))
    t = t.select("conv_id", "turn", "role", "text", "body", (so_far - tail - body).alias("at"), body.cast("long").alias("length"))
    grouped = t.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", "at", "body", "length"))).alias("turns"))

    # Blocks: where a role begins, and the turns up to the next such place.
    begins = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (
        F.get(F.col("turns"), i - 1)["role"] != F.get(F.col("turns"), i - 2)["role"]))
    ends = F.concat(F.slice("begins", F.lit(2), F.size("begins")), F.array(F.size("turns") + 1))
    blocks = F.transform(F.arrays_zip(F.col("begins"), F.col("ends")), lambda z: F.slice(
        F.col("turns"), z["begins"], z["ends"] - z["begins"]))
    merged = F.transform(F.col("blocks"), lambda b: F.concat(
        F.lit(START), escape(F.get(b, F.lit(0))["role"]), F.lit(SEP),
        F.array_join(F.transform(b, lambda x: x["body"]), TURN), F.lit(END)))
    spoken = F.filter(F.col("turns"), lambda x: x["role"] == "assistant")
    return (grouped.withColumn("begins", begins).withColumn("ends", ends).withColumn("blocks", blocks)
            .select("conv_id", F.array_join(merged, "").alias("formatted"),
                    F.transform(spoken, lambda x: F.struct(x["at"].alias("start"), x["length"].alias("length")))
                    .alias("loss_spans")))


def read_turns(formatted: Column) -> Column:
    """The turns (``role``, ``text``) that a formatted string holds, one per
    original row."""
    blocks = F.split(formatted, r"<\|im_end\|>\n", -1)
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def turns(b: Column) -> Column:
        head = F.substring_index(b, SEP, 1)
        role = unescape(F.substr(head, F.lit(len(START) + 1)))
        texts = F.split(F.substr(b, F.length(head) + F.lit(len(SEP) + 1)), r"<\|turn\|>", -1)
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
