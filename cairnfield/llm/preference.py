"""Preference pairs for chat models, with DataFrame functions only.

The longest common turn prefix of a chosen and a rejected conversation is rendered once as the prompt; the rest of each
becomes its completion, with the spans that are trained on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD = ("<|im_start|>", "\n")  # around the role
TAIL = "<|im_end|>\n"  # after the text
TRAINED_ROLE = "assistant"


def conversations(turns: DataFrame, pair: str, turn: str, role: str, text: str) -> DataFrame:
    """(pair, turns): one row per conversation with its turns in order; null roles and texts are empty.

    Turns with the same number come by role, then text. The row is a conversation, so it is as long as that is.
    """
    entry = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    rows = turns.select(F.col(pair).alias("pair"), entry.alias("entry"))
    ordered = F.array_sort(F.collect_list("entry"))
    return rows.groupBy("pair").agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """Number of equal turns (role and text) at the front of both arrays."""
    shorter = F.least(F.size(a), F.size(b))
    differs = F.filter(F.sequence(F.lit(0), shorter), lambda i: (i == shorter) | (F.get(a, i) != F.get(b, i)))
    return F.element_at(differs, 1)


def render(turns: Column) -> Column:
    shown = lambda t: F.concat(F.lit(HEAD[0]), t["role"], F.lit(HEAD[1]), t["text"], F.lit(TAIL))
    return F.array_join(F.transform(turns, shown), "")


def trained_spans(turns: Column, role: str = TRAINED_ROLE) -> Column:
    """Spans (start, end) in characters of the rendered turns: text and end mark of each turn of ``role``."""
    head = lambda t: F.length(t["role"]) + len(HEAD[0]) + len(HEAD[1])
    size = lambda t: F.length(t["text"]) + len(TAIL)
    spans_type = "array<struct<start:int,end:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(spans_type).alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        begin = acc["at"] + head(t)
        span = F.array(F.struct(begin.alias("start"), (begin + size(t)).alias("end")))
        spans = F.when(t["role"] == role, F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((begin + size(t)).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, add, lambda acc: acc["spans"])


def format_preferences(
    chosen: DataFrame,
    rejected: DataFrame,
    pair: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    trained: str = TRAINED_ROLE,
) -> DataFrame:
    """One row per pair of conversations, both given as rows of turns.

    Columns: ``pair``, n_common (turns of the prompt), prompt, chosen, rejected (completions), chosen_mask and
    rejected_mask (spans of the completions that are trained on). A conversation without a partner has an empty one,
    and so an empty prompt. Equal conversations give empty completions. Null pairs are one pair. Other columns aren't
    read; repeated turns are turns.
    """
    left = conversations(chosen, pair, turn, role, text).select(F.col("pair").alias("p"), F.col("turns").alias("a"))
    right = conversations(rejected, pair, turn, role, text).select(F.col("pair").alias("q"), F.col("turns").alias("b"))
    none = F.array().cast("array<struct<role:string,text:string>>")
    both = left.join(right, F.col("p").eqNullSafe(F.col("q")), "full").select(
        F.coalesce("p", "q").alias("pair"), F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b")
    )
    parted = both.withColumn("n_common", common_turns(F.col("a"), F.col("b")))
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.size(c))
    parted = parted.select("pair", "n_common", F.slice("a", 1, F.col("n_common")).alias("same"), rest("a").alias("a"), rest("b").alias("b"))
    return parted.select(
        F.col("pair").alias(pair),
        F.col("n_common").cast("long").alias("n_common"),
        render(F.col("same")).alias("prompt"),
        render(F.col("a")).alias("chosen"),
        render(F.col("b")).alias("rejected"),
        trained_spans(F.col("a"), trained).alias("chosen_mask"),
        trained_spans(F.col("b"), trained).alias("rejected_mask"),
    )
