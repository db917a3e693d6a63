"""Preference formatting: the longest common turn prefix of a chosen and a rejected conversation is the prompt.

All steps are DataFrame functions. A conversation is a table of turns (pair_id, turn, role, text). A message is rendered as
`<|role|>`, a line end, the text, `<|end|>` and a line end. The mask lists, for each completion, the spans that
count for the loss: text and end of the assistant's messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.llm.shared import written

END = "<|end|>\n"
SPAN = "array<struct<start:bigint,end:bigint>>"


def message(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit(END))


def turns_of(turns: DataFrame, side: str) -> DataFrame:
    """(pair_id, turn, role, text, side); null roles are `unknown`, null texts empty."""
    rows = turns.select(
        F.col("pair_id").cast("long").alias("pair_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.lit(side).alias("side"),
    )
    return rows.where("pair_id is not null and turn is not null")


def preference_pairs(chosen: DataFrame, rejected: DataFrame, segment_turns: int = 1024, learn: str = "assistant") -> DataFrame:
    """(pair_id, segment, n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans) for each pair whose sides differ.

    Turns stand in the order of `turn`; the messages of one turn, if there are several, in the order of role and text, repeated
    ones once. The prompt ends before the first turn in which the sides differ, and is rendered once. A pair is one row; only one
    of over segment_turns turns is a row for each segment_turns values of `turn`, so that a
    conversation without end is never gathered in one place: the segments' texts, joined in order, are the pair's. Spans
    are code points in the segment's completion, the end exclusive. Pairs that one side lacks have
    an empty prompt and completion there. Sides that are equal express no preference and give no row. Null pair_id or turn: no part. No turns give
    no rows; further columns are not read.
    """
    on = lambda s: F.bool_or(F.col("side") == s).alias(s)
    rows = turns_of(chosen, "chosen").unionByName(turns_of(rejected, "rejected"))
    rows = written(rows.groupBy("pair_id", "turn", "role", "text").agg(on("chosen"), on("rejected")), "turns")
    cuts = rows.where(F.col("chosen") != F.col("rejected")).groupBy("pair_id").agg(F.min("turn").alias("cut"))
    rows = rows.join(written(cuts, "cuts"), "pair_id").withColumn("shared", F.col("turn") < F.col("cut"))
    turn = F.struct("turn", "role", "text", "shared", "chosen", "rejected")
    segments = rows.groupBy("pair_id", F.floor(F.col("turn") / segment_turns).alias("segment")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def text(side: str, shared: bool) -> Column:
        own = F.filter("turns", lambda t: (t["shared"] == shared) & t[side])
        return F.array_join(F.transform(own, lambda t: message(t["role"], t["text"])), "")

    def spans(side: str) -> Column:
        own = F.filter("turns", lambda t: ~t["shared"] & t[side])
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("spans"))

        def add(state: Column, t: Column) -> Column:
            head = (state["at"] + F.char_length(t["role"]) + 5).cast("long")
            end = (head + F.char_length(t["text"]) + len(END)).cast("long")
            more = F.concat(state["spans"], F.array(F.struct(head.alias("start"), end.alias("end"))))
            return F.struct(end.alias("at"), F.when(t["role"] == learn, more).otherwise(state["spans"]).alias("spans"))

        return F.aggregate(own, start, add, lambda state: state["spans"])

    return segments.select(
        "pair_id", F.col("segment").cast("long").alias("segment"),
        F.size(F.filter("turns", lambda t: t["shared"])).cast("long").alias("n_prompt_turns"),
        text("chosen", True).alias("prompt"), text("chosen", False).alias("chosen"), text("rejected", False).alias("rejected"),
        spans("chosen").alias("chosen_spans"), spans("rejected").alias("rejected_spans"),
    )


def stale_replies(conversations: DataFrame, learn: str = "assistant") -> tuple[DataFrame, DataFrame]:
    """(chosen, rejected) turns from conversations (conv_id, turn, role, text), for tables without judged pairs.

    Both end with the conversation's last reply; in rejected, that is the conversation's first reply again.
    Conversations without a reply make no pair; those whose last reply equals the first make one without a preference.
    """
    turns = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    replies = turns.where((F.col("role") == learn) & F.col("turn").isNotNull()).groupBy("pair_id")
    replies = replies.agg(F.max("turn").alias("last"), F.min(F.struct("turn", "text"))["text"].alias("first_text"))
    own = (F.col("turn") == F.col("last")) & (F.col("role") == learn)
    rows = turns.join(written(replies, "replies"), "pair_id").where((F.col("turn") < F.col("last")) | own)
    rejected = rows.withColumn("text", F.when(own, F.col("first_text")).otherwise(F.col("text")))
    return rows.select("pair_id", "turn", "role", "text"), rejected.select("pair_id", "turn", "role", "text")
