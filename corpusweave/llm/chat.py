"""Preference formatting of conversations (native).

A pair has a chosen and a rejected conversation. Their longest common prefix of turns is rendered once, as the
prompt; what follows is rendered as two completions. Masks are half-open character spans, counted from the start
of the completion, that cover the replies to learn from (content and end mark of assistant turns).

Edge cases: a null role is ``unknown``, a null text is empty, turns are ordered by turn, role and text with null
turns first, repeated rows are repeated turns; rows without conv_id belong to no conversation and are left out;
pairs that are equal have empty completions and masks; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import let

OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"
LEARN = "assistant"


def gather(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, turns: array of (role, text) in order."""
    turn = F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return (turns.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
            .select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns")))


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    end = lambda s: F.array_position(s, F.lit(False)).cast("int")
    return let(same, lambda s: F.when(end(s) > 0, end(s) - 1).otherwise(F.size(s)))


def render_turn(x: Column) -> Column:
    return F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), x["text"], F.lit(CLOSE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, render_turn), "")


def mask(turns: Column) -> Column:
    """Spans (start, end) to learn from, in characters of ``render(turns)``."""
    span_type = "array<struct<start:int,stop:int>>"

    def step(acc: Column, x: Column) -> Column:
        head = F.length(x["role"]) + 5
        end = acc["at"] + head + F.length(x["text"]) + len(CLOSE)
        more = F.array_append(acc["spans"], F.struct((acc["at"] + head).alias("start"), end.alias("stop")))
        return F.struct(end.alias("at"), F.when(x["role"] == LEARN, more).otherwise(acc["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(span_type).alias("spans"))
    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pairs(pair_id, chosen, rejected: arrays of (role, text)) -> prompt, two completions and their masks."""
    p = pairs.withColumn("n", common_turns(F.col("chosen"), F.col("rejected")))
    tail = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    p = p.withColumns({"head": F.slice("chosen", F.lit(1), F.col("n")), "c": tail("chosen"), "r": tail("rejected")})
    return p.select("pair_id", F.col("n").alias("prompt_turns"), render(F.col("head")).alias("prompt"), render(F.col("c")).alias("chosen"),
                    mask(F.col("c")).alias("chosen_mask"), render(F.col("r")).alias("rejected"), mask(F.col("r")).alias("rejected_mask"))


def reply_pairs(turns: DataFrame) -> DataFrame:
    """A pair for each conversation: chosen is the conversation itself; rejected has, in place of its middle reply (of an even
    number the one before the middle), the text of the reply after it, or nothing where there is one reply only.

    Turns before that reply are the common prefix, and it and all turns after it the completions. A conversation without a
    reply is paired with itself.
    """
    c = gather(turns)
    numbered = F.transform("turns", lambda x, i: F.when(x["role"] == LEARN, i))
    c = c.withColumn("replies", F.array_compact(numbered))
    middle = F.floor((F.size("replies") + 1) / 2).cast("int") - 1
    c = c.withColumns({"here": F.get("replies", middle), "next": F.get("replies", middle + 1)})
    other = F.coalesce(F.get("turns", F.col("next"))["text"], F.lit(""))
    swapped = F.transform("turns", lambda x, i: F.when(F.coalesce(i == F.col("here"), F.lit(False)), F.struct(x["role"].alias("role"), other.alias("text"))).otherwise(x))
    return c.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), swapped.alias("rejected"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string"))), ",")
