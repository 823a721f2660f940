"""Chat formatting with cumulative-snapshot collapse (operator 4).

Built-in DataFrame functions only. A log often holds a conversation again each
time it has grown. Each turn's place, role and text are hashed to 128 bits, and
the hashes of the turns up to each turn are folded into a rolling prefix hash;
an anti-join of whole conversations to the proper prefixes of others keeps those
that no longer conversation starts with, and of equal ones that of the smallest
conv_id. What is kept is rendered.

Cases: turns come in order of turn (null first), then role and text (null
first); rows equal in all four columns count once. A null conv_id is a
conversation like others, kept only if no equal one has an id. A null role is
rendered as `unknown`, a null text as empty; they differ from those values when
conversations are compared. An empty table gives an empty result. Columns beside
these four aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.llm.shared import with_starts, written

#: Turn numbers are dealt by so many to parts of a conversation.
TURNS_A_PART = 64
#: Turns rendered in one row; a longer conversation takes several rows.
TURNS_A_ROW = 256


def _turn_hash(seed: int) -> Column:
    fields = [F.lit(seed), F.col("place"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.lit(seed * 31), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    return F.xxhash64(*(fields if seed % 2 else fields[::-1]))


def turns(conversations: DataFrame) -> DataFrame:
    """The turns, each once, with place (from 1) and the rolling hashes of all up to it (p1, p2)."""
    key = F.when(F.col("conv_id").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    rows = conversations.select("conv_id", "turn", "role", "text").distinct().withColumn("key", key)
    part = F.floor(F.col("turn") / TURNS_A_PART).cast("long")
    rows = rows.withColumn("part", F.when(F.col("turn").isNull(), F.lit(-(2**63))).otherwise(part))
    order = [F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text")]
    rows = with_starts(rows, ["key"], "part", order, {"before": (F.sum, F.lit(1), 0)}).withColumn("place", F.col("before") + 1)
    rows = rows.withColumns({"h1": _turn_hash(1), "h2": _turn_hash(2)})
    rows = with_starts(rows, ["key"], "part", [F.col("place")], {"b1": (F.bit_xor, F.col("h1"), 0), "b2": (F.bit_xor, F.col("h2"), 0)})
    return rows.select("key", "conv_id", "place", "role", "text", F.col("b1").bitwiseXOR(F.col("h1")).alias("p1"), F.col("b2").bitwiseXOR(F.col("h2")).alias("p2"))


def maximal(rolled: DataFrame) -> DataFrame:
    """key and n_turns of the conversations that are kept."""
    whole = rolled.groupBy("key", "conv_id").agg(F.max(F.struct("place", "p1", "p2")).alias("w"))
    whole = written(whole.select("key", "conv_id", F.col("w.place").alias("n"), "w.p1", "w.p2"), "whole")
    one = whole.groupBy("n", "p1", "p2").agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "key")).alias("who"))
    ends = whole.select("key", F.col("n").alias("last"))
    proper = rolled.select("key", "place", "p1", "p2").join(ends, "key").where(F.col("place") < F.col("last"))
    proper = proper.groupBy(F.col("place").alias("n"), "p1", "p2").agg(F.count("*").alias("times"))
    return one.join(proper, ["n", "p1", "p2"], "left_anti").select("who.key", F.col("n").alias("n_turns"))


def render(role: Column, text: Column) -> Column:
    """One turn between start and end marks."""
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("unknown")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def format_chats(conversations: DataFrame, turns_a_row: int = TURNS_A_ROW) -> DataFrame:
    """The conversations that are kept, rendered: conv_id, part (from 0, one for
    each `turns_a_row` turns), n_turns (of the conversation) and rendered; the
    parts of a conversation, put end to end, are its text."""
    rolled = written(turns(conversations), "turns")
    kept = maximal(rolled)
    part = F.floor((F.col("place") - 1) / turns_a_row).cast("int").alias("part")
    rows = rolled.join(kept, "key").select("key", "conv_id", part, "n_turns", F.struct("place", render(F.col("role"), F.col("text")).alias("said")).alias("t"))
    said = F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["said"]), "")
    return rows.groupBy("key", "conv_id", "part", "n_turns").agg(said.alias("rendered")).select("conv_id", "part", F.col("n_turns").cast("long").alias("n_turns"), "rendered")
