"""Preference formatting of chat conversations.

A pair holds a chosen and a rejected conversation. Their longest common prefix
of turns is rendered once, as the prompt; what follows in each is its
completion, with a mask that trains the assistant's words only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import written

TURNS = "array<struct<role:string,text:string>>"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): one row per conversation, turns in order.

    turns: (conv_id, turn, role, text). Equal turn numbers order by role, then
    text, nulls first; exact repeats of a turn are one turn. Rows without
    conv_id belong to no conversation and go. A null role or text is empty.
    """
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).alias("t"))
    held = rows.groupBy("conv_id").agg(F.sort_array(F.array_distinct(F.collect_list("t"))).alias("t"))
    return held.select("conv_id", F.transform("t", lambda x: F.struct(F.coalesce(x["role"], F.lit("")).alias("role"), F.coalesce(x["text"], F.lit("")).alias("text"))).alias("turns"))


def _render(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render), "")


def _mask(turns: Column) -> Column:
    """start:end of the assistant's words and end mark, in code points of the rendered turns, end exclusive."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, turn: Column) -> Column:
        size = F.length(_render(turn)).cast("long")
        head = F.length(turn["role"]) + 5
        span = F.concat((acc["at"] + head).cast("string"), F.lit(":"), (acc["at"] + size - 1).cast("string"))
        return F.struct((acc["at"] + size).alias("at"), F.when(turn["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, start, step, lambda acc: acc["spans"]), ",")


def format_preferences(pairs: DataFrame) -> DataFrame:
    """pairs (pair_id, chosen, rejected), arrays of turns -> one formatted row per pair.

    pair_id, n_common (turns of the prompt), prompt, chosen and rejected
    (completions), chosen_mask and rejected_mask (comma-joined start:end).
    Equal conversations have empty completions; a null side counts as an empty
    conversation. Other columns are ignored.
    """
    sides = pairs.select("pair_id", *[F.coalesce(F.col(c).cast(TURNS), F.array().cast(TURNS)).alias(c) for c in ("chosen", "rejected")])
    both = F.arrays_zip(F.slice("chosen", 1, F.least(F.size("chosen"), F.size("rejected"))), F.slice("rejected", 1, F.least(F.size("chosen"), F.size("rejected"))))
    same = F.transform(both, lambda x: x["0"].eqNullSafe(x["1"]))
    first = F.array_position(same, F.lit(False))
    cut = sides.withColumn("n_common", F.when(first > 0, first - 1).otherwise(F.size(same)).cast("long"))
    rest = lambda c: F.slice(c, (F.col("n_common") + 1).cast("int"), F.greatest(F.size(c) - F.col("n_common").cast("int"), F.lit(0)))
    cut = cut.select("pair_id", "n_common", F.slice("chosen", F.lit(1), F.col("n_common").cast("int")).alias("p"), rest("chosen").alias("c"), rest("rejected").alias("r"))
    return cut.select("pair_id", "n_common", _joined(F.col("p")).alias("prompt"), _joined(F.col("c")).alias("chosen"), _joined(F.col("r")).alias("rejected"), _mask(F.col("c")).alias("chosen_mask"), _mask(F.col("r")).alias("rejected_mask"))


def paired_replies(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected) out of plain conversations, a pair for each that has an assistant turn.

    Chosen: a conversation up to its last assistant turn. Rejected: the same up
    to one of its assistant turns, the (conv_id mod their number)-th, which is
    replaced by the last reply of the next conversation by conv_id, the first
    one following the last. So pairs part at any depth.
    """
    held = conversations(turns)
    replies = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i + 1)), lambda i: i.isNotNull())
    ended = held.select("conv_id", "turns", replies.alias("at")).where(F.size("at") > 0)
    ended = ended.select("conv_id", F.slice("turns", F.lit(1), F.element_at("at", -1)).alias("chosen"), F.element_at("at", (F.pmod("conv_id", F.size("at")) + 1).cast("int")).alias("fork"))
    # the next one in order: inside a range of ids by a window, across ranges by a row per range
    ended = written(ended.repartitionByRange("conv_id").withColumn("part", F.spark_partition_id()))
    reply = F.element_at("chosen", -1)["text"]
    heads = ended.groupBy("part").agg(F.min_by(reply, "conv_id").alias("head"))
    order = Window.orderBy("part")  # as many rows as partitions
    heads = heads.select("part", F.coalesce(F.lead("head").over(order), F.first("head").over(order)).alias("head"))
    own = ended.withColumn("next", F.lead(reply).over(Window.partitionBy("part").orderBy("conv_id"))).join(heads, "part")
    turn = F.struct(F.lit("assistant").alias("role"), F.coalesce("next", "head").alias("text"))
    return own.select(F.col("conv_id").alias("pair_id"), "chosen", F.concat(F.slice("chosen", F.lit(1), F.col("fork") - 1), F.array(turn)).alias("rejected"))
