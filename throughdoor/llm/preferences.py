"""Preference formatting: one prompt, two masked completions.

Two conversations, one preferred to the other, agree up to some turn. What they
share is rendered once as the prompt; from the first turn that differs on, each
side is a completion, in which only what the assistant says is trained on.

Everything is a DataFrame expression, and a conversation is never gathered: the
result has a row per rendered turn, in the order (pair_id, part, turn, place).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values of the template
OPEN, CLOSE, END = "<|", "|>", "<|end|>"


def _safe(c: Column) -> Column:
    """Markers inside a turn are split by a space, so they open nothing."""
    return F.replace(c, F.lit(OPEN), F.lit("< |"))


def heading(role: Column) -> Column:
    return F.concat(F.lit(OPEN), _safe(role), F.lit(CLOSE + "\n"))


def rendered(role: Column, text: Column) -> Column:
    """A turn as text."""
    return F.concat(heading(role), _safe(text), F.lit(END + "\n"))


def _turns(side: DataFrame, name: str) -> DataFrame:
    """(pair_id, turn, <name>): what is said at each turn, repeats once, in a fixed order."""
    said = F.struct(F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = side.where("pair_id IS NOT NULL AND turn IS NOT NULL")
    return rows.groupBy("pair_id", "turn").agg(F.sort_array(F.collect_set(said)).alias(name))


def formatted(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rendered turns of pairs of conversations (pair_id, turn, role, text).

    pair_id, part (``prompt``, ``chosen``, ``rejected``), turn, place, role,
    text, loss, loss_from. The prompt is the longest run of equal turns from the
    start, by turn number; ``loss`` marks what is trained on: assistant turns of
    a completion, from code point ``loss_from`` of the text (behind the heading)
    to its end. Null roles and texts are empty. Rows of one conversation and
    turn are rendered one after the other, exact repeats once. Rows without
    pair_id or turn have no place and are left out. A pair whose sides are
    equal is all prompt; a side that is missing has no completion.
    """
    both = _turns(chosen, "c").join(_turns(rejected, "r"), ["pair_id", "turn"], "full_outer")
    fork = both.where(~F.col("c").eqNullSafe(F.col("r"))).groupBy("pair_id").agg(F.min("turn").alias("fork"))
    parted = both.join(fork, "pair_id", "left")
    part = lambda name, said: F.struct(F.lit(name).alias("part"), said.alias("said"))
    shared = F.col("fork").isNull() | (F.col("turn") < F.col("fork"))
    parts = F.when(shared, F.array(part("prompt", F.col("c")))).otherwise(
        F.array(part("chosen", F.col("c")), part("rejected", F.col("r"))))
    rows = parted.select("pair_id", "turn", F.explode(F.filter(parts, lambda p: p["said"].isNotNull())).alias("p"))
    rows = rows.select("pair_id", "p.part", "turn", F.posexplode("p.said").alias("place", "one"))
    loss = (F.col("part") != "prompt") & (F.col("one.role") == "assistant")
    return rows.select("pair_id", "part", "turn", "place", F.col("one.role").alias("role"),
                       rendered(F.col("one.role"), F.col("one.text")).alias("text"), loss.alias("loss"),
                       F.when(loss, F.length(heading(F.col("one.role")))).alias("loss_from"))


def assembled(rows: DataFrame) -> DataFrame:
    """(pair_id, prompt, chosen, rejected, chosen_loss, rejected_loss) from ``formatted`` rows.

    For conversations that fit one training example: a pair becomes a row. The
    losses are arrays of (start, end) code points of the completion.
    """
    turn = F.struct("turn", "place", "text", "loss", "loss_from")
    grouped = rows.groupBy("pair_id").agg(*[
        F.sort_array(F.collect_list(F.when(F.col("part") == p, turn))).alias(p) for p in ("prompt", "chosen", "rejected")])

    def spans(turns: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

        def step(state: Column, t: Column) -> Column:
            end = state["at"] + F.length(t["text"])
            span = F.array(F.struct((state["at"] + t["loss_from"]).alias("start"), end.alias("end")))
            return F.struct(end.alias("at"), F.when(t["loss"], F.concat(state["spans"], span))
                            .otherwise(state["spans"]).alias("spans"))

        return F.aggregate(turns, start, step, lambda state: state["spans"])

    text = lambda c: F.array_join(F.transform(c, lambda t: t["text"]), "")
    return grouped.select("pair_id", *[text(F.col(p)).alias(p) for p in ("prompt", "chosen", "rejected")],
                          *[spans(F.col(p)).alias(f"{p}_loss") for p in ("chosen", "rejected")])


def reply_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides from plain conversations (conv_id, turn, role, text).

    Chosen is a conversation up to its last assistant turn. Rejected is the same
    with that turn replaced by the last assistant turn of its partner, whose id
    differs in the lowest bit. A conversation without an assistant turn, or
    whose partner has none, makes no pair.
    """
    rows = conversations.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    says = F.col("role") == "assistant"
    last = rows.where(says).groupBy("conv_id").agg(F.max("turn").alias("last"))
    # of several texts at that turn, the first in order
    reply = (rows.where(says).join(last, "conv_id").where("turn = last").groupBy("conv_id", "last")
             .agg(F.min(F.coalesce("text", F.lit(""))).alias("reply")))
    other = reply.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("reply").alias("other"))
    paired = reply.join(other, "conv_id")
    turns = rows.join(paired.select("conv_id", "last"), "conv_id").where("turn < last")
    before = turns.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    end = lambda text: paired.select(
        F.col("conv_id").alias("pair_id"), F.col("last").alias("turn"), F.lit("assistant").alias("role"),
        F.col(text).alias("text"))
    return before.union(end("reply")), before.union(end("other"))
