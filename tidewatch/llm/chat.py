"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns of the two is rendered once as the prompt; the rest of
each is its completion.  Completions come with masks: the character ranges of assistant
turns, the only ones a trainer should learn from.  The prefix is found by joining turns by
place and taking the first place that differs, an ordinary aggregate, and the renderings
are gathered per conversation.

Rendering of a turn: ``<|role|>`` line, text, ``<|end|>`` line.

Defined cases: null role and text are empty; turns go by turn number, then role and text
for ties, and a null turn number comes first; a turn repeated whole is a turn; a
conversation with no partner makes no pair; equal conversations are all prompt with empty
completions; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import stored

ROLE = "assistant"


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>\n"))


def ordered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, at, role, text): turns numbered from 0 within their conversation."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    plain = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.filter("conv_id is not null").withColumn(
        "at", F.row_number().over(order) - 1).drop("turn")


def variants(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chosen, rejected) made from plain conversations, keyed by pair_id.

    Chosen is a conversation up to its last assistant turn.  Rejected has the same turns
    with that last reply replaced by the first reply of the conversation numbered one
    higher, or by an empty reply where there is none.
    """
    numbered = stored(ordered_turns(turns), "turns")
    replies = numbered.filter(F.col("role") == ROLE)
    ends = replies.groupBy("conv_id").agg(F.max("at").alias("end"), F.min_by("text", "at").alias("first"))
    others = ends.select((F.col("conv_id") - 1).alias("conv_id"), F.col("first").alias("other"))
    ends = ends.drop("first").join(others, "conv_id", "left")
    chosen = numbered.join(ends, "conv_id").filter("at <= end")
    last = F.col("at") == F.col("end")
    rejected = chosen.withColumn(
        "text", F.when(last, F.coalesce("other", F.lit(""))).otherwise(F.col("text")))
    columns = [F.col("conv_id").alias("pair_id"), "at", "role", "text"]
    return chosen.select(*columns), rejected.select(*columns)


def _gathered(turns: DataFrame, name: str) -> DataFrame:
    """Renderings of one side beyond the prefix, in order, and the ranges of its replies."""
    parts = turns.filter("at >= prefix").withColumn(
        "length", F.length(rendered(F.col("role"), F.col("text"))))
    before = Window.partitionBy("pair_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0)))
    inner = F.length(F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n")))
    mask = F.when(F.col("role") == ROLE, F.concat_ws(
        ":", (F.col("start") + inner).cast("string"),
        (F.col("start") + F.col("length")).cast("string")))
    rows = F.sort_array(F.collect_list(F.struct(
        "at", rendered(F.col("role"), F.col("text")).alias("r"), mask.alias("m"))))
    return parts.groupBy("pair_id").agg(rows.alias("rows")).select(
        "pair_id", F.array_join(F.transform("rows", lambda x: x["r"]), "").alias(name),
        F.array_join(F.transform("rows", lambda x: x["m"]), ",").alias(f"{name}_mask"))


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row per pair: pair_id, prefix_turns, prompt, chosen, chosen_mask, rejected,
    rejected_mask.  Inputs: (pair_id, at, role, text), ``at`` counting from 0."""
    other = rejected.select("pair_id", "at", F.struct("role", "text").alias("b"))
    met = chosen.select("pair_id", "at", F.struct("role", "text").alias("a")).join(
        other, ["pair_id", "at"], "full")
    differs = ~F.col("a").eqNullSafe(F.col("b"))
    # Turns are numbered without gaps, so the first place that differs ends the prefix.
    prefixes = met.groupBy("pair_id").agg(
        F.coalesce(F.min(F.when(differs, F.col("at"))), F.max("at") + 1).cast("long").alias("prefix"),
        (F.max(F.col("a").isNotNull()) & F.max(F.col("b").isNotNull())).alias("both")).filter(
        "both").drop("both")
    good, bad = chosen.join(prefixes, "pair_id"), rejected.join(prefixes, "pair_id")
    prompt = good.filter("at < prefix").groupBy("pair_id").agg(F.sort_array(F.collect_list(
        F.struct("at", rendered(F.col("role"), F.col("text")).alias("r")))).alias("rows")).select(
        "pair_id", F.array_join(F.transform("rows", lambda x: x["r"]), "").alias("prompt"))
    none = F.lit("")
    return prefixes.join(prompt, "pair_id", "left").join(
        _gathered(good, "chosen"), "pair_id", "left").join(
        _gathered(bad, "rejected"), "pair_id", "left").select(
        "pair_id", F.col("prefix").alias("prefix_turns"), F.coalesce("prompt", none).alias("prompt"),
        *[F.coalesce(c, none).alias(c) for c in ("chosen", "chosen_mask", "rejected", "rejected_mask")])
