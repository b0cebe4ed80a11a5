"""Preference formatting: pairs of conversations as one prompt and two masked completions.

A pair has a chosen and a rejected conversation.  The longest common prefix of their turns (same role and
same text) is rendered once, as the prompt; the turns after it are rendered as the two completions.  Only
what the assistant says (and the mark that ends it) is to be trained on: the mask lists those parts of a
completion as `start:end` in code points, everything else is masked out.

Everything is DataFrame functions.  Turns are put in order of turn, then role, then text, so the order of
the rows does not matter; repeated rows are turns like others.  Turns with a null turn come first; null role
or text counts as empty.  Rows with a null pair or side are left out.  A pair whose one side is missing has
no common prefix and an empty completion on that side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelgrid.llm.common import pick

OPEN, CLOSE, END = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED = "assistant"


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE), t["text"], F.lit(END))), "")


def mask(turns: Column) -> Column:
    """`start:end` of what the assistant says within the rendered turns, its end mark included."""
    head = lambda t: F.length(t["role"]) + F.lit(len(OPEN) + len(CLOSE))
    tail = lambda t: F.length(t["text"]) + F.lit(len(END))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        after = state["at"] + head(t) + tail(t)
        span = F.concat_ws(":", state["at"] + head(t), after)
        spans = F.when(t["role"] == TRAINED, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(after.alias("at"), spans.alias("spans"))

    return F.array_join(F.aggregate(turns, start, step)["spans"], ",")


def preference_pairs(turns: DataFrame) -> DataFrame:
    """pair_id, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask from rows of
    (pair_id, side = chosen / rejected, turn, role, text).  What is gathered per pair is the pair itself,
    which is one row of the result."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sides = (
        pick(turns, "pair_id", "side", "turn", "role", "text").filter("pair_id is not null and side in ('chosen', 'rejected')")
        .groupBy("pair_id").agg(*[
            F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == s, turn))),
                        lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(s)
            for s in ("chosen", "rejected")])
    )
    # a missing side's turns compare as null, which is a difference too
    same = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    differs = F.array_position(same, False)
    common = sides.withColumn("n", F.when(differs > 0, F.least(differs - 1, shorter)).otherwise(shorter).cast("int"))
    rest = lambda s: F.slice(s, F.col("n") + 1, F.greatest(F.size(s) - F.col("n"), F.lit(0)))
    parts = common.select("pair_id", F.col("n").cast("bigint").alias("n_prompt_turns"),
                          F.slice("chosen", F.lit(1), F.col("n")).alias("p"), rest("chosen").alias("c"), rest("rejected").alias("r"))
    return parts.select("pair_id", "n_prompt_turns", rendered(F.col("p")).alias("prompt"),
                        rendered(F.col("c")).alias("chosen"), mask(F.col("c")).alias("chosen_mask"),
                        rendered(F.col("r")).alias("rejected"), mask(F.col("r")).alias("rejected_mask"))


def shared_start(pairs: DataFrame, most: int = 3) -> DataFrame:
    """The same rows, but the rejected side begins with the first h turns of the chosen one in place of its own first
    h, as answers to one prompt do; h is a digest of pair_id, from 0 to `most`.  Turns are numbered anew from 1."""
    order = [F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))]
    rows = pairs.select("pair_id", "side", F.row_number().over(Window.partitionBy("pair_id", "side").orderBy(*order)).cast("bigint").alias("turn"),
                        "role", "text", (F.crc32(F.col("pair_id").cast("string")) % (most + 1)).alias("h"))
    sides = F.when(F.col("side") == "rejected", F.array("side")).when(F.col("turn") <= F.col("h"), F.array(F.lit("chosen"), F.lit("rejected"))).otherwise(F.array("side"))
    return rows.filter("side = 'chosen' or turn > h").withColumn("side", F.explode(sides)).drop("h")


def paired(conversations: DataFrame) -> DataFrame:
    """Conversations 2k and 2k + 1 as the chosen and the rejected side of pair k."""
    rows = pick(conversations, "conv_id", "turn", "role", "text").filter("conv_id is not null")
    return rows.select(F.shiftright("conv_id", 1).alias("pair_id"),
                       F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected").alias("side"),
                       "turn", "role", "text")
