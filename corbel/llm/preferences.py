"""Preference formatting: one prompt from the longest common turn prefix, and paired masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is written; what follows the first mark of an assistant's turn is learnt from.
OPEN, CLOSE = "<|{role}|>\n", "\n<|end|>\n"


def _turns(turns: DataFrame) -> DataFrame:
    """(conv_id, conv): turns in order; ties of a turn's number fall in order of role, then text, nulls first."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.filter("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("conv"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit(CLOSE))), "")


def _mask(turns: Column) -> Column:
    """Start and end, in characters of the rendered completion, of what assistants say with its closing mark."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(t["role"]) + 5
        end = start + F.length(t["text"]) + len(CLOSE)
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def format_preferences(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)``, ``pairs(chosen_id, rejected_id)`` -> one row for each pair.

    Columns: chosen_id, rejected_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask.  The prompt is
    the longest prefix of turns that both conversations have alike in role and text, written once; the completions are
    what follows in each; masks list the spans that assistants say.  A null role or text counts as empty, repeated turns
    stay, a pair with an unknown or null id is left out, and equal conversations have empty completions.  Other columns
    are ignored.
    """
    convs = _turns(turns)
    both = pairs.select("chosen_id", "rejected_id").join(convs.select(F.col("conv_id").alias("chosen_id"), F.col("conv").alias("c")), "chosen_id").join(convs.select(F.col("conv_id").alias("rejected_id"), F.col("conv").alias("r")), "rejected_id")
    least = F.least(F.size("c"), F.size("r"))
    same = F.zip_with(F.slice("c", 1, least), F.slice("r", 1, least), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    first = F.array_position(same, F.lit(False))
    both = both.withColumn("n", F.when(first > 0, first - 1).otherwise(least).cast("int"))
    rest = both.select("chosen_id", "rejected_id", "n", F.slice("c", 1, F.col("n")).alias("p"), F.slice("c", F.col("n") + 1, F.size("c")).alias("c"), F.slice("r", F.col("n") + 1, F.size("r")).alias("r"))
    return rest.select(
        "chosen_id", "rejected_id", F.col("n").alias("n_prompt_turns"), _rendered(F.col("p")).alias("prompt"), _rendered(F.col("c")).alias("chosen"), _rendered(F.col("r")).alias("rejected"),
        _mask(F.col("c")).alias("chosen_mask"), _mask(F.col("r")).alias("rejected_mask"),
    )


def degraded(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with a worse twin of every conversation that an assistant ends well, and the pairs of both.

    The twin of conv_id has the number -1 - conv_id, or where ids go down to a negative n, 2 n - 1 - conv_id, so none is taken.
    It repeats the conversation, except that its last assistant turn repeats the assistant's first, or refuses where there is
    only one.  Of turns that share a number the least text is the first, and all that have the last number are replaced; turns
    without a number stay as they are.  All conversations with an assistant's turn take part; turns without an id have no twin; an empty table has none.
    """
    lowest = min(0, turns.agg(F.min("conv_id").alias("id")).first().id or 0)
    twin_id = F.lit(2 * lowest - 1) - F.col("conv_id")
    said = turns.filter("role = 'assistant' and conv_id is not null")
    ends = said.groupBy("conv_id").agg(F.max("turn").alias("last"), F.min_by("text", F.struct("turn", F.coalesce("text", F.lit("")))).alias("first_text"), F.min("turn").alias("first"))
    twin = turns.join(ends, "conv_id")
    worse = F.when((F.col("turn") == F.col("last")) & (F.col("role") == "assistant"), F.when(F.col("first") < F.col("last"), F.col("first_text")).otherwise(F.lit("I cannot help with that."))).otherwise(F.col("text"))
    twin = twin.select(twin_id.alias("conv_id"), "turn", "role", worse.alias("text"))
    pairs = ends.select(F.col("conv_id").alias("chosen_id"), twin_id.alias("rejected_id"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(twin), pairs


def siblings(turns: DataFrame) -> DataFrame:
    """Pairs of conversations that open alike: the least of each such group is chosen over every other one.

    A conversation opens with the first of its turns by number, role and text, as ``format_preferences`` orders them: one opening,
    however many turns share the first number.  Null numbers, roles and texts come first, and the last two count as empty.
    """
    empty = lambda c: F.coalesce(c, F.lit(""))
    first = turns.groupBy("conv_id").agg(F.min(F.struct("turn", empty("role").alias("role"), empty("text").alias("text"))).alias("t"))
    opening = first.select("conv_id", F.md5(F.concat_ws("\n", "t.role", "t.text")).alias("opening"))
    least = opening.groupBy("opening").agg(F.min("conv_id").alias("chosen_id"))
    return opening.join(least, "opening").filter("conv_id > chosen_id").select("chosen_id", F.col("conv_id").alias("rejected_id"))
