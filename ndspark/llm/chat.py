"""Preference formatting of chosen and rejected conversations, in DataFrame functions only.

The longest common prefix of turns is the prompt and is rendered once; the turns after it are
the two completions, in which only the assistant's turns are training targets. A pair is one
row for each rendered turn, so a conversation of any length is never gathered: the first turn
that differs is a minimum over a pair's turns, aggregated before it is shuffled.

Texts are dealt out once, by conversation and turn, which also parts a very long conversation.
What holds for a whole conversation is found from numbers alone and comes to its turns by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the rendered format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TARGET_ROLE = "assistant"


def render(role: Column, text: Column) -> Column:
    """A turn between its marks; marks inside a role or text are broken by a space."""

    def plain(x: Column) -> Column:
        for mark in (OPEN, CLOSE):
            x = F.replace(x, F.lit(mark), F.lit(mark[0] + " " + mark[1:]))
        return x

    return F.concat(F.lit(OPEN), plain(role), F.lit("\n"), plain(text), F.lit(CLOSE + "\n"))


def unique_turns(
    df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv_id, turn, said): one row for each turn, a null role or text being empty. Of several
    rows for one turn the least by role, then text, counts. Rows without a key or number have no
    place in any conversation and are left out."""
    said = F.struct(
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    rows = df.where(F.col(key).isNotNull() & F.col(turn).isNotNull())
    return rows.groupBy(F.col(key).alias("conv_id"), F.col(turn).alias("turn")).agg(F.min(said).alias("said"))


def _with_value(turns: DataFrame, values: DataFrame, key: str, name: str) -> DataFrame:
    """Turns with the value of their conversation, null if it has none. Texts stay where they are:
    only numbers of conversations and turns go to the values and come back."""
    own = values.toDF(key, name)
    return turns.join(turns.select(key, "turn").join(own, key, "left"), [key, "turn"])


def format_preferences(
    chosen: DataFrame,
    rejected: DataFrame,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """(pair_id, part, turn, role, rendered, target), one row for each turn of a pair's prompt
    and of its two completions; part is prompt, chosen or rejected, target whether its tokens
    are trained on: the assistant's turns of the completions.

    Turns are aligned by their number. The prompt ends before the first number at which the
    sides differ in role or text, or that one side lacks; pairs without a difference are all
    prompt. Null roles and texts are empty ones. Rows without a key or number have no place and
    are left out; of several rows for one turn of a side the least by role, then text, counts.
    Texts may be of any length. Other columns are not read. Empty tables give an empty result.
    """
    left, right = (
        unique_turns(df, key, turn, role, text).toDF("pair_id", "turn", side)
        for df, side in ((chosen, "c"), (rejected, "r"))
    )
    split = (
        left.join(right, ["pair_id", "turn"], "full")
        .where(~F.col("c").eqNullSafe(F.col("r")))
        .groupBy("pair_id")
        .agg(F.min("turn").alias("first"))
    )
    sides = [_with_value(df, split, "pair_id", f"first_{i}") for i, df in enumerate((left, right))]
    placed = sides[0].join(sides[1], ["pair_id", "turn"], "full").withColumn("first", F.coalesce("first_0", "first_1"))
    shared = F.col("first").isNull() | (F.col("turn") < F.col("first"))
    parts = F.when(shared, F.array(F.struct(F.lit("prompt").alias("part"), F.col("c").alias("said")))).otherwise(
        F.array(
            F.struct(F.lit("chosen").alias("part"), F.col("c").alias("said")),
            F.struct(F.lit("rejected").alias("part"), F.col("r").alias("said")),
        )
    )
    rows = placed.select("pair_id", "turn", F.explode(parts).alias("p")).where("p.said is not null")
    said_by = F.col("p.said.role")
    return rows.select(
        "pair_id",
        F.col("p.part").alias("part"),
        "turn",
        said_by.alias("role"),
        render(said_by, F.col("p.said.text")).alias("rendered"),
        ((F.col("p.part") != "prompt") & (said_by == TARGET_ROLE)).alias("target"),
    )


def swapped_answers(conversations: DataFrame) -> DataFrame:
    """A rejected side for each conversation: its turns, the last answer replaced by that of the
    conversation with the next id (empty if that has none), and what follows left out. A
    conversation without an answer stays as it is, so that it is all prompt. Turns are those of
    unique_turns()."""
    turns = unique_turns(conversations)
    last = turns.where(F.col("said.role") == TARGET_ROLE).groupBy("conv_id").agg(F.max("turn").alias("turn"))
    answers = turns.join(last, ["conv_id", "turn"]).select((F.col("conv_id") - 1).alias("conv_id"), F.col("said.text").alias("other"))
    swaps = last.join(answers, "conv_id", "left").select("conv_id", "turn", F.coalesce("other", F.lit("")).alias("other"))
    return (
        _with_value(turns, last, "conv_id", "last")
        .where("last is null or turn <= last")
        .join(swaps, ["conv_id", "turn"], "left")
        .select("conv_id", "turn", F.col("said.role").alias("role"), F.coalesce("other", "said.text").alias("text"))
    )
