"""Preference formatting of chat data, in DataFrame functions only.

The longest common turn prefix of a chosen and a rejected conversation is
rendered once, as the prompt; what follows is the pair of completions, with
the spans of characters on which a model would be trained.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortica.operators.order import running

START, END = "<|im_start|>", "<|im_end|>"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns: of each conversation its (turn, role, text) in order.

    Repeated rows count once; turns of one number are ordered by role and
    text.  A null role is 'unknown', a null text is empty; rows without a
    conv_id or a turn number go.  A conversation is one value of the result.
    """
    clean = turns.where("conv_id is not null and turn is not null").select("conv_id", F.struct("turn", F.coalesce(F.col("role"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("t"))
    return clean.groupBy("conv_id").agg(F.array_sort(F.collect_set("t")).alias("turns"))


def _render(turns):
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))), "")


def _mask(turns):
    """[start, end) of the characters to train on: the text and end mark of each assistant turn of a rendered completion."""
    sized = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), (F.length(t["role"]) + len(START) + 1).alias("head"), (F.length(t["text"]) + len(END)).alias("body")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
    return F.aggregate(
        sized,
        start,
        lambda acc, t: F.struct(
            (acc["at"] + t["head"] + t["body"] + 1).alias("at"),
            F.when(t["role"] == "assistant", F.concat(acc["out"], F.array(F.array(acc["at"] + t["head"], acc["at"] + t["head"] + t["body"])))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def preferences(pairs: DataFrame, turns: DataFrame) -> DataFrame:
    """For pairs (pair_id, chosen_id, rejected_id): the prompt and both completions.

    Turns are equal when role and text are.  Equal conversations give two
    empty completions; a pair whose conversation is missing is left out.
    Returns pair_id, chosen_id, rejected_id, n_prompt_turns, prompt, chosen,
    rejected and the masks chosen_mask and rejected_mask.
    """
    convs = conversations(turns)
    return _formatted(pairs.join(convs.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("a")), "chosen_id").join(convs.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("b")), "rejected_id"))


def _formatted(both: DataFrame) -> DataFrame:
    """both: pair_id, chosen_id, rejected_id and the turns of either side, a and b."""
    least = F.least(F.size("a"), F.size("b"))
    differ = F.filter(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), lambda i: (F.element_at("a", i.cast("int"))["role"] != F.element_at("b", i.cast("int"))["role"]) | (F.element_at("a", i.cast("int"))["text"] != F.element_at("b", i.cast("int"))["text"]))
    both = both.withColumn("n", F.coalesce(F.try_element_at(differ, F.lit(1)) - 1, least))
    left = {side: F.slice(side, F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0))) for side in "ab"}
    return both.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        F.col("n").cast("long").alias("n_prompt_turns"),
        _render(F.slice("a", F.lit(1), F.col("n"))).alias("prompt"),
        _render(left["a"]).alias("chosen"),
        _render(left["b"]).alias("rejected"),
        _mask(left["a"]).alias("chosen_mask"),
        _mask(left["b"]).alias("rejected_mask"),
    )


def rivals(turns: DataFrame) -> DataFrame:
    """As ``preferences``, of every conversation with an assistant turn against itself with another's last answer.

    chosen is the conversation (chosen_id, which is the pair_id too), rejected its
    turns before its last assistant turn and then the last assistant turn of the
    next conversation in the order of md5 of conv_id (rejected_id), the first one
    following the last.  All turns before the last assistant turn are prompt.  An
    only conversation is its own rival; a rival that answers alike leaves an empty
    rejected completion, and the prompt then holds that turn too.
    """
    convs = conversations(turns)
    last = F.array_max(F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i + 1)), lambda i: i.isNotNull()))
    convs = convs.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("a"), last.alias("last")).where("last is not null")
    placed = running(convs.withColumn("digest", F.md5(F.col("chosen_id").cast("string"))), [], ["digest", "chosen_id"], place=F.lit(1)).drop("digest")
    n = placed.count()
    donors = placed.select(F.pmod(F.col("place") - 1, F.lit(max(n, 1))).alias("place"), F.col("chosen_id").alias("rejected_id"), F.element_at("a", F.col("last")).alias("answer"))
    both = placed.join(donors, "place").withColumn("b", F.concat(F.slice("a", F.lit(1), F.col("last") - 1), F.array("answer")))
    return _formatted(both.withColumn("pair_id", F.col("chosen_id")))


def neighbours(turns: DataFrame) -> DataFrame:
    """Pairs of conversations 2 i (chosen) and 2 i + 1 (rejected)."""
    ids = turns.where("conv_id is not null").select("conv_id").distinct()
    side = ids.select(F.expr("(conv_id - pmod(conv_id, 2)) div 2").alias("pair_id"), "conv_id", F.expr("pmod(conv_id, 2)").alias("odd"))
    return side.groupBy("pair_id").agg(F.max(F.when(F.col("odd") == 0, F.col("conv_id"))).alias("chosen_id"), F.max(F.when(F.col("odd") == 1, F.col("conv_id"))).alias("rejected_id")).where("chosen_id is not null and rejected_id is not null")
