"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

A log that writes a conversation after each turn holds every prefix of it. Each conversation gets rolling hashes of its
turn prefixes; one whose full hash is a proper-prefix hash of a longer conversation is a snapshot of that one and goes
(anti-join), and of conversations with the same turns the smallest conv_id stays. What stays is rendered.

Hashes are reduced before they meet: equal full hashes to their smallest conv_id, prefix hashes to distinct ones, both
with map-side partial aggregation, so a first turn or a conversation that very many rows share never gathers in one
task. Only a single conversation's own turns come together, as its rendering has to.

Edge cases: null role counts as '' and null text as empty; turns are ordered by turn (nulls first), then role and text,
and rows that repeat a turn are all rendered; rows without a conv_id are left out, as they are no conversation; an
empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agroloom.llm.common import written

#: Marks around each rendered turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def turn_text(turn: Column) -> Column:
    """One turn as unambiguous text: lengths first."""
    return F.concat(F.length(turn["role"]).cast("string"), F.lit(":"), turn["role"], F.length(turn["text"]).cast("string"), F.lit(":"), turn["text"])


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns, hashes): turns in order, and the rolling hash of each turn prefix."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    rolled = F.aggregate(
        "turns",
        F.array().cast("array<string>"),
        lambda held, t: F.concat(held, F.array(F.sha2(F.concat(F.coalesce(F.try_element_at(held, F.lit(-1)), F.lit("")), turn_text(t)), 256))),
    )
    return whole.withColumn("hashes", F.when(F.size("turns") > 0, rolled))


def rendered(turns: str | Column) -> Column:
    """The turns of a conversation as one training text."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE + "\n"))), "")


def collapse(rows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_same, rendered): the maximal conversations; n_same conversations have just these turns."""
    table = written(conversations(rows), "conversations")
    full = table.select("conv_id", F.element_at("hashes", -1).alias("full")).groupBy("full").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_same"))
    proper = table.select(F.explode(F.slice("hashes", 1, F.size("hashes") - 1)).alias("full")).distinct()
    maximal = full.join(proper, "full", "left_anti").select("conv_id", "n_same")
    return table.join(maximal, "conv_id").select("conv_id", F.size("turns").alias("n_turns"), "n_same", rendered("turns").alias("rendered"))
