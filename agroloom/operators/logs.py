"""Mining of question logs: clean, skip, group near-duplicates, rank by frequency, take quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that don't change what is asked, and spellings that mean the same; our own lists, both parameters.
GENERIC = ("the", "of", "in", "a", "an", "to", "for", "about", "how", "and", "or", "is")
SYNONYMS = (("aphids", "aphid"), ("rice", "paddy"), ("weed", "weeds"))


def dedupe_key(text: Column, generic: tuple[str, ...] = GENERIC, synonyms: tuple[tuple[str, str], ...] = SYNONYMS) -> Column:
    """Sorted set of the meaningful ASCII words, as text: near-duplicate questions share it."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")

    def same(w: Column) -> Column:
        for a, b in synonyms:
            w = F.when(w == a, F.lit(b)).otherwise(w)
        return w

    kept = F.filter(F.transform(words, same), lambda w: ~w.rlike("^(19|20)[0-9][0-9]$") & ~w.isin(*generic) & ~w.rlike("^(inf|regard)[a-z0-9_]*$"))
    return F.array_join(F.array_sort(F.array_distinct(kept)), " ")


def groups(rows: DataFrame, topic: str, key: str, example: str, order: str) -> DataFrame:
    """(topic, key, n, example): how often each question of a topic is asked, and the first one asked.

    Count and first example are partial aggregates, so a question that everybody asks never gathers in one task.
    """
    return rows.groupBy(topic, key).agg(F.count("*").alias("n"), F.min_by(example, order).alias("example"))


def top_per_topic(grouped: DataFrame, topic: str, first: int, last: int) -> DataFrame:
    """Ranks ``first`` to ``last`` of each topic by frequency, ties by example text."""
    order = Window.partitionBy(topic).orderBy(F.desc("n"), "example", "key")
    return grouped.withColumn("rank", F.row_number().over(order)).filter(F.col("rank").between(first, last))


def skipped(text: Column, patterns: tuple[str, ...], least: int = 12, merged: int = 25) -> Column:
    """Rows of a log that are no questions: a skip pattern, an answer merged in after the question mark, or too short."""
    after = F.when(text.contains("?"), F.substring_index(text, "?", -1)).otherwise("")
    return text.rlike("|".join(patterns)) | (F.length(F.trim(after)) > merged) | (F.length(text) < least)


def by_rules(text: Column, rules: tuple[tuple[str, str], ...], default: str) -> Column:
    """Section of the first rule (regex, section) that matches."""
    return F.coalesce(*(F.when(F.lower(text).rlike(p), F.lit(s)) for p, s in rules), F.lit(default))
