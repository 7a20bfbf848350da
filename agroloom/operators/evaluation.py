"""Evaluation of answers against labelled cases: checks, outcomes, counts, costs and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agroloom.functions.numbers import LIST_NUMBER, numbers_in
from agroloom.functions.text import in_script
from agroloom.operators.reports import hits


def mentions(text: Column, words: Column) -> Column:
    """Those of ``words`` that occur anywhere, case aside."""
    return F.filter(words, lambda w: F.contains(F.lower(text), F.lower(w)))


def problems(answer: dict[str, Column], expect: dict[str, Column]) -> Column:
    """Names of the failed checks of one answer. An expectation that is null, or absent, checks nothing.

    ``answer``: intent, section, shown (answer and notes), text, district, eligibility, n_sources. ``expect``: intents,
    section, any, all, none, lang, district, no_advisory, eligibility.
    """
    tests = (
        ("intent", "intents", lambda e: ~F.array_contains(e, answer["intent"])),
        ("section", "section", lambda e: ~F.contains(F.lower(F.coalesce(answer["section"], F.lit(""))), F.lower(e))),
        ("answer_any", "any", lambda e: F.size(mentions(answer["shown"], e)) == 0),
        ("answer_all", "all", lambda e: F.size(mentions(answer["shown"], e)) < F.size(e)),
        ("answer_none", "none", lambda e: F.size(mentions(answer["shown"], e)) > 0),
        ("script", "lang", lambda e: ~in_script(answer["text"], e)),
        ("district", "district", lambda e: F.lower(F.coalesce(answer["district"], F.lit(""))) != F.lower(e)),
        ("no_advisory", "no_advisory", lambda e: e & (answer["n_sources"] > 0)),
        ("eligibility", "eligibility", lambda e: ~answer["eligibility"].eqNullSafe(e)),
    )
    failed = [F.when(expect[key].isNotNull() & test(expect[key]), F.lit(name)) for name, key, test in tests if key in expect]
    return F.filter(F.array(*failed), lambda x: x.isNotNull())


def cases(turns: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, n_turns, n_failed, passed): a case passes only if all its turns do (column ``ok``)."""
    return turns.groupBy(case).agg(F.count("*").alias("n_turns"), F.count_if(~F.col("ok")).alias("n_failed"), F.bool_and("ok").alias("passed"))


def outside_outcome(n_sources: Column, intent: Column, from_chapter: Column, top_crop: Column, crop: Column, detected: Column) -> Column:
    """For a question that the advisories don't cover: referred, right_chapter, wrong_chapter or unrelated. A pesticide
    question is about the crop it names, if any."""
    wanted = F.lower(F.when(crop == "pesticide", F.coalesce(detected, F.lit("all crops"))).otherwise(crop))
    top = F.lower(F.coalesce(top_crop, F.lit("")))
    right = top.startswith(wanted) | top.startswith("all crops")
    return F.when((n_sources == 0) | intent.isin("crop_not_covered", "out_of_scope"), "referred").when(from_chapter & right, "right_chapter").when(from_chapter, "wrong_chapter").otherwise("unrelated")


def stored(answer: Column, from_chapter: Column, citation: Column) -> Column:
    """An answer as results keep it: of a chapter's text only the reference."""
    return F.when(from_chapter & citation.isNotNull(), F.concat(F.lit("[answered from "), citation, F.lit("]"))).otherwise(answer)


def hit_at(sections: Column, wanted: Column, k: int, case_sensitive: bool = False) -> Column:
    """Whether one of the first k sections holds the wanted name."""
    fold = (lambda c: c) if case_sensitive else F.lower
    return F.exists(F.slice(sections, 1, k), lambda s: F.contains(fold(s), fold(wanted)))


def figures(rows: DataFrame, by: str, flags: list[str]) -> DataFrame:
    """Hits of each flag by group, as h/n (p%); a null flag isn't counted."""
    return rows.groupBy(by).agg(*(hits(F.when(F.col(f).isNotNull(), F.col(f))).alias(f) for f in flags))


def common_values(rows: DataFrame, by: str, value: str, most: int = 3) -> DataFrame:
    """(by, values): the most frequent values of each group, ties by value, joined; rows without a value don't count."""
    n = rows.filter(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(by, value).agg(F.count("*").alias("n"))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v")))), 1, most)
    return n.groupBy(by).agg(F.array_join(F.transform(top, lambda x: x["v"]), ", ").alias("values"))


def unclear_labels(labels: DataFrame, sections: DataFrame) -> DataFrame:
    """(label, n): labels that don't match exactly one section title (a part of it, case aside). Labels are the fixed list
    of a test set; sections that match none are pruned by the join."""
    pairs = labels.join(sections, F.contains(F.lower(sections["title"]), F.lower(labels["label"])), "left")
    return pairs.groupBy("label").agg(F.count("title").alias("n")).filter("n <> 1")


def token_cost(prompt: Column, answer: Column, per_million_in: float, per_million_out: float, rate: float) -> Column:
    """Cost of one call in the local currency."""
    return (prompt * per_million_in + answer * per_million_out) / 1_000_000 * rate


def plain_numbers(text: Column) -> Column:
    """Numbers of an answer for evaluation: no units, no words, list numbering off."""
    return numbers_in(F.regexp_replace(text, LIST_NUMBER, ""), words=False)


def keeps_numbers(source: Column, translated: Column) -> Column:
    """Whether a translation states every number of its source."""
    return F.size(F.array_except(numbers_in(source, words=False), numbers_in(translated, words=False))) == 0


def report(rows: DataFrame, title: str) -> str:
    """A small aggregate as a Markdown table; for the handful of rows that a report has."""
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.collect()]) + "\n"
