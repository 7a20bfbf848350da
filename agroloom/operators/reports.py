"""Evaluation and review figures as single aggregations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agroloom.operators.numbering import number_by_range
from agroloom.sources.shared import written


def hits(flag: Column) -> Column:
    """h/n (p%), halves to the even per cent, n/a without rows."""
    n, h = F.count(flag), F.count_if(flag)
    return F.when(n == 0, "n/a").otherwise(F.concat(h.cast("string"), F.lit("/"), n.cast("string"), F.lit(" ("), F.bround(h * 100 / n).cast("int").cast("string"), F.lit("%)")))


def nth(values: Column, share: float, kind: str) -> Column:
    """A quantile of sorted values without interpolation: ``floor`` of share * (n - 1), or ``count``: floor(share * n) - 1."""
    ordered, n = F.array_sort(F.collect_list(values)), F.count(values)
    at = F.floor(share * (n - 1)) if kind == "floor" else F.greatest(F.floor(share * n) - 1, F.lit(0))
    return F.try_element_at(ordered, (at + 1).cast("int"))


#: Ranges into which a group's values are counted before one is looked into.
RANGES = 64


def nth_values(rows: DataFrame, group: str, value: str, positions: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(group, a column for each of ``positions``): values at given places (from 0, a function of the number of values) of
    each group's sorted values; null values don't count.

    Selection instead of sorting: approximate cuts split a group into ``RANGES`` ranges of values, which are counted
    exactly; only the range that holds a place is looked into. If all its values are equal, that is the answer; else its
    rows are numbered by ranges of their own, over many tasks. A wrong cut costs time, never a result.
    """
    held = rows.filter(F.col(value).isNotNull()).select(F.col(group).alias("_g"), F.col(value).alias("_v"))
    cuts = held.groupBy("_g").agg(F.percentile_approx("_v", [i / RANGES for i in range(1, RANGES)], 1000).alias("_cuts"), F.count("*").alias("_n"))
    at = cuts.select(F.col("_g").alias("_h"), F.explode(F.array(*(F.struct(F.lit(name).alias("name"), place(F.col("_n")).cast("long").alias("at")) for name, place in positions.items()))).alias("_p")).select("_h", "_p.*")
    placed = held.join(cuts.select(F.col("_g").alias("_h"), "_cuts"), F.col("_g").eqNullSafe(F.col("_h"))).select("_g", "_v", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_r"))
    counts = placed.groupBy("_g", "_r").agg(F.count("*").alias("_m"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    before = Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows a group
    counts = counts.withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0)))
    found = counts.join(at, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_before") <= F.col("at")) & (F.col("at") < F.col("_before") + F.col("_m")))
    found = written(found.select("_g", "_r", "name", (F.col("at") - F.col("_before")).alias("_k"), "_low", "_high"), "places")
    mixed = found.filter("_low < _high")
    open_ranges = mixed.select(F.col("_g").alias("_h"), F.col("_r").alias("_s")).distinct()
    inside = placed.join(open_ranges, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_r") == F.col("_s")), "left_semi")
    numbered = number_by_range(inside, ["_v"], ("_g", "_r"), "_i").select(F.col("_g").alias("_h"), F.col("_r").alias("_s"), "_v", "_i")
    answers = mixed.join(numbered, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_r") == F.col("_s")) & (F.col("_k") == F.col("_i"))).select("_g", "name", "_v")
    answers = answers.unionByName(found.filter("_low >= _high").select("_g", "name", F.col("_low").alias("_v")))
    return answers.groupBy(F.col("_g").alias(group)).agg(*(F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in positions))


def place_of(share: float, kind: str) -> Callable[[Column], Column]:
    """Place of a quantile: ``floor`` of share * (n - 1), or ``count``: floor(share * n) - 1, at least 0."""
    return (lambda n: F.floor(share * (n - 1))) if kind == "floor" else (lambda n: F.greatest(F.floor(share * n) - 1, F.lit(0)))


def exact_quantile(rows: DataFrame, group: str, value: str, share: float, kind: str) -> DataFrame:
    """(group, value) of :func:`nth` by selection."""
    return nth_values(rows, group, value, {value: place_of(share, kind)})


def review_stats(queue: DataFrame) -> DataFrame:
    """One row: total, pending, reviewed and the count of each verdict."""
    verdict = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    return queue.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "reviewed").alias("reviewed"), verdict("correct"), verdict("needs_correction"), verdict("unsafe"))


def content_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(side, id, text): rows of either table that the other lacks, as multisets; empty if an index is up to date."""
    return old.exceptAll(new).withColumn("side", F.lit("removed")).unionByName(new.exceptAll(old).withColumn("side", F.lit("added")))
