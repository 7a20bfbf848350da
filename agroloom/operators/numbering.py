"""Row numbers in a total order without bringing a group, or the table, into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agroloom.sources.shared import written

#: ``monotonically_increasing_id`` holds the partition above this bit and the row below.
ROW_BITS = 33


def number_by_range(rows: DataFrame, order: list[str | Column], by: tuple[str, ...] = (), name: str = "n", count: str | None = None) -> DataFrame:
    """``rows`` with their position (from 0) in ``order`` within each group of ``by``; with ``count``, the group's size too.

    Rows are dealt by ranges of (group, order) and sorted there, written once, and counted by part and group; a part's
    offset is the sum of the counts of the parts before it. Only these counts (one row for each part and group that
    meet) go through a window. Equal rows are split by an arbitrary last key, so no range grows with a tie; which of
    them comes first is arbitrary. Nulls come first; an empty table stays empty.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    keys = [*(F.col(c).asc_nulls_first() for c in by), *order]
    ranged = rows.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*keys, "_tie")
    held = written(ranged.sortWithinPartitions(*keys).drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", ROW_BITS)
    runs = held.groupBy(part.alias("_part"), *by).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_offset")
    total = [F.sum("_rows").over(Window.partitionBy(*by)).alias("_total")] if count else []
    offsets = runs.select(F.col("_part"), *(F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)), offset, *total)
    meets = [held[c].eqNullSafe(offsets[f"_by_{i}"]) for i, c in enumerate(by)]
    joined = held.join(offsets, reduce(lambda a, b: a & b, meets, F.shiftright(held["_at"], ROW_BITS) == offsets["_part"]))
    return joined.select(*(held[c] for c in rows.columns), (F.col("_at") + F.col("_offset")).alias(name), *([F.col("_total").alias(count)] if count else []))
