"""Work per row that is heavy, on tables that are small: dealt over all cores first."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Most bytes, as estimated by the optimizer, of a table that is dealt anew.
SMALL = 1 << 30


def spread(rows: DataFrame, small: int = SMALL) -> DataFrame:
    """``rows`` over as many partitions as there are cores, if they are a small table; a small file often holds one row
    group, which one task reads alone. Larger tables stay as they are read: by many tasks, without a shuffle."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if cores > 1 and size <= small else rows
