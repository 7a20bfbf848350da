"""The review queue: appended items, one status change each, last write wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERDICTS = ("correct", "needs_correction", "unsafe")


def submit(answers: DataFrame) -> DataFrame:
    """Queue items of the answers that have reasons; the id follows from question and time, so a replay adds nothing."""
    item = answers.filter(F.size("reasons") > 0)
    return item.withColumn("id", F.substring(F.sha2(F.concat_ws("|", "question", F.col("created").cast("string")), 256), 1, 10)).withColumn("status", F.lit("pending")).withColumn("verdict", F.lit(None).cast("string"))


def latest(log: DataFrame, key: str = "id", order: str = "changed") -> DataFrame:
    """The last state of each item of an append-only log: a partial aggregate, no window."""
    rest = [c for c in log.columns if c != key]
    state = F.max_by(F.struct(*rest), order).alias("_s")
    return log.groupBy(key).agg(state).select(key, *(F.col(f"_s.{c}").alias(c) for c in rest))


def reviewed(queue: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``queue`` with verdicts (id, verdict, changed) applied; unknown verdicts are left out."""
    known = verdicts.filter(F.col("verdict").isin(*VERDICTS)).select("id", F.col("verdict").alias("_v"), F.col("changed").alias("_c"))
    last = known.groupBy("id").agg(F.max_by("_v", "_c").alias("_v"))
    joined = queue.join(last, "id", "left")
    return joined.withColumn("status", F.when(F.col("_v").isNotNull(), "reviewed").otherwise(F.col("status"))).withColumn("verdict", F.coalesce("_v", "verdict")).drop("_v")
