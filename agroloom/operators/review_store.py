"""The review queue as a table that is written in place of a file that is rewritten: upserts, compaction, newest first.

Rows lie in segments, each split into buckets by id. A manifest says which segments hold rows of which bucket; an upsert
adds a segment and names it in a new version of the manifest, which is renamed into place. Whatever was written before a
crash but isn't named is never read; what is named is whole. Compaction rewrites only buckets that many segments touch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agroloom.operators.review import latest
from agroloom.sources.shared import commit_version, latest_version

#: Buckets of a store, and segments of a bucket that call for compaction.
BUCKETS, MANY = 64, 4


class ReviewStore:
    """Rows (id, ``order``, further columns) of which the one with the largest ``order`` counts, by id."""

    def __init__(self, spark: SparkSession, path: str, schema: str, order: str = "changed"):
        self.spark, self.path, self.schema, self.order = spark, path, schema, order

    def state(self) -> dict:
        return latest_version(self.spark, self.path) or {"version": 0, "buckets": {}}

    def write(self, rows: DataFrame) -> tuple[str, list[str]]:
        """Writes a segment; its name and the buckets it has rows of. Nothing reads it yet."""
        name = f"segment-{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int")
        rows.select(*self.spark.createDataFrame([], self.schema).columns, bucket.alias("bucket")).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        held = self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.path}/{name}")
        return name, [str(r[0]) for r in held.select("bucket").distinct().collect()]  # BUCKETS rows at most

    def upsert(self, rows: DataFrame) -> None:
        """Adds rows and replaces those with an id that is there; the same rows again change nothing."""
        state = self.state()
        name, touched = self.write(rows)
        buckets = state["buckets"] | {b: [*state["buckets"].get(b, []), name] for b in touched}
        commit_version(self.spark, self.path, {"version": state["version"] + 1, "buckets": buckets})

    def rows_of(self, buckets: dict[str, list[str]]) -> DataFrame:
        """The current row of each id of these buckets."""
        paths = [f"{self.path}/{s}/bucket={b}" for b, segments in buckets.items() for s in segments]
        return latest(self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema), "id", self.order)

    def rows(self) -> DataFrame:
        return self.rows_of(self.state()["buckets"])

    def items(self, status: str | None = None) -> DataFrame:
        """Items newest first, of one status or all; ties by id."""
        held = self.rows()
        return (held if status is None else held.filter(F.col("status") == status)).orderBy(F.desc("created"), "id")

    def compact(self, many: int = MANY) -> int:
        """Rewrites the buckets that ``many`` segments or more touch, each into one; how many these are."""
        state = self.state()
        busy = {b: s for b, s in state["buckets"].items() if len(s) >= many}
        if busy:
            name, _ = self.write(self.rows_of(busy))
            commit_version(self.spark, self.path, {"version": state["version"] + 1, "buckets": state["buckets"] | {b: [name] for b in busy}})
        return len(busy)
