"""Exact deduplication by a heavy-hitter split.

Texts are equal when identical after lower-casing A-Z; a SHA-256 digest of the normalised text stands for it.

1. One scan of the texts writes the digest table (doc_id, digest, row), about 1 % of the corpus.
2. Every task runs Misra-Gries over its digests with ``counters`` counters; the summaries are added up by digest.
   Every digest with more than n / (counters + 1) rows is among the candidates.
3. The candidates are counted exactly; the verified ones, at most ``counters`` rows, are broadcast, and their rows
   get their winner map-side. A group of any size never meets in one task.
4. All other digests (groups of at most n / (counters + 1) rows) take an ordinary shuffle and a window.

Edge cases: null text counts as empty, and empty texts are equal to one another. A null doc_id ranks below every
number. Of repeated rows with one doc_id and one text exactly one stays. An empty table gives an empty result.
Columns other than the two named are never read, so clashing names don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agroloom.llm.common import texts, unused, utf8, written

#: Counters of a Misra-Gries summary, and the most rows that are ever broadcast.
COUNTERS = 1024


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest binary, row long): the digest of every normalised text, and a number that tells rows apart."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # bytes.lower() changes A-Z alone
            out = pa.array([hashlib.sha256(t.lower()).digest() for t in utf8(b.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), out, b.column(2)], ["doc_id", "digest", "row"])

    rows = texts(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(digest, "doc_id long, digest binary, row long")


def misra_gries(keys: DataFrame, column: str, counters: int = COUNTERS) -> DataFrame:
    """(key, estimate) of at most ``counters`` keys, and one row (null, n): lower bounds of the counts of frequent keys.

    Each task keeps ``counters`` counters; a key with more than n / (counters + 1) rows keeps a positive sum.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        n = 0
        for b in batches:
            n += b.num_rows
            for c in b.column(0).value_counts().to_pylist():
                held[c["values"]] = held.get(c["values"], 0) + c["counts"]
            if len(held) > counters:
                cut = sorted(held.values(), reverse=True)[counters]
                held = {k: v - cut for k, v in held.items() if v > cut}
        yield pa.RecordBatch.from_arrays([pa.array([*held, None], pa.binary()), pa.array([*held.values(), n], pa.int64())], ["key", "estimate"])

    parts = keys.select(F.col(column).alias("key")).mapInArrow(summarise, "key binary, estimate long")
    return parts.groupBy("key").agg(F.sum("estimate").alias("estimate"))


def heavy_hitters(keys: DataFrame, column: str, counters: int = COUNTERS) -> DataFrame:
    """(key): at most ``counters`` keys, every one with more than n / (counters + 1) rows among them."""
    summary = misra_gries(keys, column, counters)
    return summary.filter("key IS NOT NULL").orderBy(F.desc("estimate"), "key").limit(counters).select("key")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (binary digest), row."""
    table = written(digests(docs, id_col, text_col), "digests")
    total = table.agg(F.count("*").alias("n"))
    candidates = F.broadcast(heavy_hitters(table, "digest", counters))
    counted = (
        table.join(candidates, table.digest == candidates.key)
        .groupBy("digest")
        .agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size"))
    )
    winners = (
        counted.crossJoin(F.broadcast(total))  # one row
        .filter(F.col("group_size") * (counters + 1) > F.col("n"))
        .select(F.col("digest").alias("key"), "keep", "group_size")
    )
    winners = written(winners.coalesce(1), "heavy")  # at most ``counters`` rows: used twice
    split = table.join(F.broadcast(winners), table.digest == winners.key, "left")
    heavy = split.filter("key IS NOT NULL").select("doc_id", "row", "digest", "keep", "group_size")
    same = Window.partitionBy("digest")
    light = (
        split.filter("key IS NULL")
        .select("doc_id", "row", "digest")
        .withColumn("keep", F.max(F.struct("doc_id", "row")).over(same))
        .withColumn("group_size", F.count("*").over(same))
    )
    return heavy.unionByName(light).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
        "row",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were.

    The rows that go are few and small (doc_id, copies), so the kept texts are joined against those alone. Rows that
    repeat both doc_id and text are reduced to one.
    """
    groups = exact_groups(docs, id_col, text_col, counters)
    gone_id, gone_stay, digest, stay_id, stay_digest = (unused(n, docs.columns) for n in ("gone_id", "gone_stay", "digest", "stay_id", "stay_digest"))
    gone = groups.groupBy("doc_id").agg(F.count_if("kept").alias("stay"), F.count("*").alias("rows")).filter("stay < rows")
    gone = gone.select(F.col("doc_id").alias(gone_id), F.col("stay").alias(gone_stay))
    joined = docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone[gone_id]), "left")
    clear = joined.filter(gone[gone_stay].isNull()).select(*(docs[c] for c in docs.columns))
    # a doc_id that several rows share, some of them kept: choose among its rows by digest
    mixed = joined.filter(gone[gone_stay] > 0).select(*(docs[c] for c in docs.columns))
    norm = F.translate(F.coalesce(mixed[text_col], F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    mixed = mixed.withColumn(digest, F.unhex(F.sha2(norm, 256)))
    stay = groups.filter("kept").select(F.col("doc_id").alias(stay_id), F.col("text_sha256").alias(stay_digest))
    mixed = mixed.join(stay, mixed[id_col].cast("long").eqNullSafe(stay[stay_id]) & (mixed[digest] == stay[stay_digest]), "left_semi")
    mixed = mixed.dropDuplicates([id_col, digest]).drop(digest)
    return clear.unionByName(mixed)
