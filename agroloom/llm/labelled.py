"""Bounded samples of labelled documents, for the operators that learn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agroloom.llm.common import texts


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def known(labels: DataFrame, label: str, parts: int, held_out: int) -> DataFrame:
    """(doc_id, y) of the labelled documents outside the held-out part."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1))
    return rows.filter(remainder(F.col("doc_id"), parts) != held_out).groupBy("doc_id").agg(F.max("y").alias("y"))


def sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, most: int, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, y, h): documents of at most ``most`` labelled ids outside the held-out part, chosen by hash.

    Only those ids, at most ``most`` rows, are broadcast; labels are never read for held-out rows.
    """
    picked = known(labels, label, parts, held_out).withColumn("h", F.xxhash64("doc_id", F.lit(seed))).orderBy("h", "doc_id").limit(most)
    return texts(docs, id_col, text_col).join(F.broadcast(picked), "doc_id")
