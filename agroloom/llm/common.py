"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agroloom.sources.shared import at_path, discard, shared_dir, written

__all__ = ["at_path", "discard", "documents", "shared_dir", "texts", "unused", "utf8", "written"]


def unused(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores in front as make it differ from all ``columns`` (case aside)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), null text as empty: all that the operators on texts read from a table."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def utf8(column: pa.Array) -> list[bytes]:
    """An Arrow string column as a list of UTF-8 bytes; null as empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    elif pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    return [x or b"" for x in column.to_pylist()]
