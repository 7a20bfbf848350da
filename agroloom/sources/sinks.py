"""Sinks: the searchable index as Parquet tables, caches that only grow, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agroloom.operators import index as I
from agroloom.operators import retrieval as R


def save_index(chunks: DataFrame, path: str) -> I.Index:
    """The chunks and their searchable index (see :mod:`agroloom.operators.index`)."""
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    return I.build(chunks.sparkSession.read.parquet(f"{path}/chunks"), f"{path}/index", "chunk_id")


def load_index(spark: SparkSession, path: str, dim: int = R.DIM) -> tuple[DataFrame, I.Index]:
    """The chunks and the index; an error if there is none, or one whose vectors have another dimension."""
    return spark.read.parquet(f"{path}/chunks"), I.opened(spark, f"{path}/index", dim)


def is_stale(index_chunks: DataFrame, chunks: DataFrame) -> bool:
    """Whether the (id, text) multisets differ: counts and hash sums in one aggregation each."""
    sign = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("chunk_id", "text") % (1 << 40))).first())
    return sign(index_chunks) != sign(chunks)


def grow_cache(texts: DataFrame, embed, path: str, spark: SparkSession) -> DataFrame:
    """Embeds the texts that the cache at ``path`` lacks and appends them; safe to run again after a failure."""
    key = F.sha1(F.concat_ws("|", F.lit("hashed"), F.lit(str(R.DIM)), F.col("text")))
    wanted = texts.select("text").distinct().withColumn("key", key)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        wanted = wanted.join(spark.read.parquet(path).select("key"), "key", "left_anti")
    embed(wanted).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def export_csv(rows: DataFrame, path: str) -> None:
    """CSV with lists joined by "; "."""
    flat = [F.concat_ws("; ", c).alias(c) if kind.startswith("array<string>") else F.col(c) for c, kind in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def response(answers: DataFrame, columns: list[str], from_metadata: list[str]) -> DataFrame:
    """The public record of an answer: named columns and picked fields of its metadata struct."""
    return answers.select(*columns, *(F.col(f"metadata.{c}").alias(c) for c in from_metadata))


def speakable(text: Column, most: int = 600, note: str = "See the screen for the rest."):
    """Text for reading aloud: cleaned, and cut with a note where it is long."""
    from agroloom.functions.text import for_speech

    clean = for_speech(text)
    return F.when(F.length(clean) > most, F.concat(F.substring(clean, 1, most), F.lit(" "), F.lit(note))).otherwise(clean)
