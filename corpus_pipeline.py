"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of ``documents``.

Edge cases, the same in every stage: a null text counts as empty (the first four stages return it as null); empty and
very long texts are handled whole; rows that repeat a doc_id are judged one by one, except that they pool their
near-duplicate links; an empty table gives an empty result; further columns, whatever their names, are passed on by the
first four stages and left out by the last. How ties are broken is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agroloom.llm import exact_dedup, jaccard_join, packing, pii, toxicity
from agroloom.llm.common import documents, written
from agroloom.llm.tokenization import public_path

#: Words of a shingle, and least similarity, of near copies.
NEAR_WORDS, NEAR_LEAST = 5, (80, 100)

#: SQL can express neither a learned stage nor packing: the rows are tested against a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3; a score of just 0.3 is rejected. Without labels of both kinds in
    ``labels`` a fixed lexicon decides."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the largest doc_id, a null one only if it is alone; of rows that
    repeat that doc_id with an equal text, one. Null and empty texts are equal."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each component of near-duplicate links. Texts without words and rows
    without a doc_id are linked with nothing and stay."""
    return jaccard_join.keep_one_of_each(docs, words=NEAR_WORDS, least=NEAR_LEAST)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars, where there is one, follows the text. Of overlapping spans the first
    one names the replacement, of those with one start the longest."""
    out = pii.redact(docs, pii.fit(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their ids; an empty text has its end id. Documents of equal length are packed in
    the order of the scan."""
    return packing.pack(docs, public_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("pii", redact_pii),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
