"""Quality by compression.

Two zstandard dictionaries are built from labelled texts, one from good and one from bad ones. A text like those of a
dictionary compresses better with it; the difference of the two compressed sizes over the size of the text, calibrated
on labelled texts that no dictionary has seen, is the score.

Bounds: ``SAMPLE`` labelled documents are read to fit, none left out for its size; half of them make the dictionaries,
half the calibration. Of a text longer than ``SLICE`` bytes a dictionary sees ``SLICE`` bytes from a place drawn by the
hash of its id, so the driver holds at most ``SAMPLE * SLICE`` bytes (98 MB); the calibration measures whole texts, in
the tasks that hold them. Scoring is one map-only scan over whole texts.

Edge cases: null text counts as empty; an empty text has difference 0 and gets the calibrated score of that; without
labelled rows of both kinds every score is the share of label 1 (0.5 without any labels); rows that repeat a doc_id
are scored one by one; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agroloom.llm.common import discard, texts, utf8, written
from agroloom.llm.labelled import known, sample

SAMPLE, SLICE = 6000, 16_384
DICTIONARY_BYTES, LEVEL = 112_640, 3


def dictionary(of: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary of sample texts; of too few texts, their own bytes."""
    of = [t for t in of if t]
    try:
        if sum(map(len, of)) > 4 * size and len(of) > 8:
            return zstandard.train_dictionary(size, of).as_bytes()
    except zstandard.ZstdError:
        pass
    return b"\n".join(of)[-size:]


@functools.lru_cache(maxsize=8)
def compressor(of: bytes) -> zstandard.ZstdCompressor | None:
    if not of:
        return zstandard.ZstdCompressor(level=LEVEL)
    held = zstandard.ZstdCompressionDict(of)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)


class Scorer:
    """Two dictionaries and the calibration of the difference of compressed sizes."""

    def __init__(self, good: bytes, bad: bytes, weights: list[float], bias: float):
        self.good, self.bad, self.weights, self.bias = good, bad, weights, bias

    def difference(self, text: bytes) -> list[float]:
        """Compressed size with the bad texts' dictionary less that with the good ones', over the size; and damped by size."""
        if not text:
            return [0.0, 0.0]
        d = (len(compressor(self.bad).compress(text)) - len(compressor(self.good).compress(text))) / len(text)
        return [d, d * float(np.log1p(len(text)))]

    def score(self, text: bytes) -> float:
        z = self.bias + sum(w * x for w, x in zip(self.weights, self.difference(text) if any(self.weights) else (0.0, 0.0), strict=True))
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def fit(docs: DataFrame, labels: DataFrame, parts: int = 3, held_out: int = 1, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """Dictionaries and calibration, from labels outside the held-out part."""
    spark = docs.sparkSession
    rows = written(sample(docs, labels, "quality", parts, held_out, most, seed=2, id_col=id_col, text_col=text_col), "quality-sample")
    turn = F.row_number().over(Window.partitionBy("y").orderBy("h", "doc_id")) % 2  # of at most ``most`` rows without their texts
    halves = rows.select("doc_id", "y", "h").distinct().withColumn("half", turn).select("doc_id", "half")
    bytes_of = F.encode("text", "UTF-8")
    from_byte = F.pmod("h", F.greatest(F.octet_length("text") - SLICE + 1, F.lit(1)))
    cut = F.substring(bytes_of, (from_byte + 1).cast("int"), F.lit(SLICE))
    dealt = rows.join(F.broadcast(halves), "doc_id")
    seen = dealt.filter("half = 1").select("y", "h", "doc_id", cut.alias("t")).collect()
    by = {y: [bytes(r.t) for r in sorted(seen, key=lambda r: (r.h, r.doc_id, bytes(r.t))) if r.y == y] for y in (0, 1)}
    counts = {r.y: r.n for r in halves.join(rows.select("doc_id", "y").distinct(), "doc_id").groupBy("y").agg(F.count("*").alias("n")).collect()}
    if min(counts.get(y, 0) for y in (0, 1)) < 4:
        share = known(labels, "quality", parts, held_out).agg(F.avg("y").alias("p")).first().p
        p = min(max(0.5 if share is None else share, 0.001), 0.999)
        return Scorer(b"", b"", [0.0, 0.0], float(np.log(p / (1 - p))))
    scorer = Scorer(dictionary(by[1]), dictionary(by[0]), [0.0, 0.0], 0.0)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            differences = [scorer.difference(t) for t in utf8(b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(differences, pa.list_(pa.float64()))], ["y", "h", "doc_id", "d"])

    unseen = dealt.filter("half = 0").select("y", "h", "doc_id", "text").mapInArrow(measured, "y int, h long, doc_id long, d array<double>").collect()
    unseen = sorted(unseen, key=lambda r: (r.y, r.h, r.doc_id, r.d))
    frame = spark.createDataFrame([(float(r.y), Vectors.dense(r.d)) for r in unseen], ["label", "features"]).coalesce(1)
    model = LogisticRegression(regParam=1e-4, maxIter=100).fit(frame)
    discard(rows)
    return Scorer(scorer.good, scorer.bad, [float(w) for w in model.coefficients.toArray()], float(model.intercept))


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([scorer.score(t) for t in utf8(b.column(1))], pa.float64())], ["doc_id", "score"])

    return texts(docs, id_col, text_col).mapInArrow(scored, "doc_id long, score double")
