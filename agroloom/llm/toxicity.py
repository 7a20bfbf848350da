"""Toxicity by weak supervision.

1. Voters. Lexicon voters are a short fixed list and words mined from a bounded sample of labelled documents; pattern
   voters are mined word beginnings, and shouting. A voter fires or abstains; when no lexicon or pattern voter fires,
   one more voter says clean.
2. A generative label model: each voter fires at a rate of its own given the hidden label, and else abstains. The rates
   (the voters' accuracies) are estimated by expectation maximisation over the sample's votes; it sees no labels and
   starts from whether any voter for label 1 fires. In each round the correlation of every two voters, beyond what their
   rates explain, is estimated as well; a vote's evidence is divided by one plus its positive correlations with the
   other votes on that text.
3. The posterior labels of the sample train a linear classifier (MLlib logistic regression), which scores every text
   in one map-only scan.

Bounds: ``SAMPLE`` labelled documents, ``VOTERS`` mined voters. All else covers whole texts of all documents.

Edge cases: null text counts as empty and is scored like any text; without labelled rows of both kinds, only the fixed
lexicon votes, with fixed rates; rows that repeat a doc_id are scored one by one; an empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agroloom.llm.common import texts, utf8
from agroloom.llm.labelled import sample

#: Labelled documents that are read at most, mined voters, and the least precision and support of one.
SAMPLE, VOTERS, PRECISION, SUPPORT = 12_000, 192, 0.75, 4
ROUNDS = 20
#: Lengths of the word beginnings that are tried as patterns.
STEMS = (4, 5, 6, 7, 8)

#: Insults that vote without any labels.
INSULTS = frozenset(w.encode() for w in "idiot idiots moron morons stupid dumb loser losers scum trash garbage clown pathetic worthless disgusting vermin filth bastard bastards jerk imbecile".split())

#: Bytes of a text to lower-case words: letters and all of UTF-8's upper half stay, all else separates.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


class Votes:
    """Which voters fire on a text."""

    def __init__(self, words: list[bytes], stems: list[bytes]):
        self.names = [*sorted(INSULTS), *(w for w in words if w not in INSULTS)]
        self.words = {w: i for i, w in enumerate(self.names)}
        self.stems = {s: len(self.names) + i for i, s in enumerate(stems)}
        self.names += [s + b"*" for s in stems]
        self.shout = len(self.names)
        self.clean = self.shout + 1
        self.n = self.clean + 1
        self.keys = frozenset(self.words)
        self.sizes = tuple(sorted({len(s) for s in self.stems}))

    def fired(self, text: bytes) -> dict[int, int]:
        """Voter: how often it fires."""
        words = words_of(text)
        distinct = set(words)
        out = {self.words[w]: words.count(w) for w in self.keys & distinct}
        if self.stems:
            for k in self.sizes:
                for s in {w[:k] for w in distinct if len(w) >= k} & self.stems.keys():
                    out[self.stems[s]] = sum(w.startswith(s) for w in words)
        if not out:
            out[self.clean] = 1
        capitals = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        if capitals * 2 > len(text) > 20:
            out[self.shout] = 1
        return out

    def features(self, text: bytes) -> list[tuple[int, float]]:
        """(index, value), sparse and sorted, of the linear classifier: presence of each voter, and two totals."""
        fired = self.fired(text)
        hits = sum(n for v, n in fired.items() if v < self.shout)
        kinds = sum(v < self.shout for v in fired)
        return [*((v, 1.0) for v in sorted(fired)), (self.n, float(np.log1p(hits))), (self.n + 1, float(kinds))]


def mine(rows: DataFrame, voters: int = VOTERS) -> Votes:
    """Voters from labelled (text, y) rows: words and word beginnings that occur almost only under label 1."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for b in batches:
            for text, y in zip(utf8(b.column(0)), b.column(1).to_pylist(), strict=True):
                distinct = set(words_of(text))
                counts[y].update(distinct)
                for k in STEMS:
                    counts[y].update({w[:k] + b"*" for w in distinct if len(w) >= k})
        keys = [k for k, n in counts[1].items()]
        out = [*((k, counts[1][k], counts[0][k]) for k in keys), *((k, 0, n) for k, n in counts[0].items() if k not in counts[1])]
        for at in range(0, len(out), 50_000):
            part = out[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.binary()), pa.array([p[1] for p in part], pa.int64()), pa.array([p[2] for p in part], pa.int64())], ["key", "pos", "neg"])

    counts = rows.select("text", "y").coalesce(8).mapInArrow(counted, "key binary, pos long, neg long")
    counts = counts.groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    good = counts.filter((F.col("pos") >= SUPPORT) & (F.col("pos") >= PRECISION * (F.col("pos") + F.col("neg") + 1)))
    top = [bytes(r.key) for r in good.orderBy(F.desc("pos"), "neg", "key").limit(voters).collect()]
    return Votes([k for k in top if not k.endswith(b"*")], [k[:-1] for k in top if k.endswith(b"*")])


def label_model(fired: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Posterior probability of label 1 for each row of a 0/1 vote matrix; ``toxic`` marks the voters that say 1."""
    posterior = np.where(fired[:, toxic].any(axis=1), 0.9, 0.02)
    for _ in range(ROUNDS):
        prior = np.clip(posterior.mean(), 0.01, 0.99)
        one = (posterior @ fired + 0.5) / (posterior.sum() + 1)
        zero = ((1 - posterior) @ fired + 0.5 * prior) / ((1 - posterior).sum() + 1)
        alone = fired / (1 + fired @ correlations(fired, posterior, one, zero))
        odds = np.log(prior / (1 - prior)) + alone @ np.log(np.clip(one, 1e-4, 1 - 1e-4) / np.clip(zero, 1e-4, 1 - 1e-4))
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return posterior


def correlations(fired: np.ndarray, posterior: np.ndarray, one: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """Positive correlations of every two voters given the hidden label; 0 on the diagonal."""
    residual = fired - (posterior[:, None] * one + (1 - posterior)[:, None] * zero)
    scale = np.sqrt((residual**2).mean(axis=0)) + 1e-9
    out = np.maximum((residual.T @ residual) / len(fired) / np.outer(scale, scale), 0)
    np.fill_diagonal(out, 0)
    return out


class Scorer:
    """Voters and the weights of the linear classifier."""

    def __init__(self, votes: Votes, weights: np.ndarray, bias: float):
        self.votes, self.weights, self.bias = votes, [float(w) for w in weights], float(bias)

    def score(self, text: bytes) -> float:
        z = self.bias + sum(self.weights[i] * x for i, x in self.votes.features(text))
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def fit(docs: DataFrame, labels: DataFrame, parts: int = 4, held_out: int = 2, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """Voters, label model and classifier, from labels outside the held-out part."""
    spark = docs.sparkSession
    rows = sample(docs, labels, "toxic", parts, held_out, most, id_col=id_col, text_col=text_col).cache()
    try:
        votes = mine(rows)

        def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = [votes.features(t) for t in utf8(b.column(0))]
                yield pa.RecordBatch.from_arrays(
                    [b.column(1), pa.array([[i for i, _ in f] for f in x], pa.list_(pa.int32())), pa.array([[v for _, v in f] for f in x], pa.list_(pa.float64()))], ["y", "at", "x"]
                )

        held = rows.orderBy("h").select("text", "y").mapInArrow(voted, "y int, at array<int>, x array<double>").collect()
    finally:
        rows.unpersist()
    size = votes.n + 2
    y = np.array([r.y for r in held])
    if len(set(y.tolist())) < 2:
        weights = np.zeros(size)
        weights[: votes.shout] = 3.0
        return Scorer(votes, weights, -2.5)
    fired = np.zeros((len(held), votes.n))
    for k, r in enumerate(held):
        fired[k, [i for i in r["at"] if i < votes.n]] = 1
    posterior = label_model(fired, np.arange(votes.n) < votes.shout)
    # both labels of a row, weighted by the posterior
    train = [(float(c), float(p if c else 1 - p), Vectors.sparse(size, list(r["at"]), list(r["x"]))) for r, p in zip(held, posterior, strict=True) for c in (0, 1)]
    frame = spark.createDataFrame(train, ["label", "weight", "features"]).coalesce(1)
    model = LogisticRegression(weightCol="weight", regParam=0.002, maxIter=60).fit(frame)
    return Scorer(votes, model.coefficients.toArray(), model.intercept)


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([scorer.score(t) for t in utf8(b.column(1))], pa.float64())], ["doc_id", "score"])

    return texts(docs, id_col, text_col).mapInArrow(scored, "doc_id long, score double")


def keep_clean(docs: DataFrame, scorer: Scorer, below: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` without the texts that score ``below`` or more; all columns as they were."""

    @F.pandas_udf("boolean")
    def clean(text):
        return text.map(lambda t: scorer.score((t or "").encode()) < below).astype(bool)

    return docs.filter(clean(F.col(text_col)))
