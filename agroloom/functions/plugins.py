"""Extension points: what needs a model or a service is a pandas UDF that callers may replace; the defaults run offline."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from agroloom.functions.text import sentences

Embed = Callable[[Sequence[str]], np.ndarray]


def embedder(embed: Embed) -> Callable[[Column], Column]:
    """A column function from a batch embedder (texts to a float matrix); vectors are normalised."""

    @F.pandas_udf("array<float>")
    def udf(text: pd.Series) -> pd.Series:
        m = np.asarray(embed(text.fillna("").tolist()), dtype=np.float32)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return pd.Series(list(np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)))

    return udf


def with_fallback(providers: Sequence[Callable[[Column], Column]], text: Column) -> Column:
    """The first provider's answer that isn't null."""
    return F.coalesce(*(p(text) for p in providers))


def template_answer(text: Column) -> Column:
    """Offline answer writer: the first sentences of the evidence, marked as a template by its source."""
    return F.struct(F.array_join(F.slice(sentences(text), 1, 3), " ").alias("answer"), F.lit("template").alias("answer_source"))


def replace_unbacked(draft: Column, unbacked: Column, template: Column) -> Column:
    """The template where a draft states numbers that its sources don't."""
    return F.when(F.size(unbacked) > 0, template).otherwise(draft)


@dataclass(frozen=True)
class Plugins:
    """Collaborators of an answering pipeline; null verifiers leave claims unchecked."""

    embed: Callable[[Column], Column] | None = None
    answer: Callable[[Column], Column] = template_answer
    verify: Callable[[Column, Column], Column] | None = None
    transcribe: Callable[[Column], Column] | None = None
    diagnose: Callable[[Column], Column] | None = None
