"""Batch jobs that run any user model over a column: encoding texts, scoring pairs.

A model is given as a factory without arguments, called once per Python worker; what it returns is
called with a list of at most ``batch_size`` values.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.functions.vector import NORM_FLOOR
from reelgrid.operators.rerank import passage

Encoder = Callable[[Sequence[str]], np.ndarray]
Scorer = Callable[[Sequence[tuple[str, str]]], Sequence[float]]

ALPHABET = 26


def letter_profile() -> Encoder:
    """Example encoder without weights: how often each letter a-z occurs."""

    def encode(texts: Sequence[str]) -> np.ndarray:
        counts = [
            np.bincount(np.frombuffer(t.lower().encode(), np.uint8), minlength=256)[97 : 97 + ALPHABET]
            for t in texts
        ]
        return np.asarray(counts, dtype=np.float64)

    return encode


def token_overlap() -> Scorer:
    """Example scorer without weights: share of the query's distinct words found in the passage."""
    dropped = re.compile(r"[^\w\s]")

    def words(text: str) -> set[str]:
        return set(dropped.sub("", text.lower().strip()).split())

    def score(pairs: Sequence[tuple[str, str]]) -> list[float]:
        out = []
        for query, text in pairs:
            wanted = words(query)
            out.append(len(wanted & words(text)) / len(wanted) if wanted else 0.0)
        return out

    return score


def _encode(make: Callable[[], Encoder], dim: int, batch_size: int) -> Callable[[Column], Column]:
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make()
        for texts in batches:
            values = texts.fillna("").tolist()
            out = np.zeros((len(values), dim))
            wanted = [i for i, v in enumerate(values) if v.strip()]
            for at in range(0, len(wanted), batch_size):
                rows = wanted[at : at + batch_size]
                try:
                    out[rows] = encoder([values[i] for i in rows])
                except Exception:  # a batch the model cannot encode keeps its zero vectors
                    continue
            out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), NORM_FLOOR)
            yield pd.Series(list(out.astype(np.float32)), index=texts.index)

    return run


def encode_column(
    df: DataFrame,
    col: str,
    encoder: Callable[[], Encoder],
    dim: int,
    batch_size: int = 128,
    out: str = "embedding",
    flag: str | None = None,
) -> DataFrame:
    """Unit-length vectors of a text column; blank texts and failed batches give zero vectors.

    ``flag`` names a column that tells which rows have a vector, so that failed batches can be counted.
    """
    encoded = df.withColumn(out, _encode(encoder, dim, batch_size)(F.col(col)))
    return encoded if flag is None else encoded.withColumn(flag, F.exists(out, lambda x: x != 0))


def score_pairs(
    df: DataFrame, scorer: Callable[[], Scorer], batch_size: int = 32, query: str = "query", out: str = "logit"
) -> DataFrame:
    """Raw score of each row's query and passage; the passage is the text, or the id when it is empty."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = scorer()
        for queries, passages in batches:
            pairs = list(zip(queries.tolist(), passages.tolist()))
            scores: list[float] = []
            for at in range(0, len(pairs), batch_size):
                scores.extend(float(s) for s in score(pairs[at : at + batch_size]))
            yield pd.Series(scores, index=queries.index, dtype="float64")

    return df.withColumn(out, run(F.col(query), passage(df)))
