"""Similarity of vectors, as expressions over array columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, FloatType


class EmbeddingModel(Protocol):
    """What a text embedder offers; load and unload are called once per task."""

    dimension: int

    def load(self) -> None: ...
    def embed(self, texts: list[str]) -> list[Sequence[float]]: ...
    def unload(self) -> None: ...


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(_dot(v, v))


def _squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double")), F.lit(0.0), lambda s, x: s + x)


def score(v: Column, w: Column, metric: str = "cosine") -> Column:
    """Higher is nearer; null without a vector. Vectors of different lengths are an error."""
    if metric == "cosine":
        n = norm(v) * norm(w)
        out = F.when(n > 0, _dot(v, w) / n).otherwise(0.0)
    elif metric == "dot_product":
        out = _dot(v, w)
    elif metric == "euclidean":
        out = -F.sqrt(_squared(v, w))
    elif metric == "poincare":
        inside = (1 - _dot(v, v)) * (1 - _dot(w, w))
        out = -F.acosh(1 + 2 * _squared(v, w) / inside)
    else:
        raise ValueError(f"unknown metric {metric}")
    fits = F.size(v) == F.size(w)
    wrong = F.raise_error(F.lit("vectors of different lengths")).cast("double")
    return F.when(v.isNull() | w.isNull(), None).when(fits, out).otherwise(wrong)


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def search(df: DataFrame, column: str, query: Sequence[float], k: int, metric: str = "cosine", ties: str = "id") -> DataFrame:
    """The k rows nearest the query with their score: a top-k that each task reduces before anything is sent."""
    return df.withColumn("score", score(F.col(column), literal(query), metric)).where("score is not null").orderBy(F.desc("score"), ties).limit(k)


def embed_texts(df: DataFrame, column: str, model: EmbeddingModel, name: str = "vector") -> DataFrame:
    """df with the vectors of a text column (null for null texts): the model travels with the function and is loaded
    once per task."""
    @pandas_udf(ArrayType(FloatType()))
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model.load()
        try:
            for texts in parts:
                there = [t for t in texts if t is not None]
                found = iter(model.embed(there) if there else ())
                yield pd.Series([None if t is None else [float(x) for x in next(found)] for t in texts], dtype=object)
        finally:
            model.unload()

    return df.withColumn(name, embed(F.col(column)))


def text_search(df: DataFrame, column: str, text: str, model: EmbeddingModel, k: int, metric: str = "cosine") -> DataFrame:
    """The k rows whose vectors are nearest a text, which is embedded once."""
    model.load()
    try:
        query = list(model.embed([text])[0])
    finally:
        model.unload()
    return search(df, column, query, k, metric)
