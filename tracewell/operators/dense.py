"""Cosine search over supplied dense vectors, and the adapter for Python embedding models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tracewell.operators.ranking import check_top_k, top_k
from tracewell.operators.search import best_rows, vector_width


def embed_with(model: Callable[[list[str]], list[list[float]]]) -> Callable[[Column], Column]:
    """Turn a batch embedding function into a column function (Arrow batches)."""

    @F.pandas_udf("array<double>")
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([list(map(float, v)) for v in model(batch.tolist())])

    return embed


def dense_search(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """Top-k vectors per query by cosine: (query_id, chunk_id, score, rank).

    ``queries``: query_id, vector.  ``vectors``: chunk_id, vector.  The plan is that of the other
    searches (``search.best_rows``): query blocks of a measured size, one after the other; every task multiplies
    slices of its batches with the query matrix and returns k rows per query once.  Scores are cosines
    rounded to 9 digits, by which the ranks go; vectors of other lengths are refused, a null vector
    matches nothing.
    """
    check_top_k(k)
    dims = vector_width(queries, vectors)
    wide = F.col("vector").cast("array<double>").alias("vector")
    asked, pool = queries.select("query_id", wide), vectors.select("chunk_id", wide)
    best = best_rows(asked.filter("vector is not null"), pool.filter("vector is not null"), "vector", k, dims)
    return top_k(best, k).drop("matched_terms")
