"""Cleaning of vectors and the models learned from a bounded sample of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

MOST_SAMPLED = 20_000


def usable(vector: Column) -> Column:
    """True for vectors with at least one component, none null or not finite, and not all zero.

    Squares that overflow a double make the norm unusable, so such vectors count as not finite.
    """
    square = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")))
    return vector.isNotNull() & F.coalesce(whole, F.lit(False)) & F.coalesce(
        (square > 0) & (square < F.lit(float("inf"))), F.lit(False)
    )


def lengths(vectors: DataFrame) -> dict[int, int]:
    """The number of vectors of each length."""
    found = vectors.groupBy(F.size("vector").alias("n")).count().collect()
    return {r["n"]: r["count"] for r in sorted(found)}


def sample(vectors: DataFrame, length: int, most: int = MOST_SAMPLED) -> np.ndarray:
    """At most ``most`` vectors of this length, the first by a hash of id and content, as rows."""
    rows = vectors.where(F.size("vector") == length).orderBy(F.xxhash64(*vectors.columns), *vectors.columns)
    rows = rows.limit(most).select("vector").toArrow().column("vector")
    return np.array(rows.combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, length)


def principal_axes(rows: np.ndarray, centred: bool) -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes): axes are columns, largest spread first; a rotation, so products and distances stay."""
    mean = rows.mean(axis=0) if centred else np.zeros(rows.shape[1])
    _, axes = np.linalg.eigh((rows - mean).T @ (rows - mean))
    return mean, axes[:, ::-1].copy()
